import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", ".."))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def documents():
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    return dict(zip(table["doc_id"], table["text"], strict=True))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with clashing names."""
    rows = [
        (1, "", "s", 5),
        (None, "the ring of the thing", None, None),
        (2, None, "s", 1),
        (3, "a b c d e f g " * 3000, "s", 2),
        (3, "a b c d e f g " * 3000, "s", 2),
        (4, "x", "t", None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, node long")
