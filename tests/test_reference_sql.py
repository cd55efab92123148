"""Every registered query against its reference SQL, on whole tables."""

import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    from compare import connect

    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    from compare import compare

    ok, message = compare(spark, con, SF, name, allow_empty=True)
    assert ok, message


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "score_pct" in df.columns


def test_every_reference_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
