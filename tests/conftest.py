import os
import sys

import pytest

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark():
    from fleetlens.session import local_session, ship

    session = local_session("tests", "4", "4g")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session


@pytest.fixture
def corpus(spark):
    """Builds a corpus frame from {path: text}."""

    def build(files: dict[str, str], project: str = "p"):
        from fleetlens.sources.corpus import corpus_language

        rows = [(project, path, text) for path, text in files.items()]
        return corpus_language(spark.createDataFrame(rows, "project string, path string, content string"), keep_unknown=True)

    return build
