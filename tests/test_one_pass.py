"""Queries over facts read every text once, and give what the single scanners give."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from fixtures import catalog
from fixtures.registry import Tables
from fleetlens.operators import code_scan as code, controls as C, drafts as D, line_scan
from fleetlens.sources.corpus import is_source_file


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("few")
    rows = [(i, f"text {i}\nemail and PACT:a{i}:b", f"s{i % 3}", "en") for i in range(96)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").write.parquet(f"{out}/documents.parquet")
    return str(out)


def of_scanners(t):
    c = t.code_corpus
    return {"components": code.components(c), "models": code.models(c), "routes": code.routes(c), "pact_keys": line_scan.scan_pact_keys(c)}


@pytest.mark.parametrize(
    ("name", "plain"),
    [
        ("draft_overview", D.draft_overview),
        ("draft_topology_edges", lambda f: D.draft_topology_edges(f["routes"], f["components"])),
    ],
)
def test_texts_are_read_once(spark, folder, name, plain):
    df = catalog.bind(name)(spark, folder)
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain()
    assert "documents.parquet" not in out.getvalue() and "ArrowEvalPython" not in out.getvalue()
    expected = plain(of_scanners(Tables(spark, folder)))
    assert df.count() > 0 and sorted(map(str, df.collect())) == sorted(map(str, expected.collect()))


def test_only_files_with_a_decorator_are_parsed_for_checks_and_controls(spark, corpus, monkeypatch):
    route = "@app.get('/a')\ndef a():\n    return None\n"
    files = corpus({"src/a.py": route, "src/b.py": "def b():\n    return None\n", "src/c.py": "x = 'me@home'\n", "src/d.py": "@bad(\n", "src/e.ts": "app.get('/e', f) // @"})
    sent = []
    whole = code.with_syntax

    def seen(frame, wanted):
        sent.extend(frame.where(wanted).select("path").collect())
        return whole(frame, wanted)

    monkeypatch.setattr(C, "with_syntax", seen)
    stream = C.text_stream(files, is_source_file()).select("path", F.transform("facts", lambda f: f["route"]).alias("routes"))
    assert dict(stream.collect()) == {"src/a.py": ["/a"], "src/b.py": [], "src/c.py": [], "src/d.py": [], "src/e.ts": ["/e"]}
    assert {r.path for r in sent} == {"src/a.py", "src/c.py", "src/d.py", "src/e.ts"}
