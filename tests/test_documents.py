"""Readers of JSON and YAML documents on single cases."""

import contextlib
import io
import json
import random

import pyarrow as pa
import pytest
import yaml
from pyspark.sql import functions as F

from fleetlens.sources import documents as D

FILES = "project string, path string, content string"


@pytest.mark.parametrize(
    ("text", "ok"),
    [
        ('{"a": 1, "a": 2}', True),
        ('{"a": NaN, "b": -Infinity}', True),
        (' \n{"a": 1}\t\n', True),
        ('{"a": 1} trailing', False),
        ("{'a': 1}", False),
        ('{"a": 1,}', False),
        ("", False),
        (None, False),
        ("[" * 100_000, False),
        ("null", True),
    ],
)
def test_strict_json(spark, text, ok):
    df = spark.createDataFrame([("p", "m.json", text)], FILES)
    assert D.manifest_read(df)[0].first().parse_ok is ok


def test_last_key_counts(spark):
    df = spark.createDataFrame([("p", "m.json", '{"entries": 1, "entries": [{"pact_key": "a", "pact_key": "b", "contract_path": NaN}]}')], FILES)
    entry = D.manifest_read(df)[1].first()
    assert (entry.pact_key, entry.contract_path, sorted(entry["keys"])) == ("b", "NaN", ["contract_path", "pact_key"])


def test_registry_values_keep_their_types(spark):
    text = 'fields:\n- {name: a, gdpr_erasable: "true", immutable: true, audit_field: 1}\n- "{name: b}"\n- {name: 7, classification: , annotations: [x, {name: y}, 3, {name: 4}, "{name: z}"]}\n- 5\n- {weight: .nan}\n'
    df = spark.createDataFrame([("p", "s.yaml", text), ("p", "t.yaml", "name: no fields"), ("p", "u.yaml", "fields: text"), ("p", "v.yaml", "- list")], FILES)
    rows = D.registry_read(df).orderBy("schema_path", "pos").collect()
    got = [(r.schema_path, r.pos, r.name, r.classification, r.annotations, r.is_dict) for r in rows]
    assert got == [
        ("s.yaml", 0, "a", None, ["immutable"], True),
        ("s.yaml", 1, None, None, [], False),
        ("s.yaml", 2, "7", "None", ["x", "y", "{name: z}"], True),
        ("s.yaml", 3, None, None, [], False),
        ("s.yaml", 4, None, None, [], True),
        ("t.yaml", None, None, None, [], False),
    ]


def test_config_keys_with_dots_are_not_paths(spark):
    df = spark.createDataFrame([("p", "c.yaml", "a.b: 1\na:\n  b: 2\n  c.d: {e: 3}\n1: 4\n")], FILES)
    assert sorted((r.key, r.value) for r in D.config_values(df).where(F.col("key") != "a").collect()) == [("a.b", "2")]


def plan_of(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("read", [D.registry_read, D.contracts_read, D.controls_read])
def test_every_yaml_text_is_parsed_once(spark, read):
    df = spark.createDataFrame([("p", "s.yaml", "fields: []")], FILES)
    assert plan_of(read(df)).count("ArrowEvalPython") == 1


def test_plain_yaml_is_read_by_libyaml(monkeypatch):
    monkeypatch.setattr(D.yaml, "safe_load", lambda text: pytest.fail("the slow parser was asked"))
    assert D._load_yaml("a: [1, {b: 2020-01-01}]\nc: 'é'\n")["a"][0] == 1


def test_yaml_as_the_plain_parser_reads_it():
    pieces = ["a", "b: ", "- ", ":", "\n", "\n  ", "[", "]", "{", "}", ",", " #", "'", '"', "\t", "&x ", "*x", "!!str ", "? ", "|", "1.5", "\x85", "\ufeff", "\r", "---"]
    dice = random.Random(5)
    texts = ["".join(dice.choices(pieces, k=dice.randint(1, 9))) for _ in range(1500)]
    texts += ["a:\tb", "\tb", "a: b\tc", "[" * 400 + "]" * 400, "- " * 400 + "x", "k" * 1100 + ": 1", "%YAML 9.9\n---\na", '"\\x41"', "a: &b [1]\nc: *b", None, ""]

    def plain(text):
        try:
            return json.dumps(D._keyed(yaml.safe_load(text or "")), default=D._plain, ensure_ascii=False)
        except Exception:
            return None

    got = D._yaml_json(pa.array(texts, pa.string())).to_pylist()
    assert got == [{"ok": body is not None, "body": body} for body in map(plain, texts)]
