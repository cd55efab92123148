"""Registries, contracts, topologies, manifests, configurations as tables.

Input is always a corpus frame (project, path, content).  YAML has no reader
in Spark, so its text goes through one Arrow UDF that returns JSON; all
structure is then taken apart with Spark's JSON functions.
"""

from __future__ import annotations

import datetime
import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from fleetlens.functions.regexkit import once
from fleetlens.session import stage

try:
    import yaml
except ImportError:  # pragma: no cover - YAML sources need it on the executors
    yaml = None


def _needs_yaml() -> None:
    """Fails the job where PyYAML is missing: no document is called broken for that."""
    if yaml is None:
        raise RuntimeError("reading YAML sources needs PyYAML on the executors")


def _keyed(value):
    """The same value with keys that JSON can hold, others as text."""
    if isinstance(value, dict):
        plain = (str, int, float, bool, type(None))
        return {k if isinstance(k, plain) else str(k): _keyed(v) for k, v in value.items()}
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    return [_keyed(v) for v in value] if isinstance(value, list) else value


def _plain(value):
    """YAML values JSON cannot hold, as text."""
    if isinstance(value, (datetime.date, datetime.datetime, bytes, set)):
        return str(value)
    return value


# Texts that libyaml and PyYAML's own parser read alike where libyaml reads them at all: no tabs, tags, anchors, block
# scalars, escapes or markers, no long lines (keys end after 1,024 characters).
_ALIKE = re.compile(r"[\n \"#$'()+,\-./0-9:;=A-Z\[\]^_a-z{}~\xa1-\u2027\u202a-\ud7ff\ue000-\ufefe]*\Z")
_APART = ("---", "...", "- " * 50)
_BRACKETS, _LINE, _DEPTH = 2000, 1000, 50


def _alike(text: str) -> bool:
    return (
        _ALIKE.match(text) is not None
        and not any(mark in text for mark in _APART)
        and text.count("[") + text.count("{") <= _BRACKETS
        and (len(text) < _LINE or max(map(len, text.split("\n"))) < _LINE)
    )


def _depth(value) -> int:
    """Levels of lists and objects, counted up to one more than ``_DEPTH``."""
    depth, level = 0, [value]
    while depth <= _DEPTH and (level := [v for v in level if isinstance(v, (dict, list))]):
        depth += 1
        level = [v for held in level for v in (held.values() if isinstance(held, dict) else held)]
    return depth


def _load_yaml(text: str):
    """``yaml.safe_load``, by libyaml where both parsers read a text alike.

    What libyaml refuses or nests deep is left to PyYAML's parser, whose word is final.
    """
    if hasattr(yaml, "CSafeLoader") and _alike(text):
        try:
            value = yaml.load(text, Loader=yaml.CSafeLoader)
        except Exception:  # the other parser decides
            return yaml.safe_load(text)
        if _depth(value) <= _DEPTH:
            return value
    return yaml.safe_load(text)


def _parsed(bodies: list[str | None]) -> pa.Array:
    """``struct<ok, body>`` of JSON texts, None for a broken document."""
    body = pa.array(bodies, pa.string())
    return pa.StructArray.from_arrays([body.is_valid(), body], ["ok", "body"])


def _yaml_json(texts: pa.Array) -> pa.Array:
    _needs_yaml()
    out = []
    for text in texts.to_pylist():
        try:
            out.append(json.dumps(_keyed(_load_yaml(text or "")), default=_plain, ensure_ascii=False, allow_nan=True))
        except Exception:  # any unreadable document counts as broken
            out.append(None)
    return _parsed(out)


def yaml_documents(files: DataFrame) -> DataFrame:
    """(project, path, parse_ok, body): YAML text as JSON text, each text parsed once."""
    parsed = once(files.select("project", "path", "content"), "y", arrow_udf(_yaml_json, "struct<ok:boolean,body:string>")(F.col("content")))
    return parsed.select("project", "path", F.col("y.ok").alias("parse_ok"), F.col("y.body").alias("body"))


_DECODER = json.JSONDecoder(parse_constant=str)
_ENCODER = json.JSONEncoder(ensure_ascii=False)


def _strict_json(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.to_pylist():
        try:
            out.append(_ENCODER.encode(_DECODER.decode(text)))
        except (ValueError, TypeError, RecursionError):  # no JSON, no text, nested too deep
            out.append(None)
    return _parsed(out)


def json_document(text: Column) -> Column:
    """``struct<ok, body>``: is a text one JSON document, and the document again.

    Of a repeated key the last one counts, NaN and infinities are allowed (as
    texts in ``body``), blanks around are too, anything else after the
    document is not.
    """
    return arrow_udf(_strict_json, "struct<ok:boolean,body:string>")(text)


def located(corpus: DataFrame, places: list[str], configured: DataFrame | None = None, suffix: str = ".yaml") -> DataFrame:
    """Files of the first place that exists in each project.

    A place is a file or a folder; ``configured`` (project, place) comes before
    the fixed ones and, where given, replaces them.
    """
    options = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(p).alias("place")) for i, p in enumerate(places)])
    if configured is None:
        all_options = corpus.select("project", "path", "content", options.alias("options"))
    else:
        own = configured.where(F.col("place").isNotNull()).select(
            "project", F.array(F.struct(F.lit(0).alias("rank"), F.regexp_replace("place", r"^\./|/+$", "").alias("place"))).alias("own")
        )
        all_options = corpus.join(own, "project", "left").select(
            "project", "path", "content", F.coalesce("own", options).alias("options")
        )
    inside = lambda o: (F.col("path") == o["place"]) | F.col("path").startswith(F.concat(o["place"], F.lit("/")))
    held = F.array_min(F.transform(F.filter("options", inside), lambda o: o["rank"]))
    ranked = all_options.withColumn("rank", held).where(F.col("rank").isNotNull())
    best = ranked.groupBy("project").agg(F.min("rank").alias("rank"))
    kept = ranked.where(F.col("path").endswith(suffix)) if suffix else ranked
    return kept.join(best, ["project", "rank"]).select("project", "path", "content")


def _text(body: Column, path: str) -> Column:
    return F.get_json_object(body, path)


def _as_map(body: Column) -> Column:
    """Top-level members as JSON texts; NULL unless the document is an object."""
    return F.when(F.ltrim(body, F.lit(" \t\r\n")).startswith("{"), F.from_json(body, "map<string,string>"))


# --- registries -------------------------------------------------------------------

REGISTRY_PLACES = [".ledger/registry", ".ledger"]


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _member(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def registry_read(files: DataFrame) -> DataFrame:
    """One row per entry of every schema's ``fields`` list.

    ``annotations`` unites listed names, listed ``{name: ..}`` objects and
    keys that are true; ``keys`` holds the entry's keys.  Values keep their
    types: the text "true" is no flag, and a text entry is no object whatever
    it spells.  Broken files and lists that are no lists give nothing; an
    empty list gives one row without position.
    """
    docs = once(yaml_documents(files).where("parse_ok"), "v", F.try_parse_json("body")).where(_is(F.col("v"), "OBJECT"))
    listed = once(docs.select("project", F.col("path").alias("schema_path"), "v"), "listed", _member(F.col("v"), "$.fields", "variant"))
    listed = listed.where(F.col("listed").isNull() | _is(F.col("listed"), "VOID") | _is(F.col("listed"), "ARRAY"))
    entries = F.when(_is(F.col("listed"), "ARRAY"), _member(F.col("listed"), "$", "array<variant>"))
    rows = listed.select("project", "schema_path", F.posexplode_outer(entries).alias("pos", "entry"))
    typed = rows.withColumn("m", F.when(_is(F.col("entry"), "OBJECT"), _member(F.col("entry"), "$", "map<string,variant>")))
    raw = F.col("m")["annotations"]
    names = F.transform(
        F.when(_is(raw, "ARRAY"), _member(raw, "$", "array<variant>")),
        lambda a: F.when(_is(a, "STRING"), _member(a, "$", "string")).when(_is(a, "OBJECT"), F.when(_is(_member(a, "$.name", "variant"), "STRING"), _member(a, "$.name", "string"))),
    )
    flags = F.map_keys(F.map_filter("m", lambda k, v: _is(v, "BOOLEAN") & F.coalesce(_member(v, "$", "boolean"), F.lit(False))))
    classification = F.when(
        F.array_contains(F.map_keys("m"), "classification"),
        F.coalesce(_member(F.col("m")["classification"], "$", "string"), F.lit("None")),
    )
    empty = F.array().cast("array<string>")
    return typed.select(
        "project",
        "schema_path",
        F.col("pos").cast("bigint").alias("pos"),
        _member(F.col("m")["name"], "$", "string").alias("name"),
        classification.alias("classification"),
        F.array_distinct(F.concat(F.coalesce(F.array_compact(names), empty), F.coalesce(flags, empty))).alias("annotations"),
        F.coalesce(F.map_keys("m"), empty).alias("keys"),
        F.col("m").isNotNull().alias("is_dict"),
    )


# --- contracts ----------------------------------------------------------------------

CONTRACT_PLACES = [".pact", "contracts", "pact"]


def contracts_read(files: DataFrame) -> DataFrame:
    """(project, path, parse_ok, keys, rationale); other than objects are dropped.

    ``rationale`` is '' where it is missing and NULL where it is no text.
    """
    docs = yaml_documents(files).where(~F.col("parse_ok") | F.col("body").startswith("{"))
    members = _as_map(F.col("body"))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("body"), "$.data_access.rationale", "variant"))
    given = _text(F.col("body"), "$.data_access.rationale")
    rationale = F.when(kind.isNull(), "").when(kind == "STRING", given)
    return docs.select(
        "project", "path", "parse_ok", F.coalesce(F.map_keys(members), F.array().cast("array<string>")).alias("keys"),
        rationale.alias("rationale"),
    )


# --- topology -----------------------------------------------------------------------

TOPOLOGY_PLACES = ["baton.yaml", "baton.yml"]


def topology_read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topologies, topology_nodes)."""
    docs = yaml_documents(files)
    readable = F.col("parse_ok") & F.col("body").startswith("{")
    docs = docs.where(~F.col("parse_ok") | readable).withColumn("m", _as_map(F.col("body")))
    empty = F.array().cast("array<string>")
    topologies = docs.select(
        "project", "path", "parse_ok", F.coalesce(F.col("m")["version"], F.lit("1.0")).alias("version"),
        F.coalesce(F.map_keys(_as_map(F.col("m")["global"])), empty).alias("global_keys"),
    )
    nodes = (
        docs.where(readable & F.col("m")["nodes"].startswith("["))
        .select("project", F.posexplode(F.from_json(F.col("m")["nodes"], "array<string>")).alias("pos", "node"))
        .where(F.col("node").startswith("{"))
        .select("project", F.col("pos").cast("bigint").alias("pos"), _as_map(F.col("node")).alias("n"))
        .select(
            "project", "pos", F.coalesce(F.col("n")["name"], F.lit("unknown")).alias("name"),
            F.coalesce(F.col("n")["protocol"], F.lit("")).alias("protocol"), F.map_keys("n").alias("keys"),
        )
    )
    return topologies, nodes


# --- manifest ------------------------------------------------------------------------

MANIFEST_PLACES = [".sentinel/manifest.json", "sentinel_manifest.json"]


def manifest_read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifests, manifest_entries) of JSON manifests; both come from one pass over the texts, written once."""
    parsed = once(files.select("project", "path", "content"), "j", json_document(F.col("content")))
    read = stage(parsed.select("project", "path", F.col("j.ok").alias("parse_ok"), _as_map(F.col("j.body"))["entries"].alias("listed")), "manifests")
    manifests = read.select("project", "path", "parse_ok")
    entries = (
        read.where(F.col("listed").startswith("["))
        .select("project", F.posexplode(F.from_json("listed", "array<string>")).alias("pos", "entry"))
        .where(F.col("entry").startswith("{"))
        .select("project", F.col("pos").cast("bigint").alias("pos"), F.from_json("entry", "map<string,string>").alias("e"))
        .select(
            "project", "pos", F.col("e")["pact_key"].alias("pact_key"), F.map_keys("e").alias("keys"),
            F.col("e")["contract_path"].alias("contract_path"), F.col("e")["test_path"].alias("test_path"),
        )
    )
    return manifests, entries


# --- controls ------------------------------------------------------------------------


def controls_read(files: DataFrame) -> DataFrame:
    """Framework YAML files as a control table (see ``operators.controls``)."""
    docs = yaml_documents(files).where("parse_ok").where(F.col("body").startswith("{")).withColumn("m", _as_map(F.col("body")))
    rows = docs.select(
        F.lower(F.col("m")["framework"]).alias("framework"), F.col("m")["framework_version"].alias("framework_version"), "path", F.posexplode(F.from_json(F.col("m")["controls"], "array<string>")).alias("pos", "c")
    ).select("framework", "framework_version", "path", "pos", _as_map(F.col("c")).alias("c"))
    get = lambda k: F.col("c")[k]
    return rows.where(F.length(get("id")) > 0).where(~get("id").rlike(r"(?U)\s")).select(
        "framework", "framework_version", get("id").alias("id"), F.col("pos").cast("bigint").alias("ord"), get("family").alias("family"),
        get("framework_ref").alias("framework_ref"), get("title").alias("title"), get("description").alias("description"),
        F.coalesce(get("severity"), F.lit("must")).alias("severity"), get("classification_tier").alias("classification_tier"),
        F.coalesce(get("applicability"), F.lit("{}")).alias("applicability"), get("detection").alias("detection"),
        F.coalesce(get("corroborating_detection"), F.lit("[]")).alias("corroborating"),
        get("validation_test").alias("validation_test"), get("evidence_owner").alias("evidence_owner"),
    )


# --- configuration values --------------------------------------------------------------


def _flatten(node, prefix: str = ""):
    """Every dotted key with the text of its value; a key that holds a dot or is no text can't be asked for."""
    for key, value in node.items():
        if not isinstance(key, str) or "." in key:
            continue
        name = f"{prefix}{key}"
        if value is not None:
            yield {"key": name, "value": str(value)}
        if isinstance(value, dict):
            yield from _flatten(value, name + ".")


def _yaml_values(texts: pa.Array) -> pa.Array:
    _needs_yaml()
    out = []
    for text in texts.to_pylist():
        try:
            data = _load_yaml(text or "")
        except Exception:  # an unreadable file has no keys
            data = None
        out.append(list(_flatten(data)) if isinstance(data, dict) else [])
    return pa.array(out, type=pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])))


def config_values(files: DataFrame) -> DataFrame:
    """(project, path, key, value) for every dotted key of YAML or JSON files."""
    return files.select("project", "path", F.explode(arrow_udf(_yaml_values, "array<struct<key:string,value:string>>")(F.col("content"))).alias("v")).select(
        "project", "path", "v.key", "v.value"
    )


# --- evidence ---------------------------------------------------------------------------


def evidence_index_from_markdown(lines: DataFrame) -> DataFrame:
    """Table rows of markdown lines (project, pos, text) as (evidence_key, path).

    First and last cell count; the last row of a key wins.
    """
    row = lines.where(F.col("text").contains("|") & ~F.col("text").contains("---"))
    cells = F.transform(F.split(F.regexp_replace("text", r"^\|+|\|+$", ""), r"\|", -1), lambda c: F.regexp_replace(c, "^[ `]+|[ `]+$", ""))
    pairs = row.select("project", "pos", cells.alias("cells")).where(F.size("cells") >= 2).select(
        "project", "pos", F.get("cells", F.lit(0)).alias("key"), F.element_at("cells", -1).alias("value")
    )
    valid = (F.col("key") != "") & (F.col("value").contains("/") | F.col("value").endswith(".md"))
    return (
        pairs.where(valid)
        .groupBy("project", F.lower(F.replace("key", F.lit(" "), F.lit("_"))).alias("evidence_key"))
        .agg(F.max_by("value", "pos").alias("path"))
    )


def evidence_stat(index: DataFrame, files: DataFrame) -> DataFrame:
    """(project, evidence_key, path, found, mtime) of every indexed path."""
    stamped = files.select("project", "path", "mtime")
    return index.join(stamped, ["project", "path"], "left").select(
        "project", "evidence_key", "path", F.col("mtime").isNotNull().alias("found"), "mtime"
    )
