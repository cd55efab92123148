"""Everything that discovery, checks and controls need from texts, in one pass over the files.

``fact_stream`` gives one row per file with every kind of fact as an array: a
Python file is parsed once, every other text is read by one projection, and
nothing but facts leaves the stage.  All results of the discovery are
explodes of this table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens import values as V
from fleetlens.functions.regexkit import once
from fleetlens.operators import code_scan as code, line_scan

KINDS = ["components", "models", "routes", "pact_keys", "env_vars", "sensitive_fields"]
LABEL = {"components": "name", "models": "name", "routes": "route", "pact_keys": "key", "env_vars": "name", "sensitive_fields": "field_name"}
STRUCTURE = ("components", "models", "routes")


def _line_kind(kind: str, key_format: str) -> Column:
    text = F.col(code.TEXT)
    if kind == "pact_keys":
        return line_scan.pact_key_facts(text, key_format)
    return line_scan.env_var_facts(text) if kind == "env_vars" else line_scan.sensitive_facts(text)


@functools.lru_cache(maxsize=8)
def _facts(context: SparkContext, key_format: str, kinds: tuple[str, ...]) -> Column:
    """The kinds in one struct; the expression is the same for every table, so a context builds it once."""
    return F.struct(*[(code.fact_array(k) if k in STRUCTURE else _line_kind(k, key_format)).alias(k) for k in kinds])


def fact_stream(sources: DataFrame, key_format: str = V.PACT_KEY_FORMAT, kinds: Iterable[str] = KINDS) -> DataFrame:
    """(project, path, lang_rank, facts) of every file; ``facts`` holds one array per kind."""
    parsed = code.with_syntax(sources.select("project", "path", "lang", code.TEXT))
    facts = _facts(sources.sparkSession.sparkContext, key_format, tuple(kinds))
    return once(parsed, "facts", facts).select("project", "path", code.language_rank().alias("lang_rank"), "facts")


def kind_rows(stream: DataFrame, kind: str) -> DataFrame:
    """One row per fact of a kind, with the columns of its scanner."""
    if kind not in STRUCTURE:
        return stream.select("project", "path", F.explode(f"facts.{kind}").alias("f")).select("project", "path", "f.*")
    rows = stream.select("project", "path", "lang_rank", F.posexplode(f"facts.{kind}").alias("pos", "fact"))
    place = F.struct(F.col("lang_rank").alias("lang"), "path", "pos").alias("ord")
    return rows.select("project", F.col("path").alias("source_file"), "fact.*", place)


def all_rows(stream: DataFrame) -> DataFrame:
    """All kinds in one table: (project, kind, name, source_file, line, confidence)."""

    def named(kind: str) -> Column:
        return F.transform(
            f"facts.{kind}",
            lambda x: F.struct(F.lit(kind).alias("kind"), x[LABEL[kind]].alias("name"), x["line"].alias("line"), x["confidence"].alias("confidence")),
        )

    none = F.array().cast("array<struct<kind:string,name:string,line:int,confidence:string>>")
    each = F.concat(*(F.coalesce(named(k), none) for k in KINDS))
    rows = stream.select("project", F.col("path").alias("source_file"), F.explode(each).alias("f"))
    return rows.select("project", "f.kind", "f.name", "source_file", "f.line", "f.confidence")
