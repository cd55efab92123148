"""Facts from API specifications, and the union and count of all facts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens import values as V
from fleetlens.operators import code_scan as code
from fleetlens.operators.checks import union_all
from fleetlens.operators.file_facts import KINDS, LABEL, all_rows, fact_stream, kind_rows
from fleetlens.session import stage


def _object(text: Column) -> Column:
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string,string>"))


def _operations(specs: DataFrame) -> DataFrame:
    """One row per specification with an array of its operations in order."""
    paths = F.map_entries(_object(F.get_json_object("spec", "$.paths")))

    def per_path(p: Column) -> Column:
        members = F.filter(
            F.map_entries(F.coalesce(_object(p["value"]), F.create_map().cast("map<string,string>"))),
            lambda m: ~m["key"].startswith("x-") & (m["key"] != "parameters") & F.ltrim(m["value"]).startswith("{"),
        )
        return F.transform(
            members,
            lambda m: F.struct(
                p["key"].alias("route"),
                F.upper(m["key"]).alias("method"),
                F.coalesce(F.get_json_object(m["value"], "$.operationId"), F.concat(m["key"], F.lit("_"), p["key"])).alias("handler"),
            ),
        )

    ops = F.flatten(F.transform(F.filter(paths, lambda p: p["value"].isNotNull()), per_path))
    return specs.select(
        "project",
        "source",
        F.coalesce(F.get_json_object("spec", "$.info.title"), F.lit("unknown")).alias("title"),
        F.coalesce(F.get_json_object("spec", "$.info.version"), F.lit("unknown")).alias("version"),
        F.coalesce(ops, F.array().cast("array<struct<route:string,method:string,handler:string>>")).alias("ops"),
    )


def _order(pos: Column) -> Column:
    return F.struct(F.lit(len(code.LANGUAGE_ORDER)).alias("lang"), F.col("source").alias("path"), pos.alias("pos"))


def openapi_routes(specs: DataFrame) -> DataFrame:
    """Routes of API specifications (project, source, spec as JSON text)."""
    return (
        _operations(specs)
        .select("project", "source", F.posexplode("ops").alias("pos", "o"))
        .select(
            "project",
            F.col("source").alias("source_file"),
            "o.route",
            "o.method",
            "o.handler",
            F.lit(0).alias("line"),
            F.lit("openapi").alias("framework"),
            F.lit("high").alias("confidence"),
            _order(F.col("pos")).alias("ord"),
        )
    )


def openapi_components(specs: DataFrame) -> DataFrame:
    """One service per specification, its handlers as public methods."""
    return _operations(specs).select(
        "project",
        F.col("source").alias("source_file"),
        F.col("title").alias("name"),
        F.lit(0).alias("line"),
        F.lit("service").alias("type"),
        F.transform("ops", lambda o: o["handler"]).alias("public_methods"),
        F.array().cast("array<string>").alias("dependencies"),
        F.lit("high").alias("confidence"),
        F.concat(F.lit(V.NOTE_OPENAPI), "version").alias("note"),
        _order(F.lit(0)).alias("ord"),
    )


def discover(
    sources: DataFrame,
    specs: DataFrame | None = None,
    live_models: DataFrame | None = None,
    staged: bool = False,
    kinds: Iterable[str] = KINDS,
) -> dict[str, DataFrame]:
    """Every kind of fact over all languages and sources; nothing is deduplicated.

    All frames explode one pass over the files.  ``staged`` writes its facts
    once, so that several frames can be used without reading texts again;
    ``kinds`` are those that are looked for.
    """
    stream = fact_stream(sources, kinds=kinds)
    if staged:
        stream = stage(stream, "facts")
    facts = {kind: kind_rows(stream, kind) for kind in kinds}
    if live_models is not None and "models" in facts:
        facts["models"] = facts["models"].unionByName(live_models)
    if specs is not None and "routes" in facts:
        facts["routes"] = facts["routes"].unionByName(openapi_routes(specs))
    if specs is not None and "components" in facts:
        facts["components"] = facts["components"].unionByName(openapi_components(specs))
    return facts


def discovery_union(sources: DataFrame, specs: DataFrame | None = None, live_models: DataFrame | None = None) -> DataFrame:
    """All facts in one table: (project, kind, name, source_file, line, confidence); every text is read once."""
    more = []
    if live_models is not None:
        more.append(("models", live_models))
    if specs is not None:
        more += [("routes", openapi_routes(specs)), ("components", openapi_components(specs))]
    frames = [all_rows(fact_stream(sources))]
    for kind, frame in more:
        frames.append(frame.select("project", F.lit(kind).alias("kind"), F.col(LABEL[kind]).alias("name"), "source_file", "line", "confidence"))
    return union_all(frames)


def discovery_summary(union: DataFrame) -> DataFrame:
    """(project, kind, n) of ``discovery_union``."""
    return union.groupBy("project", "kind").agg(F.count(F.lit(1)).alias("n"))
