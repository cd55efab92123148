"""Draft tables proposed from discovered facts.

Every row carries ``_draft`` and ``_confidence``.  ``ord`` of the facts gives
the order in which the first of equal names wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens import values as V
from fleetlens.functions.text import constant_map, snake
from fleetlens.operators.checks import union_all

HUMAN = "Must be filled by human — cannot be inferred from source"


def _draft(confidence: str | Column) -> list[Column]:
    c = F.lit(confidence) if isinstance(confidence, str) else confidence
    return [F.lit(True).alias("_draft"), c.alias("_confidence")]


def _placed(df: DataFrame, n: int | None) -> DataFrame:
    """Rows with their place in the project by ``ord``; with ``n`` the first only, cut before the shuffle."""
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy("ord")))
    return placed if n is None else placed.where(F.col("place") <= n)


def draft_schemas(models: DataFrame) -> DataFrame:
    """One row per model, fields with confidence and note."""
    note = "Classification from field name pattern — human must confirm"
    fields = F.transform(
        "fields",
        lambda f: F.struct(
            f["name"].alias("name"),
            f["type"].alias("type"),
            f["confidence"].alias("_confidence"),
            f["classification_hint"].alias("classification"),
            F.when(f["classification_hint"].isNotNull(), "low").alias("_classification_confidence"),
            F.coalesce(f["note"], F.when(f["classification_hint"].isNotNull(), note)).alias("_note"),
        ),
    )
    return models.select(
        "project",
        F.concat(F.coalesce("orm", F.lit("unknown")), F.lit("_"), F.lower("name"), F.lit("_draft")).alias("artifact"),
        F.col("name").alias("model_name"),
        "source_file",
        "line",
        "orm",
        *_draft(F.col("confidence")),
        fields.alias("fields"),
    )


def draft_backends(models: DataFrame) -> DataFrame:
    """One row per ORM in use with the store it implies."""
    orm = F.coalesce("orm", F.lit("unknown"))
    grouped = models.groupBy("project", orm.alias("orm")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "confidence")).alias("first")
    )
    return grouped.select(
        "project",
        F.concat("orm", F.lit("_backend")).alias("id"),
        F.coalesce(constant_map(V.ORM_BACKEND)[F.col("orm")], F.lit("unknown")).alias("type"),
        F.concat(F.lit("Backend detected from "), "orm", F.lit(" model definitions")).alias("description"),
        *_draft(F.col("first.confidence")),
        F.concat(F.lit("Detected "), F.col("n").cast("string"), F.lit(" "), "orm", F.lit(" models")).alias("_note"),
    )


def draft_connection_hints(env: DataFrame) -> DataFrame:
    return env.select(
        "project", F.col("name").alias("env_var"), "backend_hint", F.col("path").alias("source_file"), "line", *_draft(F.col("confidence"))
    )


def draft_contracts(components: DataFrame) -> DataFrame:
    """One contract per component; access and authority stay empty for a human."""
    stub = F.struct(F.lit("low").alias("_confidence"), F.lit(HUMAN).alias("_note"), F.lit("").alias("rationale"))
    interface = F.transform(
        F.array_distinct("public_methods"),
        lambda m: F.struct(
            m.alias("method"), F.col("confidence").alias("_confidence"), F.lit("Derived from public method signature").alias("_note")
        ),
    )
    return components.select(
        "project",
        snake(F.col("name")).alias("component_id"),
        "name",
        "type",
        "source_file",
        interface.alias("interface"),
        stub.alias("data_access"),
        stub.alias("authority"),
        "dependencies",
        *_draft(F.col("confidence")),
    )


def node_name(source_file: Column) -> Column:
    """Node name from a file: its stem without a role suffix."""
    base = F.substring_index(source_file, "/", -1)
    stem = F.regexp_replace(base, r"(?s)(?<=.)\.[^.]*$", "")
    bare = F.regexp_replace(stem, "(?:" + "|".join(V.NODE_SUFFIXES) + ")$", "")
    return F.regexp_replace(F.lower(bare), "[^a-z0-9_]", "_")


def _route_nodes(routes: DataFrame) -> DataFrame:
    """Services from files with routes; of equal names the first file wins.

    Routes are gathered per file and framework, so a list never outgrows one
    file; the choice between files is an aggregate.
    """
    per_file = routes.groupBy("project", "framework", "source_file").agg(
        F.min("ord").alias("ord"),
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("ord", "route", "method"))).alias("listed"),
    )
    body = F.struct("ord", "framework", "source_file", "n", "listed")
    return (
        per_file.select("project", node_name(F.col("source_file")).alias("name"), body.alias("b"))
        .groupBy("project", "name")
        .agg(F.min_by("b", F.struct("b.ord", "b.framework")).alias("b"))
        .select("project", "name", "b.*")
    )


def _component_nodes(components: DataFrame, routes: DataFrame) -> DataFrame:
    """First component of each lower-case name that no service has."""
    body = F.struct("ord", "name", "type", "source_file", "confidence", "dependencies")
    firsts = components.groupBy("project", F.lower("name").alias("node")).agg(F.min_by(body, "ord").alias("b"))
    taken = routes.select("project", node_name(F.col("source_file")).alias("node")).distinct()
    return firsts.join(taken, ["project", "node"], "left_anti").select("project", "node", "b.*")


def draft_topology_nodes(routes: DataFrame, components: DataFrame) -> DataFrame:
    services = _route_nodes(routes)
    note = F.concat(F.lit("Detected "), F.col("n").cast("string"), F.lit(" "), "framework", F.lit(" routes"))
    pairs = F.transform("listed", lambda r: F.struct(r["route"].alias("path"), r["method"].alias("method")))
    first = services.select(
        "project", F.lit(0).alias("phase"), "name", F.lit("service").alias("type"), F.lit("http").alias("protocol"), "framework",
        "source_file", *_draft("high"), note.alias("_note"), pairs.alias("routes"),
    )
    none = F.lit(None).cast("string")
    second = _component_nodes(components, routes).select(
        "project", F.lit(1).alias("phase"), F.col("node").alias("name"), "type", none.alias("protocol"), none.alias("framework"),
        "source_file", *_draft(F.col("confidence")), none.alias("_note"), F.array().cast("array<struct<path:string,method:string>>").alias("routes"),
    )
    return first.unionByName(second)


def draft_topology_edges(routes: DataFrame, components: DataFrame) -> DataFrame:
    """Constructor parameters that name a node known by then, itself included."""
    nodes = _component_nodes(components, routes)
    services = routes.select("project", node_name(F.col("source_file")).alias("to")).distinct().select(
        "project", "to", F.lit(None).cast(nodes.schema["ord"].dataType).alias("known")
    )
    targets = services.unionByName(nodes.select("project", F.col("node").alias("to"), F.col("ord").alias("known")))
    wishes = nodes.select("project", F.col("node").alias("from"), "ord", F.posexplode("dependencies").alias("pos", "dep")).select(
        "project", "from", "ord", "pos", F.lower("dep").alias("to")
    )
    met = wishes.join(targets, ["project", "to"]).where(F.col("known").isNull() | (F.col("known") <= F.col("ord")))
    return met.select(
        "project", "from", "to", "pos", *_draft("medium"), F.lit("Inferred from constructor parameter").alias("_note")
    )


def draft_component_map(components: DataFrame) -> DataFrame:
    return components.select(
        "project", F.replace(F.lower("name"), F.lit(" "), F.lit("_")).alias("name"), "type", "source_file", "dependencies",
        *_draft(F.col("confidence")),
    )


def _tiers(sensitive: DataFrame) -> DataFrame:
    """Distinct tiers per project, sorted; pairs are reduced before collecting."""
    pairs = sensitive.select("project", "classification_hint").distinct()
    return pairs.groupBy("project").agg(F.array_sort(F.collect_list("classification_hint")).alias("tiers"))


def draft_constraints(sensitive: DataFrame) -> DataFrame:
    """One constraint per project with sensitive fields."""
    return _tiers(sensitive).select(
        "project",
        F.lit("C001").alias("id"),
        F.lit("Sensitive data handling").alias("boundary"),
        F.concat(F.lit("Fields classified as "), F.array_join("tiers", ", "), F.lit(" must be protected")).alias("condition"),
        F.lit("Unprotected access to classified fields").alias("violation"),
        F.lit("must").alias("severity"),
        *_draft("low"),
        F.lit("Inferred from field name patterns — human must confirm classifications").alias("_note"),
    )


def draft_trust_policy(projects: DataFrame, sensitive: DataFrame) -> DataFrame:
    joined = projects.select("project").join(_tiers(sensitive), "project", "left")
    return joined.select(
        "project", F.lit(V.TRUST_FLOOR).alias("floor"), F.coalesce("tiers", F.array(F.lit("PUBLIC"))).alias("classifications"), *_draft("low")
    )


def draft_schema_hints(env: DataFrame, sensitive: DataFrame, kept: int | None = None) -> DataFrame:
    """Stores named by the environment, and field hints: all, or the first ``kept`` per project."""
    stores = env.where(F.col("backend_hint").isNotNull()).select(
        "project", F.lit("storage_backend").alias("hint"), F.col("name").alias("subject"), F.col("backend_hint").alias("value"),
        *_draft(F.col("confidence")), F.lit(None).cast("string").alias("_note"),
    )
    if kept is not None:
        sensitive = _placed(sensitive.withColumn("ord", F.struct("path", "line", "pos")), kept)
    fields = sensitive.select(
        "project", F.lit("field").alias("hint"), F.col("field_name").alias("subject"), F.col("classification_hint").alias("value"),
        *_draft(F.col("confidence")), F.concat(F.lit("Matched pattern: "), "pattern_matched").alias("_note"),
    )
    return stores.unionByName(fields)


def draft_overview(facts: dict[str, DataFrame], kept: int | None = None) -> DataFrame:
    """Totals and the facts of each kind as lines: (project, section, place, text).

    ``place`` orders the lines of a section; ``kept`` gives the first only.
    """
    at = F.concat("source_file", F.lit(":"), F.col("line").cast("string"))
    lines = {
        "components": F.concat(F.lit("**"), "name", F.lit("** ("), "type", F.lit(") — "), at),
        "routes": F.concat(F.lit("`"), "method", F.lit(" "), "route", F.lit("` — "), "framework", F.lit(" ("), at, F.lit(")")),
        "models": F.concat(F.lit("**"), "name", F.lit("** ("), F.coalesce("orm", F.lit("None")), F.lit(") — "), at),
    }
    frames = [
        _placed(facts[kind], kept).select("project", F.lit(kind).alias("section"), "place", text.alias("text")) for kind, text in lines.items()
    ]
    for kind in ("components", "models", "routes", "pact_keys"):
        totals = facts[kind].groupBy("project").agg(F.count(F.lit(1)).alias("n"))
        frames.append(totals.select("project", F.lit(f"total_{kind}").alias("section"), F.lit(0).alias("place"), F.col("n").cast("string").alias("text")))
    return union_all(frames)


def draft_manifest(keys: DataFrame) -> DataFrame:
    """One manifest entry per key found; paths are left to a human."""
    parts = F.split("key", ":", -1)
    none = F.lit(None).cast("string")
    return keys.select(
        "project",
        F.col("key").alias("pact_key"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("unknown")).alias("component_id"),
        F.coalesce(F.get(parts, F.lit(2)), F.lit("unknown")).alias("method_id"),
        F.col("path").alias("source_file"),
        "line",
        none.alias("contract_path"),
        none.alias("test_path"),
        *_draft(F.col("confidence")),
    )


def adopt_candidates(drafts: DataFrame, floor: str = "high", confirm_classification: bool = False, tool: str | None = None) -> DataFrame:
    """(project, tool, path, confidence, decision) of every draft document.

    drafts(project, path, body as JSON text).
    """
    ranks = constant_map({"high": "0", "medium": "1", "low": "2"})
    declared = F.coalesce(F.get_json_object("body", "$._confidence"), F.lit("low"))
    rank = F.coalesce(ranks[declared], F.lit("2")).cast("int")
    classified = F.col("body").rlike(r'"(?:classification|_classification_confidence)"\s*:')
    owner = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("unknown")
    limit = {"high": 0, "medium": 1, "low": 2}[floor]
    decision = F.when(rank > limit, "SKIP confidence")
    if not confirm_classification:
        decision = decision.when(classified, "SKIP classification")
    rows = drafts.where(F.get_json_object("body", "$._draft") == "true").select(
        "project", owner.alias("tool"), "path", declared.alias("confidence"), decision.otherwise("WOULD ADOPT").alias("decision")
    )
    return rows if tool is None else rows.where(F.col("tool") == tool)


def adopt_summary(candidates: DataFrame) -> DataFrame:
    """(project, adopted, skipped)."""
    adopt = F.col("decision") == "WOULD ADOPT"
    return candidates.groupBy("project").agg(F.count_if(adopt).alias("adopted"), F.count_if(~adopt).alias("skipped"))
