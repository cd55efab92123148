"""Data assertions that restate controls: (project, ok, detail) per project."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens import values as V
from fleetlens.functions.regexkit import rx
from fleetlens.operators.controls import routes_with_guards
from fleetlens.sources.corpus import evidence_file_select


def controls_to_assert(controls: DataFrame, checks: DataFrame, include_partial: bool = False, style: str = "static_assertion") -> DataFrame:
    """(project, framework, id, assertion) of controls that hold and can be asserted.

    The last status of an id counts.
    """
    allowed = ["PASS", "WARN"] if include_partial else ["PASS"]
    last = checks.groupBy("project", "check_id").agg(F.max(F.struct("ord", "status")).alias("l"))
    holding = last.where(F.col("l.status").isin(allowed)).select("project", F.col("check_id").alias("id"))
    usable = controls.where(F.get_json_object("validation_test", "$.style") == style).select(
        "framework", "id", F.get_json_object("validation_test", "$.assertion").alias("assertion")
    )
    return holding.join(usable, "id").select("project", "framework", "id", "assertion")


def _tier(fields: DataFrame, tier: str | None) -> DataFrame:
    dicts = fields.where("is_dict")
    return dicts if not tier else dicts.where(F.lower(F.coalesce("classification", F.lit(""))) == tier.lower())


def _judge(projects: DataFrame, counts: DataFrame, empty: str, bad: str) -> DataFrame:
    """counts(project, n, missing): nothing in scope fails, and so does any miss."""
    joined = projects.select("project").join(counts, "project", "left")
    n, missing = F.coalesce("n", F.lit(0)), F.coalesce("missing", F.lit(0))
    detail = F.when(n == 0, empty).when(missing > 0, F.concat(missing.cast("string"), F.lit(bad)))
    return joined.select("project", ((n > 0) & (missing == 0)).alias("ok"), detail.alias("detail"))


def assert_companion_field(projects: DataFrame, fields: DataFrame, annotation: str, companion: str, tier: str | None = None) -> DataFrame:
    scope = _tier(fields, tier).where(F.array_contains("annotations", annotation))
    counts = scope.groupBy("project").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.array_contains("keys", companion)).alias("missing")
    )
    return _judge(projects, counts, f"no Ledger fields carry annotation {annotation}", f" fields missing {companion}")


def companion_field_misses(fields: DataFrame, annotation: str, companion: str, tier: str | None = None) -> DataFrame:
    """(project, schema_path, name) of every field that fails the assertion."""
    return _tier(fields, tier).where(
        F.array_contains("annotations", annotation) & ~F.array_contains("keys", companion)
    ).select("project", "schema_path", F.coalesce("name", F.lit("<unnamed>")).alias("name"))


def assert_tier_encrypted(projects: DataFrame, fields: DataFrame, tier: str) -> DataFrame:
    counts = _tier(fields, tier).groupBy("project").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.array_contains("annotations", "encrypted_at_rest")).alias("missing")
    )
    return _judge(projects, counts, f"no Ledger fields for tier {tier}", " fields missing encrypted_at_rest")


def tier_encrypted_misses(fields: DataFrame, tier: str) -> DataFrame:
    return _tier(fields, tier).where(~F.array_contains("annotations", "encrypted_at_rest")).select(
        "project", "schema_path", F.coalesce("name", F.lit("<unnamed>")).alias("name")
    )


def pattern_files(corpus: DataFrame, pattern: str, include=V.DEFAULT_INCLUDE, exclude=None) -> DataFrame:
    """(project, path) of selected files the pattern occurs in."""
    chosen = evidence_file_select(corpus, include=include, exclude=exclude)
    return chosen.where(F.col("content").rlike(rx(pattern, multiline=True))).select("project", "path")


def _by_hit(projects: DataFrame, hits: DataFrame, wanted: bool, detail: str) -> DataFrame:
    counts = hits.groupBy("project").agg(F.count(F.lit(1)).alias("files"))
    joined = projects.select("project").join(counts, "project", "left")
    ok = F.col("files").isNotNull() if wanted else F.col("files").isNull()
    return joined.select(
        "project", ok.alias("ok"), F.coalesce("files", F.lit(0)).alias("files"), F.when(~ok, detail).alias("detail")
    )


def assert_pattern_present(projects: DataFrame, corpus: DataFrame, pattern: str, include=V.DEFAULT_INCLUDE, exclude=None) -> DataFrame:
    return _by_hit(projects, pattern_files(corpus, pattern, include, exclude), True, f"pattern not found: {pattern}")


def assert_pattern_absent(projects: DataFrame, corpus: DataFrame, pattern: str, include=V.DEFAULT_INCLUDE, exclude=None) -> DataFrame:
    """The files behind a failure are ``pattern_files``."""
    return _by_hit(projects, pattern_files(corpus, pattern, include, exclude), False, "forbidden pattern found")


def assert_control_referenced(projects: DataFrame, corpus: DataFrame, control_id: str) -> DataFrame:
    """The id is looked for literally."""
    hits = evidence_file_select(corpus).where(F.col("content").contains(control_id)).select("project", "path")
    return _by_hit(projects, hits, True, f"pattern not found: {control_id}")


def assert_routes_guarded(projects: DataFrame, sources: DataFrame, guards: list[str]) -> DataFrame:
    """No exclusions and no further guards than the given ones."""
    routes = routes_with_guards(sources, [guards])
    counts = routes.groupBy("project").agg(F.count_if(~F.get("guarded", F.lit(0))).alias("bare"))
    joined = projects.select("project").join(counts, "project", "left")
    bare = F.coalesce("bare", F.lit(0))
    detail = F.when(bare > 0, F.concat(bare.cast("string"), F.lit(" routes without guard evidence")))
    return joined.select("project", (bare == 0).alias("ok"), detail.alias("detail"))


def assert_config_equals(projects: DataFrame, config_values: DataFrame, path: str, key: str, value: str) -> DataFrame:
    held = config_values.where((F.col("path") == path) & (F.col("key") == key)).select("project", "value")
    joined = projects.select("project").join(held, "project", "left")
    ok = F.equal_null("value", F.lit(str(value)))
    detail = F.when(F.col("value").isNull(), f"missing key {key}").when(
        ~ok, F.concat(F.lit(f"{key}="), "value", F.lit(f", expected {value}"))
    )
    return joined.select("project", ok.alias("ok"), detail.alias("detail"))


def assert_evidence_fresh(
    projects: DataFrame, evidence_index: DataFrame, files: DataFrame, key: str, max_age_days: int, as_of: str
) -> DataFrame:
    indexed = evidence_index.where(F.col("evidence_key") == key).select("project", "path")
    joined = projects.select("project").join(indexed, "project", "left").join(
        files.select("project", "path", "mtime"), ["project", "path"], "left"
    )
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("mtime")) / F.lit(86400e6)
    detail = (
        F.when(F.col("path").isNull(), f"missing evidence key {key}")
        .when(F.col("mtime").isNull(), F.concat(F.lit("missing evidence document: "), "path"))
        .when(age > max_age_days, F.concat(F.lit("evidence stale: "), F.bround(age).cast("bigint").cast("string"), F.lit(f"d > {max_age_days}d")))
    )
    return joined.select("project", detail.isNull().alias("ok"), detail.alias("detail"))
