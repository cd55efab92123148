"""Baselines of check results and what got worse since."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens.operators.report import last_status, score_overall


def baseline_snapshot(summary: DataFrame) -> DataFrame:
    """(project, check_id, status, score_pct) of a ``check_summary``; the last row of an id counts."""
    return last_status(summary).join(score_overall(summary).select("project", "score_pct"), "project")


def baseline_regressions(baseline: DataFrame, summary: DataFrame) -> DataFrame:
    """Ids that passed in the baseline and do not pass now."""
    now = last_status(summary).withColumnRenamed("status", "now")
    passed = baseline.where(F.col("status") == "PASS").select("project", "check_id")
    joined = passed.join(now, ["project", "check_id"], "left")
    current = F.coalesce("now", F.lit("ABSENT"))
    return joined.where(current != "PASS").select(
        "project",
        "check_id",
        current.alias("now"),
        F.concat("check_id", F.lit(": PASS -> "), current).alias("regression"),
    )


def baseline_score_drop(baseline: DataFrame, summary: DataFrame) -> DataFrame:
    """Projects whose score fell, and projects without a baseline."""
    before = baseline.groupBy("project").agg(F.max("score_pct").alias("before"))
    both = score_overall(summary).select("project", "score_pct").join(before, "project", "left")
    text = F.when(F.col("before").isNull(), F.concat(F.lit("baseline missing: "), "project")).otherwise(
        F.concat(F.lit("score_pct: "), F.col("before").cast("string"), F.lit(" -> "), F.col("score_pct").cast("string"))
    )
    worse = F.col("before").isNull() | (F.col("score_pct") < F.col("before"))
    return both.where(worse).select("project", "before", F.col("score_pct").alias("now"), text.alias("regression"))


def verify_baseline(baseline: DataFrame, summary: DataFrame) -> DataFrame:
    """All regression lines: (project, regression)."""
    return (
        baseline_regressions(baseline, summary)
        .select("project", "regression")
        .unionByName(baseline_score_drop(baseline, summary).select("project", "regression"))
    )
