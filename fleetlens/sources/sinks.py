"""Where results go: reports, drafts, baselines."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, functions as F

from fleetlens.operators.report import recommendations, score_overall


def report_sink(log: DataFrame, summary: DataFrame, folder: str, stamp: str) -> None:
    """Check rows, scores and recommendations as JSON, under the run's stamp and then as "latest".

    "latest" is only touched once the stamped run is whole, and is copied from
    it, so a run that fails before leaves the last one in place.
    """
    tables = {"checks": log.drop("seq"), "scores": score_overall(summary), "recommendations": recommendations(summary, log)}
    for name, table in tables.items():
        table.write.mode("errorifexists").json(posixpath.join(folder, f"report_{stamp}", name))
    for name, table in tables.items():
        done = table.sparkSession.read.schema(table.schema).json(posixpath.join(folder, f"report_{stamp}", name))
        done.write.mode("overwrite").json(posixpath.join(folder, "report_latest", name))


def draft_sink(drafts: DataFrame, folder: str) -> None:
    """Draft rows, one folder per tool."""
    drafts.write.mode("overwrite").partitionBy("tool").json(folder)


def baseline_sink(snapshot: DataFrame, folder: str) -> None:
    snapshot.write.mode("overwrite").parquet(folder)


def draft_listing(drafts: DataFrame, tool: str | None = None) -> DataFrame:
    """(project, tool, path) of draft files; the tool is the first folder."""
    first = F.substring_index("path", "/", 1)
    named = drafts.select(
        "project", F.when(F.col("path").contains("/"), first).otherwise("unknown").alias("tool"), "path"
    )
    return named if tool is None else named.where(F.col("tool") == tool)
