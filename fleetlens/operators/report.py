"""Scores, report rows, recommendations and the gate, all per project."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fleetlens import values as V
from fleetlens.functions.text import constant_map, percent
from fleetlens.session import stage


#: Statuses by their codes, the worst last.
STATUSES = ("INFO", "PASS", "WARN", "FAIL")
COUNTED = [f"score_{s.lower()}" for s in STATUSES]

#: The rows of one branch of checks may all come from one task: they are sorted by several.
CHECKS_PER_FILE = 50_000


def check_log(checks: DataFrame) -> DataFrame:
    """Check rows in reading order, written once, with their place ``seq``.

    Every result over check rows starts here.  Places are numbers that grow
    in order of (project, ord), so the first and last row of a group are plain
    minima and maxima of numbers; a project of any size is cut by its order.
    """
    made = stage(checks, "checks", rows=CHECKS_PER_FILE)
    ordered = made.orderBy("project", "ord", "status", "target", "message")
    return stage(ordered.withColumn("seq", F.monotonically_increasing_id()), "check-log")


def check_summary(log: DataFrame) -> DataFrame:
    """(project, tool, check_id, score_.., first_fail, first_warn, last): one row for each id.

    ``last`` is the last row's place and status in one number.  All that is
    added up are numbers, so it is one hash aggregation whose partial results
    can be added up again.
    """
    status = F.col("status")
    code = F.coalesce(*[F.when(status == s, F.lit(i)) for i, s in enumerate(STATUSES)])
    return log.groupBy("project", "tool", "check_id").agg(
        *[F.count_if(status == s).alias(c) for s, c in zip(STATUSES, COUNTED, strict=True)],
        F.min(F.when(status == "FAIL", F.col("seq"))).alias("first_fail"),
        F.min(F.when(status == "WARN", F.col("seq"))).alias("first_warn"),
        F.max(F.col("seq") * len(STATUSES) + code).alias("last"),
    )


def last_status(summary: DataFrame) -> DataFrame:
    """(project, check_id, status) of the last row of each id, over all tools."""
    last = summary.groupBy("project", "check_id").agg(F.max("last").alias("last"))
    return last.select("project", "check_id", F.get(F.array(*map(F.lit, STATUSES)), F.pmod("last", F.lit(len(STATUSES))).cast("int")).alias("status"))


def _scored(counts: DataFrame) -> DataFrame:
    total = F.col("score_pass") + F.col("score_warn") + F.col("score_fail")
    return counts.withColumn("total", total).withColumn("score_pct", percent(F.col("score_pass"), F.col("total")))


def score_overall(summary: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Counts and score of each project; of ``projects`` also those without any check, which score 100."""
    shown = [c for c in COUNTED if c != "score_info"]
    counts = summary.groupBy("project").agg(*[F.sum(c).alias(c) for c in shown])
    if projects is not None:
        counts = projects.select("project").distinct().join(counts, "project", "left").select("project", *[F.coalesce(c, F.lit(0)).alias(c) for c in shown])
    return _scored(counts)


def score_by_tool(summary: DataFrame) -> DataFrame:
    return _scored(summary.groupBy("project", "tool").agg(*[F.sum(c).alias(c) for c in COUNTED]))


def report_rows(checks: DataFrame) -> DataFrame:
    """Display columns, the target whole and as a report shows it; order by (project, tool, ord) to print."""
    target = F.col("target")
    shown = F.when(F.length(target) > 40, F.concat(F.lit("..."), F.right(target, F.lit(37)))).otherwise(target)
    return checks.select(
        "project",
        F.upper("tool").alias("tool"),
        "ord",
        "target",
        shown.alias("shown"),
        F.rpad("status", 6, " ").alias("status"),
        "message",
    )


def recommendations(summary: DataFrame, log: DataFrame) -> DataFrame:
    """One line per check id: those with a FAIL first, then those with a WARN.

    Only the first row of each id is looked up in the log; the numbering sees
    one row per (project, check id).
    """
    ids = summary.groupBy("project", "check_id").agg(F.min("first_fail").alias("fail"), F.min("first_warn").alias("warn"))
    rank = F.when(F.col("fail").isNotNull(), 0).otherwise(1)
    first = ids.select("project", "check_id", rank.alias("rank"), F.coalesce("fail", "warn").alias("seq")).where(F.col("seq").isNotNull())
    found = first.join(log.select("seq", "target", "message"), "seq")
    template = constant_map(V.RECOMMENDATIONS)[F.col("check_id")]
    text = F.coalesce(
        F.replace(template, F.lit("{t}"), F.col("target")),
        F.concat(F.lit("Fix: "), "check_id", F.lit(" — "), "message"),
    )
    place = F.row_number().over(Window.partitionBy("project").orderBy("rank", "seq", "check_id"))
    return found.select("project", place.alias("place"), "rank", "check_id", text.alias("recommendation"))


def gate_decision(summary: DataFrame, strict: bool = False) -> DataFrame:
    blocking = F.col("score_fail") + F.col("score_warn") if strict else F.col("score_fail")
    return summary.groupBy("project").agg((F.sum(blocking) > 0).alias("failed"))
