"""Numbers of rows within their group, however large one group is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.session import stage


def positions(df: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``df`` with each row's number, from 1, among the rows of equal ``keys`` (not null) in ``order``.

    A plain window puts a group into one task.  Here all rows are sorted by
    ranges, so that a large group is cut; each part of a group is numbered
    from its first row and shifted by the parts before it.
    """
    made = stage(df, "unordered")
    placed = stage(made.orderBy(*keys, *order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ordered")
    parts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = parts.select(*keys, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return placed.join(shifts, [*keys, "_part"]).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
