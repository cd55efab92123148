"""Connected components of a table of links, by large and small stars.

Every round rewires each node's links to the least neighbour; links are
never gathered per node, only their least is.  A round's links are written to
the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _star(links: DataFrame) -> DataFrame:
    """Large star, then small star, on links (a > b)."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u <> v").distinct()  # u > v
    least = _least(large)
    joined = large.join(least, "u")
    small = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, class) for every node of links (a, b): the least node it is linked with, directly or not."""
    now = common.stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        after = common.stage(_star(now), "links")
        common.discard(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    ends = now.select(F.col("b").alias("node"), F.col("b").alias("class")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("class")).unionByName(ends)
