"""Controls drafted from risk descriptions, without any model call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens import values as V
from fleetlens.functions.ordered import positions
from fleetlens.functions.regexkit import escape_regex
from fleetlens.session import stage

#: Places of a base id that are looked up in one group.
BLOCK = 1024


def _topic(description: Column) -> Column:
    words = F.regexp_extract_all(F.upper(description), F.lit("[A-Z0-9]+"), F.lit(0))
    kept = F.slice(F.filter(words, lambda w: ~w.isin(V.RISK_STOP_WORDS)), 1, V.RISK_TOPIC_WORDS)
    return F.when(F.size(kept) > 0, F.array_join(kept, "-")).otherwise(V.RISK_EMPTY_TOPIC)


def _keyword(description: Column) -> Column:
    """The first of the longest words; the description itself if it has none."""
    words = F.regexp_extract_all(description, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    longest = F.aggregate(words, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    return F.when(longest != "", longest).otherwise(escape_regex(description))


def _phrase(description: Column) -> Column:
    low = F.lower(description)
    hit = F.lit(False)
    for phrase in V.RISK_ABSENCE_PHRASES:
        hit = hit | low.contains(phrase)
    return hit


def risk_controls(risks: DataFrame) -> DataFrame:
    """risks(risk_id, framework, description) -> one drafted control each."""
    text = F.col("description")
    forbid = _phrase(text)
    return risks.select(
        "risk_id",
        "framework",
        F.concat(F.upper("framework"), F.lit("-"), _topic(text)).alias("base_id"),
        F.substring(text, 1, V.RISK_TITLE_CHARS).alias("title"),
        "description",
        F.lit(V.RISK_FAMILY).alias("family"),
        F.lit(V.RISK_FRAMEWORK_REF).alias("framework_ref"),
        F.lit("must").alias("severity"),
        F.lit("source_grep").alias("method"),
        F.when(forbid, "none_of").otherwise("any_of").alias("mode"),
        _keyword(text).alias("pattern"),
        F.when(forbid, "source_pattern_absent").otherwise("source_pattern_present").alias("assertion"),
    )


NUMBERED = r"^(.+)-([1-9][0-9]*)$"


def _numbers(ids: DataFrame) -> DataFrame:
    """(base_id, n) that each id takes: number 1 of itself, and number n of what stands before its suffix."""
    stem, n = F.regexp_extract("id", NUMBERED, 1), F.regexp_extract("id", NUMBERED, 2).try_cast("bigint")
    both = F.array(F.struct(F.col("id").alias("base_id"), F.lit(1).cast("bigint").alias("n")), F.struct(stem.alias("base_id"), n.alias("n")))
    rows = ids.select(F.explode(both).alias("t")).select("t.*")
    return rows.where((F.col("base_id") != "") & F.col("n").isNotNull()).where("n >= 1").distinct()


def _claimed(children: DataFrame, taken: DataFrame, numbered: DataFrame) -> DataFrame:
    """(base_id, n): numbers that another base takes first, given the numbers ``taken`` so far.

    A child's name is a number of its parent.  Whoever gets there first keeps
    it: the child with its first risk, the parent with the risk whose place is
    the rank of this number among its free ones.
    """
    asked = children.select(F.col("parent").alias("base_id"), "n", F.lit(0).alias("kind"))
    below = taken.join(asked.select("base_id").distinct(), "base_id", "left_semi").withColumn("kind", F.lit(1))
    among = positions(asked.unionByName(below), ["base_id"], ["n", "kind"]).where("kind = 0").drop("kind")
    alone = positions(asked.drop("kind"), ["base_id"], ["n"], "own")
    rank = among.join(alone, ["base_id", "n"]).select(F.col("base_id").alias("parent"), "n", (F.col("n") - F.col("place") + F.col("own")).alias("place"))
    parents = numbered.select(F.col("base_id").alias("parent"), "place", F.col("risk_id").alias("reached"))
    met = children.join(rank, ["parent", "n"]).join(parents, ["parent", "place"], "left")
    child_first = F.col("reached").isNull() | (F.col("first_risk") < F.col("reached"))
    return met.select(F.when(child_first, F.col("parent")).otherwise(F.col("base_id")).alias("base_id"), F.when(child_first, F.col("n")).otherwise(F.lit(1)).cast("bigint").alias("n"))


def risk_id_collision(drafted: DataFrame, existing: DataFrame) -> DataFrame:
    """Free ids for drafted controls in order of ``risk_id``: the base id, else the next free suffix.

    drafted(risk_id, base_id); existing(id) is the control table.  The result
    is that of drafting one risk after the other, ties of ``risk_id`` by base:
    no id is given twice, also where one base is another one with a number.
    Free numbers are ranges between the taken ones; a row finds its range by
    its place.  Which of two bases gets a name they share is settled in
    rounds, until nothing changes; a round settles at least the next such
    name of every base.  Without a base there is no id.
    """
    rows = drafted.select("risk_id", "base_id")
    numbered = stage(positions(rows.where(F.col("base_id").isNotNull()), ["base_id"], ["risk_id"]), "numbered")
    bases = stage(numbered.groupBy("base_id").agg(F.max("place").alias("size"), F.min("risk_id").alias("first_risk")), "bases")
    taken = stage(_numbers(existing).join(bases.select("base_id"), "base_id", "left_semi"), "taken")

    stem = F.regexp_extract("base_id", NUMBERED, 1)
    children = bases.select("base_id", "first_risk", stem.alias("parent"), F.regexp_extract("base_id", NUMBERED, 2).try_cast("bigint").alias("n"))
    children = children.where("n >= 2").join(bases.select(F.col("base_id").alias("parent")), "parent", "left_semi")
    children = stage(children.join(existing.select(F.col("id").alias("base_id")), "base_id", "left_anti"), "children")
    claimed = taken.limit(0)
    if not children.isEmpty():
        while True:
            now = stage(_claimed(children, taken.unionByName(claimed), numbered), "claimed")
            if now.exceptAll(claimed).isEmpty() and claimed.exceptAll(now).isEmpty():
                break
            claimed = now

    ranked = positions(taken.unionByName(claimed).distinct(), ["base_id"], ["n"], "i")
    points = stage(ranked.unionByName(bases.select("base_id", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("i"))), "points")
    after = points.select("base_id", (F.col("i") - 1).alias("i"), F.col("n").alias("next"))
    ranges = points.join(after, ["base_id", "i"], "left").join(bases.select("base_id", "size"), "base_id")
    ranges = ranges.select("base_id", "i", (F.col("n") - F.col("i") + 1).alias("lo"), F.least("size", F.col("next") - 1 - F.col("i")).alias("hi")).where("lo <= hi")
    block = lambda c: F.floor(F.col(c) / BLOCK)
    ranges = ranges.withColumn("block", F.explode(F.sequence(block("lo"), block("hi"))))
    found = numbered.withColumn("block", block("place")).join(ranges, ["base_id", "block"]).where("place BETWEEN lo AND hi")
    free = F.col("place") + F.col("i")
    named = F.when(free == 1, F.col("base_id")).otherwise(F.concat("base_id", F.lit("-"), free.cast("string")))
    none = rows.where(F.col("base_id").isNull()).withColumn("id", F.lit(None).cast("string"))
    return found.select("risk_id", "base_id", named.alias("id")).unionByName(none)
