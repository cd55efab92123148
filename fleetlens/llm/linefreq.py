"""Operator 8: lines that too many pages of one host share.

For every host the pages that hold a line are counted (a page counts once)
and divided by the host's pages; lines over a ratio, and on a least number of
pages, are boilerplate and are dropped from that host's pages.  Compared is
the line without outer blanks; blank lines are never dropped.

Counting needs one shuffle of (host, 64-bit line hash) pairs that are summed
before they leave a task.  A host has at most ``mean lines of a page / ratio``
boilerplate lines, so one list per host is bounded by its pages, not by their
number; the join by host may be skewed and is split by adaptive execution or
broadcast if small.  No Python.

Null texts have no lines and stay null; a null host is a host of its own;
extra columns are kept.

``report`` counts repeated rows as pages of their own, as its SQL says.
``clean``, which other stages follow, counts equal texts of a host as one
page and leaves a page whole that would lose every line: a group of copies
is not boilerplate, and deduplication still finds it with its text.  The
exact count reads the pages again, for the lines that the plain count leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Production parameters.
RATIO = 0.02
MIN_PAGES = 5
BLANK = " \t\n\x0b\f\r"


def line_hash(line: Column) -> Column:
    """Null for a blank line."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, n_pages, dropped array<bigint>): hashes of each host's boilerplate lines; hosts without any have no row."""
    lines = pages.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.transform(F.split(text, "\n"), line_hash))).alias("line"))
    counts = lines.where("line IS NOT NULL").groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    totals = pages.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_pages"))
    often = counts.where(F.col("n") >= min_pages).join(totals.withColumnRenamed("host", "of_host"), F.col("host").eqNullSafe(F.col("of_host")))
    often = often.where(F.col("n") > F.lit(ratio) * F.col("n_pages"))
    return often.groupBy("host", "n_pages").agg(F.collect_list("line").alias("dropped"))


def boilerplate_of_texts(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """As ``boilerplate``, with equal texts of a host as one page."""
    # a struct: rows that come by host are summed in their task before they are dealt out again
    rows = pages.select(F.struct(F.col(host).alias("host")).alias("of"), F.col(text).alias("text"), F.xxhash64(text).alias("page"))
    totals = rows.groupBy("of", "page").agg(F.count(F.lit(1)).alias("copies")).groupBy("of").agg(F.count(F.lit(1)).alias("n_pages"))
    totals = totals.select(F.col("of.host").alias("of_host"), "n_pages")
    lines = pages.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.transform(F.split(text, "\n"), line_hash))).alias("line"))
    counts = lines.where("line IS NOT NULL").groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    maybe = counts.join(totals, F.col("host").eqNullSafe(F.col("of_host"))).where(F.col("n") > F.lit(ratio) * F.col("n_pages"))
    maybe = common.stage(maybe.groupBy("host", "n_pages").agg(F.collect_list("line").alias("maybe")), "frequent_lines")
    held = rows.join(maybe, F.col("of.host").eqNullSafe(F.col("host")))
    held = held.select("of", "n_pages", "page", F.explode(F.array_intersect("maybe", F.transform(F.split("text", "\n"), line_hash))).alias("line"))
    counts = held.groupBy("of", "n_pages", "line", "page").agg(F.count(F.lit(1)).alias("copies")).groupBy("of", "n_pages", "line").agg(F.count(F.lit(1)).alias("n"))
    often = counts.where((F.col("n") >= min_pages) & (F.col("n") > F.lit(ratio) * F.col("n_pages")))
    return often.groupBy("of", "n_pages").agg(F.collect_list("line").alias("dropped")).select(F.col("of.host").alias("host"), "n_pages", "dropped")


def drop_lines(pages: DataFrame, host: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """(row struct, n_lines, n_dropped, text): every page with the text that remains.

    Without ``copies`` equal texts of a host count as one page and a page that would lose every line stays whole.
    """
    found = (boilerplate if copies else boilerplate_of_texts)(pages, host, text, ratio, min_pages).select(F.col("host").alias("found_host"), "dropped")
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), F.col(host).alias("host"), F.col(text).alias("text"))
    rows = rows.join(found, F.col("host").eqNullSafe(F.col("found_host")), "left").drop("found_host", "host")
    rows = rows.withColumn("lines", F.split("text", "\n"))
    rest = F.filter("lines", lambda line: F.coalesce(~F.array_contains("dropped", line_hash(line)), F.lit(True)))
    rows = rows.withColumn("rest", F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(rest))
    if not copies:
        rows = rows.withColumn("rest", F.when(F.exists("rest", lambda line: line_hash(line).isNotNull()), F.col("rest")).otherwise(F.col("lines")))
    n_lines = F.coalesce(F.size("lines"), F.lit(0)).cast("long")
    return rows.select(
        "row",
        F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines).alias("n_lines"),
        F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines - F.size("rest")).alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join("rest", "\n")).alias("text"),
    )


def clean(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents with the lines dropped, copies counted once, all columns in place; ``n_chars`` is left as it was measured."""
    rows = drop_lines(docs, host, text, copies=False)
    return rows.select(*(F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its lines, the lines dropped, a digest of the text that remains."""
    rows = drop_lines(docs.select("doc_id", "source", "text"), "source")
    return rows.select("row.doc_id", "row.source", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


ORACLE = f"""
WITH pages AS (SELECT row_number() OVER () AS row_id, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT row_id, source, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM pages),
bare AS (SELECT row_id, source, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b FROM l),
counts AS (SELECT source, b, count(DISTINCT row_id) AS n FROM bare WHERE b <> '' GROUP BY source, b),
totals AS (SELECT source, count(*) AS n_pages FROM pages GROUP BY source),
often AS (
  SELECT c.source, c.b FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO}::DOUBLE * t.n_pages),
kept AS (
  SELECT row_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM bare x
  WHERE NOT EXISTS (SELECT 1 FROM often o WHERE o.source IS NOT DISTINCT FROM x.source AND o.b = x.b) GROUP BY row_id)
SELECT p.doc_id, p.source, coalesce(len(p.lines), 0)::BIGINT AS n_lines,
  (coalesce(len(p.lines), 0) - coalesce(k.n, 0))::BIGINT AS n_dropped,
  CASE WHEN p.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS text_sha256
FROM pages p LEFT JOIN kept k USING (row_id)
"""
