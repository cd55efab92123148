"""Operator 5: url rules, and naive Bayes over segmented host and path words.

A rule is a host and the beginning of a path; it fits its host and all
subdomains, and the longest rule that fits wins.  Other urls are judged by
the method: host and path are cut at punctuation, each piece is split into
words by a unigram Viterbi search, and multinomial naive Bayes compares how
often the words stand in urls that rules block and in all others.  Words that
the rules themselves name are no evidence; listed bad words count as a fixed
share of the blocked words each.

Word frequencies come from the titles of all pages; all words form the
unigram model.  It stays a table: each distinct piece is joined, by its
substrings of the lengths that words have, with the words it can hold.  Urls are grouped by host
and path shape (digits as one 0) before any of this, so a hot host is one
row.  Null urls and urls without ``://`` have an empty host and path and are
allowed unless a rule fits; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import ship

from . import common

#: (verdict, host, path), as given for the production query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words known to be bad, and the share of all blocked words that each counts for.
BLOCKED_WORDS = ("ads", "ad", "track", "tracker", "tracking", "casino", "porn", "adult", "spam", "pills", "viagra", "malware", "phishing", "popup")
BLOCKED_SHARE = 0.02
SUBSTRINGS = 1 << 16  # rows of a batch
#: Block if the words are at least so many times likelier in blocked urls.
ODDS = 9.0


def parse(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn("path", path)


def ruled(parsed: DataFrame, rules=RULES) -> DataFrame:
    """With ``rule`` and ``ruling`` of the longest rule that fits, else null."""
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruling = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return parsed.withColumn("rule", rule).withColumn("ruling", ruling)


def unigrams(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): all words of all titles, and the listed bad words."""
    title = F.lower(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"<title>([^<]*)", 1))
    words = pages.select(F.explode(F.regexp_extract_all(title, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"), F.lit(1).alias("n"))
    listed = pages.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, BLOCKED_WORDS))).alias("word"), F.lit(0).alias("n"))
    return words.unionByName(listed).groupBy("word").agg(F.greatest(F.sum("n"), F.lit(1)).alias("n"))


class Segmenter:
    """The likeliest split of a string into words; unknown words get less likely by the character."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = sum(counts.values()) + 1 if total is None else total
        self.known = {w: math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(1 / total)

    def split(self, text: str) -> list[str]:
        begins: list[list[tuple[int, float]]] = [[] for _ in range(len(text) + 1)]
        for word, score in self.known.items():
            start = text.find(word)
            while word and start >= 0:
                begins[start + len(word)].append((start, score))
                start = text.find(word, start + 1)
        best, back, rest, since = [0.0], [0], 0.0, 0
        for end in range(1, len(text) + 1):
            # the best unknown word that ends here begins at the same place for all ends until a better one
            if best[-1] + 2.5 * (end - 1) > rest:
                rest, since = best[-1] + 2.5 * (end - 1), end - 1
            top, at = rest + self.unknown - 2.5 * end, since
            for start, known in sorted(begins[end]):
                if best[start] + known > top:
                    top, at = best[start] + known, start
            best.append(top)
            back.append(at)
        out, end = [], len(text)
        while end:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]


def words_of(shapes: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, shape, words): the words of each piece of host and path."""
    ship(shapes.sparkSession)
    counts = common.stage(counts, "unigrams")
    model = counts.agg(F.sum("n").alias("n"), F.collect_set(F.length("word")).alias("lengths")).first()
    total, lengths = model.n + 1, sorted(model.lengths)

    def pieces(batches):
        for batch in batches:
            rows = []
            for host, shape in zip(batch.column("host").to_pylist(), batch.column("shape").to_pylist(), strict=True):
                rows.append([p for p in re.findall(r"[^\W_]+", host + " " + shape.lower()) if not p.isdigit()])
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shape"), pa.array(rows, pa.list_(pa.string()))], ["host", "shape", "pieces"])

    def rows_of(found):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found, strict=True)], ["piece", "word"])

    def substrings(batches):
        found = set()
        for batch in batches:
            for piece in batch.column("piece").to_pylist():
                for length in lengths:
                    for start in range(len(piece) - length + 1):
                        found.add((piece, piece[start : start + length]))
                        if len(found) >= SUBSTRINGS:
                            yield rows_of(found)
                            found = set()
        if found:
            yield rows_of(found)

    def split(batches):
        for batch in batches:
            rows = []
            for piece, known in zip(batch.column("piece").to_pylist(), batch.column("known").to_pylist(), strict=True):
                rows.append(Segmenter({k["word"]: k["n"] for k in known}, total).split(piece))
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(rows, pa.list_(pa.string()))], ["piece", "words"])

    each = common.stage(shapes.select("host", "shape").mapInArrow(pieces, "host string, shape string, pieces array<string>").select("host", "shape", F.explode("pieces").alias("piece")), "pieces")
    distinct = common.stage(each.select("piece").distinct(), "distinct_pieces")
    known = distinct.mapInArrow(substrings, "piece string, word string").join(counts, "word")
    known = known.select("piece", F.struct("word", "n").alias("one")).unionByName(distinct.select("piece", F.lit(None).cast("struct<word:string,n:bigint>").alias("one")))
    known = known.groupBy("piece").agg(F.collect_set("one").alias("known"))  # nulls are left out
    words = known.mapInArrow(split, "piece string, words array<string>")
    return each.join(words, "piece").select("host", "shape", "words")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES) -> DataFrame:
    """(key, host, path, rule, verdict, odds) of every page."""
    parsed = ruled(parse(pages.select(F.col(key).alias("key"), F.col(url).alias("url")), "url"), rules)
    parsed = parsed.withColumn("shape", F.regexp_replace("path", "[0-9]+", "0"))
    shapes = common.stage(parsed.groupBy("host", "shape").agg(F.count_if(F.col("ruling") == "block").alias("blocked"), F.count_if(F.coalesce("ruling", F.lit("")) != "block").alias("others")), "shapes")
    words = common.stage(words_of(shapes, unigrams(pages, html)), "shape_words")
    named = sorted({w for _, host, path in rules for w in re.findall(r"\w+", host + path)})
    each = words.select("host", "shape", F.explode("words").alias("word")).where(~F.col("word").isin(named))
    seen = each.join(shapes, ["host", "shape"]).groupBy("word").agg(F.sum("blocked").alias("b"), F.sum("others").alias("a"))
    bad = F.col("word").isin(*BLOCKED_WORDS)
    total = seen.agg(F.sum("b").alias("sum_b"), F.sum(F.when(~bad, F.col("a")).otherwise(0)).alias("sum_a"), F.count(F.lit(1)).alias("v"))
    model = seen.crossJoin(F.broadcast(total))  # one row
    blocked = F.col("b") + F.when(bad, F.col("sum_b") * BLOCKED_SHARE).otherwise(0.0)
    others = F.when(bad, F.lit(0)).otherwise(F.col("a"))
    sum_b = F.col("sum_b") * (1 + BLOCKED_SHARE * len(BLOCKED_WORDS))
    model = model.select("word", (F.log((blocked + 1) / (sum_b + F.col("v"))) - F.log((others + 1) / (F.col("sum_a") + F.col("v")))).alias("weight"))
    odds = each.join(model, "word").groupBy("host", "shape").agg(F.sum("weight").alias("odds"))
    odds = odds.select(F.col("host").alias("h"), F.col("shape").alias("s"), "odds")
    scored = parsed.join(odds, (F.col("host") == F.col("h")) & (F.col("shape") == F.col("s")), "left")
    by_words = F.when(F.coalesce("odds", F.lit(0.0)) > math.log(ODDS), "block").otherwise("allow")
    return scored.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("ruling", by_words).alias("verdict"), F.round("odds", 6).alias("odds"))
