"""Operator 6: quality rules as a ledger of bits.

``ledger`` measures a text once and sets one bit for every rule that it
fails.  A policy is a version with the set of rules that count; applying it
is one bit operation, and ``ablation`` reads off the same bits what each rule
costs alone and together, so texts are never measured again for a new policy.

All of it is column expressions over one row: no shuffle, no Python.  Null
texts have no words and fail ``few_words``; other columns keep their names
and values, measurements are in one struct column so that none can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\f\r"
#: Rules in the order of their bits.
RULES = ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "shouting")


@dataclass(frozen=True)
class Policy:
    """A version and the rules whose failure rejects a text."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
PRODUCTION = Policy("2", RULES)


def measured(docs: DataFrame, text: str = "text", into: str = "ledger") -> DataFrame:
    """``docs`` with the struct column ``into``: all measurements and ``bits``."""
    if into.lower() in map(str.lower, docs.columns):
        raise ValueError(f"documents already have a column {into}")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    row = docs.select(own.alias("row"), whole.alias("text"))
    bare = F.btrim("text", F.lit(BLANK))
    row = row.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\x0B\f\r]+")))
    row = row.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BLANK)) != ""))
    row = row.withColumn("n_words", F.size("words").cast("long"))
    triples = F.when(
        F.col("n_words") > 3,
        F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
    )
    row = row.withColumn("triples", triples)
    placed = F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    row = row.withColumn("sorted", F.when(F.size(F.array_distinct("triples")) < F.size("triples"), F.sort_array(placed)))
    twice = F.filter("sorted", lambda x, k: (x.h == F.get("sorted", k - 1).h) | (x.h == F.get("sorted", k + 1).h))
    row = row.withColumn("places", F.sort_array(F.transform(twice, lambda x: x.i)))
    steps = F.zip_with("places", F.slice("places", 2, F.size("places")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)
    n_lines, n_words = F.size("lines").cast("long"), F.col("n_words")
    numbers = {
        "n_words": n_words,
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long"),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_exclaims": (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long"),
    }
    # behind a generator, so that no filter on the verdict copies the steps above into itself
    row = row.select("row", F.explode(F.array(F.struct(*(c.alias(n) for n, c in numbers.items())))).alias(into))
    return row.withColumn(into, F.col(into).withField("bits", failures(F.col(into)))).select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)), into)


def failures(m: Column) -> Column:
    """The bits of the rules that these measurements fail."""
    n = m.n_words
    failed = (
        n < 50,
        100 * m.n_repeat_words > 50 * n,
        10 * m.n_symbols > n,  # over one symbol in ten words
        10 * m.n_dup_lines > 3 * m.n_lines,
        (m.word_chars < 3 * n) | (m.word_chars > 12 * n),
        10 * m.n_exclaims > 5 * n,  # over one exclamation mark in two words
    )
    bits = F.lit(0).cast("long")
    for k, test in enumerate(failed):
        bits = bits + F.when(test, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return bits


def passes(policy: Policy, ledger: Column) -> Column:
    return ledger.bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(ledgers: DataFrame, policy: Policy, ledger: str = "ledger") -> DataFrame:
    """(version, rule, n_docs, n_failed, n_alone): documents that fail a rule, and that only this rule of the policy rejects.

    One pass of counts over the bits, as many result rows as rules.
    """
    bits = F.col(ledger).bits.bitwiseAND(F.lit(policy.mask).cast("long"))
    counts = [F.count(F.lit(1)).alias("n")]
    for rule in policy.rules:
        bit = F.lit(1 << RULES.index(rule)).cast("long")
        counts += [F.count_if(bits.bitwiseAND(bit) != 0).alias(f"f_{rule}"), F.count_if(bits == bit).alias(f"a_{rule}")]
    rows = [F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"a_{r}").alias("n_alone")) for r in policy.rules]
    spread = ledgers.agg(*counts).select("n", F.inline(F.array(*rows)))
    return spread.select(F.lit(policy.version).alias("version"), "rule", F.col("n").alias("n_docs"), "n_failed", "n_alone")


def keep(docs: DataFrame, policy: Policy = PRODUCTION, text: str = "text") -> DataFrame:
    """The documents that pass the policy, with their own columns."""
    name = "ledger"
    while name in map(str.lower, docs.columns):
        name += "_"
    return measured(docs, text, name).where(passes(policy, F.col(name))).select(*(F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """One row per document: the measurements, the bits and both verdicts."""
    m = F.col("ledger")
    return measured(docs.select("doc_id", "text")).select(
        "doc_id",
        "ledger.n_words",
        "ledger.word_chars",
        "ledger.n_symbols",
        "ledger.n_dup_lines",
        "ledger.n_repeat_words",
        (~passes(BASE, m)).alias("base_failed"),
        passes(policy, m).alias("kept"),
        "ledger.n_lines",
        "ledger.n_exclaims",
        F.col("ledger.bits").alias("failed_bits"),
    )


#: The same by lists in SQL.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
numbered AS (SELECT row_number() OVER () AS row_id, * FROM words),
spans AS (
  SELECT n.row_id, unnest(range(1, len(n.w) - 1)) AS i FROM numbered n),
grams AS (
  SELECT s.row_id, s.i, row(n.w[s.i], n.w[s.i + 1], n.w[s.i + 2]) AS t FROM spans s JOIN numbered n USING (row_id)),
twice AS (SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY row_id, t) AS c FROM grams) x WHERE c > 1),
covered AS (
  SELECT row_id, count(DISTINCT p) AS n FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS p FROM twice) x GROUP BY row_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclaims
  FROM numbered LEFT JOIN covered c USING (row_id)),
b AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (word_chars < 3 * n_words OR word_chars > 12 * n_words)::BIGINT
    + 32 * (10 * n_exclaims > 5 * n_words)::BIGINT)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
  failed_bits = 0 AS kept, n_lines, n_exclaims, failed_bits FROM b
"""
