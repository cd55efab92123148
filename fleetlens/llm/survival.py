"""Operator 12: what filters do alone, together and in every order.

``failures`` tests each filter once per document and sets one bit for every
filter that it fails.  Its truth table is a 32-bit word: bit S is set if the
document survives the subset S of the filters, i.e. fails none of them.  Words
of one part and label are added up by carry-save adders, a word per binary
digit, which gives for each of the 32 subsets how many documents survive it.
Every order of the filters, what each step removes and what it would have
removed, follows from these 32 counts alone; no text is read twice.

Filters: A under 50 words; B under 65 distinct words in 100; C over 5 capital
letters A-Z in 100 characters; D any of ``#$%&*|``; E the same text under a
smaller id, anywhere in the table.

Null texts are empty: they fail A and, after the first, E.  A null source is
the part ``''``.  A null id is neither smaller nor greater than another, so it
never fails E and has no label.  Rows that repeat an id and text count each
and do not fail E by one another.  Several labels of an id: one that says 1 is
enough.  An empty table has no parts and gives no rows; columns other than
those named are not read, whatever their names.

Rows that reach a shuffle are narrow (id, text digest, part, bits).  Hot texts
meet only in a partial minimum; the first of each text is found by the key
(digest, id), which no group of copies makes hot; the join with labels is
salted, so that a repeated id is split.  Both joins are told to merge: either
side grows with the input, and the size of files, by which Spark would send a
table through the driver, says little of the rows that come of it.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import ship

from . import common

LETTERS = "ABCDE"
SUBSETS = 1 << len(LETTERS)
ORDERS = ["".join(p) for p in permutations(LETTERS)]
BLANK = " \t\n\x0b\f\r"
#: Documents of one id that are joined with its label apart.
SALTS = 8
#: Groups whose counts a task keeps before it sends them on.
KEPT = 10_000
#: Truth table of a document by its failure bits.
WORD = np.array([sum(1 << s for s in range(SUBSETS) if s & bits == 0) for bits in range(SUBSETS)], np.uint32)


def own_failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(key, part, digest, bits) of every row: the filters that look at one text only."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    bare = F.btrim("text", F.lit(BLANK))
    rows = rows.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\x0B\f\r]+")))
    n = F.size("words")
    capitals = F.octet_length(F.regexp_replace("text", "[^A-Z]+", ""))
    tests = [n < 50, 100 * F.size(F.array_distinct("words")).cast("long") < 65 * n.cast("long"), 100 * capitals.cast("long") > 5 * F.length("text").cast("long"), F.rlike("text", F.lit("[#$%&*|]"))]
    return rows.select("key", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _bits(tests).alias("bits"))


def _bits(tests: list[Column]) -> Column:
    bits = F.lit(0)
    for k, test in enumerate(tests):
        bits = bits + F.when(test, F.lit(1 << k)).otherwise(F.lit(0))
    return bits


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(key, part, digest, bits, n): all five filters; equal rows as one with their number."""
    own = common.stage(own_failures(docs, key, text, part), "failures")
    rows = own.groupBy("key", "part", "digest", "bits").agg(F.count(F.lit(1)).alias("n"))
    first = own.groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    late = F.col("key").isNotNull() & F.col("first").isNull()
    bits = F.col("bits") + F.when(late, F.lit(1 << LETTERS.index("E"))).otherwise(F.lit(0))
    return rows.join(first.hint("merge"), ["digest", "key"], "left").select("key", "part", "digest", bits.alias("bits"), "n")


def labelled(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with ``good`` and ``toxic`` by the labels of their key."""
    marks = labels.groupBy(F.col(key).alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return salted.join(marks.hint("merge"), ["key", "salt"], "left").select(*rows.columns, *flags)


def popcounts(words: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each of the 32 bits is set in ``words``, word i counted ``times[i]`` times.

    Three words of one weight become one of that weight and one of twice the
    weight, a full adder for all 32 bits at once, until each weight has one.
    """
    levels = [words[times >> k & 1 == 1] for k in range(int(times.max(initial=0)).bit_length())]
    counts = np.zeros(SUBSETS, np.int64)
    weight = 0
    while weight < len(levels):
        level, carried = levels[weight], []
        while len(level) > 1:
            third = max(1, len(level) // 3)
            a, b, rest = level[:third], level[third : 2 * third], level[2 * third :]
            c = rest[:third] if len(level) > 2 else np.zeros(third, np.uint32)
            either = a ^ b
            carried.append(a & b | either & c)
            level = np.concatenate([either ^ c, rest[third:]])
        if carried:
            if weight + 1 == len(levels):
                levels.append(np.empty(0, np.uint32))
            levels[weight + 1] = np.concatenate([levels[weight + 1], *carried])
        if len(level):
            counts += (level[0].astype(np.int64) >> np.arange(SUBSETS) & 1) << weight
        weight += 1
    return counts


def survivors(rows: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): documents of each part that survive each subset of the filters."""
    ship(rows.sparkSession)

    def send(held):
        keys = list(held)
        counts = pa.array([held[k].tolist() for k in keys], pa.list_(pa.int64()))
        columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.bool_(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([*columns, counts], ["part", "good", "toxic", "counts"])

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            good, toxic = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("good", "toxic"))
            group = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + good * 2 + toxic
            words = WORD[batch.column("bits").to_numpy()]
            times = batch.column("n").to_numpy()
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            for start, end in zip(starts, [*starts[1:], len(order)], strict=True):
                rows = order[start:end]
                code = int(group[rows[0]])
                name = parts.dictionary[code >> 2].as_py(), bool(code & 2), bool(code & 1)
                counts = popcounts(words[rows], times[rows])
                held[name] = held[name] + counts if name in held else counts
            if len(held) > KEPT:
                yield send(held)
                held = {}
        if held:
            yield send(held)

    source = rows.select("part", "good", "toxic", "bits", "n")
    counted = source.mapInArrow(run, "part string, good boolean, toxic boolean, counts array<long>")
    each = counted.select("part", "good", "toxic", F.posexplode("counts").alias("subset", "n"))
    return each.groupBy("part", "subset").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def audit(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from the survivors of every subset."""
    table = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("t"))  # 32 entries each
    table = table.select("part", *(F.col(f"t.{c}").alias(c) for c in ("n", "good", "toxic")))
    table = table.withColumn("shapleys", F.array(*(_shapley(F.col("n"), 1 << k) for k in range(len(LETTERS)))))
    rows = table.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    place = [F.instr("filter_order", letter) for letter in LETTERS]
    rows = rows.withColumn("before", _bits([p < F.col("step") for p in place])).withColumn("bit", _bits([p == F.col("step") for p in place]))
    after = F.col("before") + F.col("bit")
    removed = F.get("n", F.col("before")) - F.get("n", after)
    everything = SUBSETS - 1
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("n", after).alias("kept"),
        removed.alias("removed"),
        (F.get("n", F.lit(0)) - F.get("n", F.col("bit")) - removed).alias("redundant"),
        (F.get("n", F.lit(everything) - F.col("bit")) - F.get("n", F.lit(everything))).alias("unique_fails"),
        (F.get("good", F.col("before")) - F.get("good", after)).alias("good_lost"),
        (F.get("toxic", F.col("before")) - F.get("toxic", after)).alias("toxic_lost"),
        F.get("shapleys", F.log2("bit").cast("int")).alias("shapley"),
    )


def _shapley(n: Column, bit: int) -> Column:
    """What a filter removes, summed over all orders: each subset before it in as many orders as there are of its two sides."""
    sizes = [1, 1, 2, 6, 24]
    total = F.lit(0).cast("long")
    for subset in range(SUBSETS):
        if not subset & bit:
            size = subset.bit_count()
            total = total + sizes[size] * sizes[len(LETTERS) - 1 - size] * (F.get(n, F.lit(subset)) - F.get(n, F.lit(subset | bit)))
    return total


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over documents (doc_id, text, source) with labels (doc_id, quality, toxic)."""
    return audit(survivors(labelled(failures(docs), labels)))


#: The same by counting each order's steps over the distinct failure bits.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
lows AS (SELECT t, min(doc_id) AS lo FROM d GROUP BY t),
w AS (
  SELECT d.doc_id, part, d.t, coalesce(d.doc_id > lo, false) AS e,
    list_filter(string_split_regex(d.t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM d JOIN lows USING (t)),
m AS (
  SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * e::INT AS m FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
g AS (
  SELECT part, m, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a JOIN x b ON a.c <> b.c JOIN x c ON c.c NOT IN (a.c, b.c)
  JOIN x d ON d.c NOT IN (a.c, b.c, c.c) JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
s AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS letter FROM o, range(1, 6) r(step)),
k AS (
  SELECT filter_order, step, letter, (1 << (ascii(letter) - 65)) AS bit,
    list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))) AS b FROM s),
r AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER ((m & (before | bit)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER ((m & before) = 0 AND (m & bit) <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((m & before) <> 0 AND (m & bit) <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (m = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER ((m & before) = 0 AND (m & bit) <> 0 AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER ((m & before) = 0 AND (m & bit) <> 0 AND toxic), 0)::BIGINT AS toxic_lost
  FROM g, (SELECT * EXCLUDE (b, bit), bit::INT AS bit, coalesce(b, 0)::INT AS before FROM k) k GROUP BY ALL)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
