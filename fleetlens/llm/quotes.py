"""Operator 9: conversations in reply order, linked through their quotations.

A line that begins with ``>`` signs (blanks between them allowed) is quoted,
its level is their number.  Lines are hashed after normalising (lower case,
single blanks, no outer blanks).  Consecutive quoted lines of one level are a
passage, blank ones apart; it is joined to the latest earlier message of the
same conversation that holds all its lines in a row in its own text, and
votes for it with every line.  Of a passage that stands nowhere as a whole,
each line votes for the latest earlier message that holds it.  Level by
level the message with most votes, the latest of equals, is quoted.  A
message replies to the one quoted at its lowest level with a known line;
deeper levels give further ancestors: the message quoted at one level, if it
has no known quotation itself, replies to the earlier message quoted at the
next.  All other messages begin a thread.  Threads are ordered by their first
turn, inside by reply depth, then turn.

A (conversation, line) may be hot, so the search for the latest earlier
holder runs over blocks of turns: the latest of all earlier blocks, then
inside the block.  Reply chains are followed by doubling, so the rounds grow
with the logarithm of their length, and only linked messages take part.  No
Python.

Null texts are empty; null conversations are one conversation; null turns
come before all others; rows of equal conversation and turn are one message
for links but each keeps its row; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.regexkit import once

from . import common

BLOCK = 256  # turns in a block
MARKS = r"^[ \t]*(>[ \t]*)+"


def level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def normal(line: Column) -> Column:
    """Hash of a line without its quote marks; null if nothing is left."""
    bare = F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"\s+", " ")))
    return F.when(bare != "", F.xxhash64(bare))


def parsed(messages: DataFrame) -> DataFrame:
    """(row, conv, turn, role, body, lines array<level, hash>): the text without quotes, and its lines."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    rows = messages.select(F.col("conv_id").alias("conv"), F.col("turn"), F.col("role"), lines.alias("raw"))
    return rows.select(
        "conv",
        "turn",
        "role",
        F.trim(F.array_join(F.filter("raw", lambda x: ~x.rlike(MARKS)), "\n")).alias("body"),
        F.transform("raw", lambda x: F.struct(level(x).alias("level"), normal(x).alias("hash"))).alias("lines"),
    )


def runs(messages: DataFrame) -> DataFrame:
    """(conv, turn, own array<hash>, quoted array<level, hashes>): a message's own lines and its quoted passages, in order, without blank lines."""
    rows = messages.where("turn IS NOT NULL").select("conv", F.col("turn").cast("long").alias("turn"), "lines")
    rows = once(rows, "lines_", F.col("lines")).select("conv", "turn", F.col("lines_").alias("lines"))
    changed = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda k: F.coalesce(F.get("lines", k)["level"] != F.get("lines", k - 1)["level"], F.lit(True)))
    rows = once(rows, "begins", changed)

    def passage(begin: Column, place: Column) -> Column:
        end = F.coalesce(F.get("begins", place + 1), F.size("lines"))
        return F.struct(F.get("lines", begin)["level"].alias("level"), hashes(F.slice("lines", begin + 1, end - begin)).alias("hashes"))

    def hashes(lines: Column) -> Column:
        return F.filter(F.transform(lines, lambda x: x["hash"]), lambda x: x.isNotNull())

    quoted = F.filter(F.transform("begins", passage), lambda x: (x["level"] > 0) & (F.size(x["hashes"]) > 0))
    return rows.select("conv", "turn", hashes(F.filter("lines", lambda x: x["level"] == 0)).alias("own"), quoted.alias("quoted"))


def latest(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(conv, hash, turn, source): for each (conv, hash, turn) of ``asked`` the latest earlier turn of ``held``, if there is one."""
    asked = asked.select("conv", "hash", "turn").distinct()
    wanted = asked.select(F.col("conv").alias("c"), F.col("hash").alias("h")).distinct()
    held = held.select("conv", "hash", "turn").distinct().join(wanted, F.col("conv").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h")), "left_semi")
    none = F.lit(None).cast("long")
    events = asked.withColumn("asks", F.lit(True)).withColumn("source", none).unionByName(held.withColumn("asks", F.lit(False)).withColumn("source", F.col("turn")))
    events = events.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy("conv", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    blocks = events.groupBy("conv", "hash", "block").agg(F.max("source").alias("last"))
    earlier = Window.partitionBy("conv", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv").alias("c"), F.col("hash").alias("h"), F.col("block").alias("b"), F.max("last").over(earlier).alias("before"))
    events = events.withColumn("here", F.max("source").over(inside)).where("asks")
    found = events.join(blocks, F.col("conv").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h")) & (F.col("block") == F.col("b")), "left")
    return found.select("conv", "hash", "turn", F.coalesce("here", "before").alias("source")).where("source IS NOT NULL")


def spans(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv, hash, turn): the runs of own lines that begin with the first line of an asked passage and have its length."""
    wanted = asked.select(F.col("conv").alias("c"), F.col("hashes")[0].alias("first"), "n").distinct()
    texts = texts.withColumn("key", F.xxhash64("own"))
    lines = texts.select("conv", "turn", "key", F.size("own").alias("size"), F.posexplode("own").alias("at", "line"))
    begins = lines.join(wanted, F.col("conv").eqNullSafe(F.col("c")) & (F.col("line") == F.col("first"))).where(F.col("at") + F.col("n") <= F.col("size"))
    begins = begins.groupBy(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("key").alias("k")).agg(F.collect_list(F.struct("at", "n")).alias("begins"))
    found = texts.join(begins, F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")) & (F.col("key") == F.col("k")))
    found = found.select("conv", "turn", "own", F.explode("begins").alias("begin"))
    return found.select("conv", F.xxhash64(F.slice("own", F.col("begin.at") + 1, F.col("begin.n"))).alias("hash"), "turn")


def links(messages: DataFrame) -> DataFrame:
    """(conv, turn, parent): the message each quoting message replies to, and those that deeper levels add."""
    rows = common.stage(runs(messages), "passages")
    asked = rows.select("conv", "turn", F.inline("quoted")).withColumn("n", F.size("hashes")).withColumn("hash", F.xxhash64("hashes"))
    texts = rows.select("conv", "turn", "own").distinct()
    known = latest(asked, spans(texts, asked))
    known = known.select(F.col("conv").alias("c"), F.col("hash").alias("h"), F.col("turn").alias("t"), "source")
    here = F.col("conv").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h")) & (F.col("turn") == F.col("t"))
    asked = common.stage(asked.join(known, here, "left").select("conv", "turn", "level", "hashes", "n", "source"), "asked")
    lines = asked.where("source IS NULL").select("conv", "turn", "level", F.explode("hashes").alias("hash"))
    single = latest(lines, rows.select("conv", "turn", F.explode("own").alias("hash")))
    single = single.select(F.col("conv").alias("c"), F.col("hash").alias("h"), F.col("turn").alias("t"), "source")
    single = lines.join(single, here).select("conv", "turn", "level", "source", F.lit(1).alias("n"))
    votes = asked.where("source IS NOT NULL").select("conv", "turn", "level", "source", "n").unionByName(single)
    votes = votes.groupBy("conv", "turn", "level", "source").agg(F.sum("n").alias("n"))
    best = votes.groupBy("conv", "turn", "level").agg(F.max(F.struct("n", "source")).alias("best")).select("conv", "turn", "level", F.col("best.source").alias("source"))
    best = common.stage(best, "quoted")
    linked = best.groupBy("conv", "turn").agg(F.min(F.struct("level", "source")).alias("best")).select("conv", "turn", F.col("best.source").alias("parent"))
    deeper = best.withColumn("parent", F.lead("source").over(Window.partitionBy("conv", "turn").orderBy("level"))).where("parent < source")
    deeper = deeper.groupBy("conv", "source", "parent").agg(F.count(F.lit(1)).alias("n")).groupBy("conv", "source").agg(F.max(F.struct("n", "parent")).alias("best"))
    own = linked.select(F.col("conv").alias("c"), F.col("turn").alias("t"))
    deeper = deeper.join(own, F.col("conv").eqNullSafe(F.col("c")) & (F.col("source") == F.col("t")), "left_anti")
    return linked.unionByName(deeper.select("conv", F.col("source").alias("turn"), F.col("best.parent").alias("parent")))


def threads(linked: DataFrame) -> DataFrame:
    """(conv, turn, parent, root, depth) of the linked messages, by pointer doubling."""
    now = common.stage(linked.select("conv", "turn", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        up = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"))
        joined = now.join(up, F.col("conv").eqNullSafe(F.col("c")) & (F.col("root") == F.col("t")), "left")
        if joined.where("t IS NOT NULL").isEmpty():
            return now
        after = joined.select("conv", "turn", "parent", F.coalesce("up_root", "root").alias("root"), (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"))
        now = common.stage(after, "replies")


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: whom it answers, its place (thread, depth, turn), its own text and the chat-formatted text."""
    rows = parsed(messages)
    found = threads(links(rows)).select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("parent"), "root", "depth")
    out = rows.join(found, F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left")
    levels = F.transform("lines", lambda x: x.level)
    return out.select(
        F.col("conv").alias("conv_id"),
        "turn",
        "role",
        F.size(F.filter("lines", lambda x: x.level > 0)).cast("long").alias("n_quoted"),
        F.coalesce(F.array_max(levels), F.lit(0)).cast("long").alias("max_level"),
        F.col("parent").cast("long").alias("reply_to"),
        F.coalesce("root", "turn").cast("long").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"), F.lit("\n")).alias("formatted"),
    )


ORACLE = r"""
WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS row_id, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS (SELECT row_id, conv_id, turn, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM raw),
p AS (SELECT *, regexp_extract(line, '^[ \t]*(>[ \t]*)+') AS marks FROM l),
q AS (SELECT *, length(marks) - length(replace(marks, '>', '')) AS level,
  lower(trim(regexp_replace(regexp_replace(line, '^[ \t]*(>[ \t]*)+', ''), '\s+', ' ', 'g'))) AS bare FROM p),
votes AS (
  SELECT a.conv_id, a.turn, (SELECT max(b.turn) FROM q b WHERE b.level = 0 AND b.bare = a.bare AND b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.turn < a.turn) AS source
  FROM q a WHERE a.level = 1 AND a.bare <> ''),
best AS (
  SELECT conv_id, turn, arg_max(source, n * 1000000000::HUGEINT + source) AS parent
  FROM (SELECT conv_id, turn, source, count(*) AS n FROM votes WHERE source IS NOT NULL GROUP BY ALL) x GROUP BY conv_id, turn),
walk AS (
  SELECT conv_id, turn, parent AS root, 1 AS depth FROM best
  UNION ALL
  SELECT w.conv_id, w.turn, b.parent, w.depth + 1 FROM walk w JOIN best b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.turn = w.root),
ends AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM walk GROUP BY conv_id, turn),
m AS (
  SELECT row_id, count(*) FILTER (level > 0) AS n_quoted, max(level) AS max_level,
    trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0), '')) AS body FROM q GROUP BY row_id)
SELECT r.conv_id, r.turn, r.role, m.n_quoted::BIGINT AS n_quoted, m.max_level::BIGINT AS max_level, b.parent::BIGINT AS reply_to,
  coalesce(e.root, r.turn)::BIGINT AS thread, coalesce(e.depth, 0)::BIGINT AS depth,
  '<|' || coalesce(r.role, '') || '|>' || chr(10) || m.body || chr(10) AS formatted
FROM raw r JOIN m USING (row_id) LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND b.turn = r.turn
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.turn = r.turn
"""
