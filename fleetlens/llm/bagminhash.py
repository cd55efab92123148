"""Operator 4: near-duplicates by weighted MinHash of shingle multisets.

A text is the multiset of its shingles (five words; a text of one to four
words is one shingle).  Two texts are near-duplicates if the sum of the
smaller counts is at least 0.8 times the sum of the larger ones.

Signatures (BagMinHash): every shingle owns a random stream of points in
time and weight.  Weights are split into the intervals [0, 1), [1, 2), [2, 4),
[4, 8), ...; each has a Poisson process of its own whose points come in order
of time, so a process is followed only while it can still lower a component.
A point counts for a text if its weight lies below the shingle's count there.
Each point falls on a random component; a component keeps the earliest.  Two
texts agree in a component with exactly their weighted Jaccard similarity.

Candidates: texts whose signatures agree in one band of ``ROWS`` components.
Texts of equal multisets are one node.  In every bucket all nodes are
compared with one hub: first each node with the least of its hubs, then,
where the classes still differ, with its other hubs.  Sketches (one byte of
each component) spare the comparison of pairs that agree in less than
``AGREE`` of 160, five standard deviations below a similarity of 0.8.  A group
of copies is one class after that, and its buckets need no more comparison.

What is left are buckets that still hold several classes, like those of a
passage in many otherwise different texts.  Their nodes are compared exactly:
the shingles of these nodes have one order, the rarest first, and two
similar texts must share one of the first ``size - 0.8 size + 1``.  A passage
that many texts hold is no rare shingle of any of them unless it is nearly the
whole text.  Of the pairs of different classes that share such a shingle, those
are compared that no bound rules out: behind the first shingle two texts share
there must be enough left in both, and the parities of their shingles, counted
by kind, must not differ in more kinds than the texts may in shingles.  Both
bounds are exact.  A crowd of near copies would have a number of such pairs
that grows with its square; so every rare shingle's texts are first compared
with the one that has the least of its own, then the closest pair of every two
classes, and the rest only where the classes still differ.  No similar pair of
a bucket is lost, whatever its sketches say.

Texts without a word are equal only to the same text.  Null is the empty
text.  Rows of one id and text are one node too; null ids take part and are
never the name of a class unless it has no other.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import ship

from . import common, components, wordhash

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 5
SIZE = BANDS * ROWS
#: Components that the sketches of a similar pair share at least: 128 are expected, the deviation is 5.
AGREE = 101
#: Words of 64 parities that tell apart pairs of packed multisets.
PARITIES = tuple(f"parity{k}" for k in range(8))
#: Items that stand directly before one in its node's order; a pair that shares one of them has met there.
EARLIER = 8

TICKS = 1 << 36  # of the unit of time
NEVER = np.iinfo(np.int64).max
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(0xD1B54A32D192ED03)
_STEP = np.uint64(0x8CB92BA72F3D8DD7)


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), sorted by text and shingle."""
    words, begins = wordhash.hashes(texts)
    sizes = np.diff(begins)
    n = len(words)
    full = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        full = (full ^ words[k : k + len(full)]) * _GOLD + _STEP
        full ^= full >> np.uint64(29)
    full = wordhash.mix(full)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(full)) + SHINGLE <= np.repeat(begins[1:], sizes)[: len(full)]
    text, value = owner[: len(full)][inside], full[inside]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        own = []
        for t in short.tolist():
            x = np.uint64(sizes[t])
            with np.errstate(over="ignore"):
                for w in words[begins[t] : begins[t + 1]]:
                    x = (x ^ w) * _GOLD + _LEVEL
            own.append(x)
        text, value = np.concatenate([text, short]), np.concatenate([value, wordhash.mix(np.array(own, np.uint64))])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text)))


def _uniform(seed: np.ndarray, step: np.ndarray, which: int) -> np.ndarray:
    return wordhash.mix(seed + (step.astype(np.uint64) * np.uint64(4) + np.uint64(which)) * _STEP)


def signatures(text: np.ndarray, value: np.ndarray, count: np.ndarray, n_texts: int, size: int = SIZE) -> np.ndarray:
    """Earliest point of each component for each text; ``NEVER`` for texts without shingles."""
    best = np.full(n_texts * size, NEVER)
    total = np.bincount(text, count, n_texts)
    levels = int(np.ceil(np.log2(count.max(initial=1)))) + 1
    for level in range(levels):
        base, width = (0, 1) if level == 0 else (1 << level - 1, 1 << level - 1)
        active = np.flatnonzero(count > base)
        owner, seed, weight = text[active], wordhash.mix(value[active] + np.uint64(level * int(_LEVEL) % (1 << 64))), count[active]
        clock, done = np.zeros(len(active), np.int64), np.zeros(len(active), np.int64)
        # the first points at once: about as many as fill a text's components
        first = np.maximum(1, np.ceil(size * (np.log(size) + 2) / total[owner] if len(owner) else total[:0])).astype(np.int64)
        while len(owner):
            row = np.repeat(np.arange(len(owner)), first)
            begin = np.cumsum(first) - first
            step = done[row] + np.arange(len(row)) - begin[row]
            draw = (_uniform(seed[row], step, 0) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            wait = (-np.log1p(-draw) * (TICKS / width)).astype(np.int64)  # whole ticks: sums don't depend on the order
            run = np.cumsum(wait)
            time = clock[row] + run - (run[begin] - wait[begin])[row]
            component = (_uniform(seed[row], step, 1) >> np.uint64(32)) % np.uint64(size)
            if width > 1:
                at = base + (_uniform(seed[row], step, 2) % np.uint64(width)).astype(np.int64)
                counted = at < weight[row]
            else:
                counted = slice(None)
            np.minimum.at(best, (owner[row] * size + component.astype(np.int64))[counted], time[counted])
            clock = time[begin + first - 1]
            done += first
            latest = best.reshape(n_texts, size).max(axis=1)
            going = clock < latest[owner]
            owner, seed, weight, clock, done = owner[going], seed[going], weight[going], clock[going], done[going]
            first = np.ones(len(owner), np.int64)
    return best.reshape(n_texts, size)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each text and band."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _LEVEL, bits.shape[:2])
    for k in range(ROWS):
        key = wordhash.mix(key ^ bits[:, :, k]) + _GOLD
    return key


def fingerprints(texts: list[bytes | None], text: np.ndarray, value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One number for each multiset; of the raw bytes if there is no word."""
    parts = wordhash.mix(value ^ wordhash.mix(count.astype(np.uint64)))
    out = np.zeros(len(texts), np.uint64)
    np.add.at(out, text, parts)
    out = wordhash.mix(out)
    for t in np.flatnonzero(np.bincount(text, minlength=len(texts)) == 0).tolist():
        out[t] = xxhash.xxh3_64_intdigest(texts[t] or b"", seed=1)
    return out


def pack(value: np.ndarray, count: np.ndarray) -> bytes:
    """A multiset as the sorted set of (shingle, occurrence) numbers."""
    which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.sort(wordhash.mix(np.repeat(value, count) + which.astype(np.uint64) * _GOLD)).tobytes()


def overlap(a: bytes, b: bytes) -> int:
    """Sum of the smaller counts of two packed multisets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


# -- Spark


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("key"), F.xxhash64(whole).alias("text_key"), whole.alias("text"))


def sign(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_key, node, size, bands, sketch) of every row."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in common.slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            owner, value, count = shingles(texts)
            signature = signatures(owner, value, count, len(texts))
            keys = band_keys(signature).view(np.int64)
            sketch = pa.array([row.tobytes() for row in wordhash.mix(signature.view(np.uint64)).astype(np.uint8)], pa.binary())
            size = np.bincount(owner, count, len(texts)).astype(np.int64)
            ends = np.cumsum([0, *np.where(size > 0, BANDS, 0)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[size > 0].ravel()))
            node = pa.array(fingerprints(texts, owner, value, count).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("text_key"), node, pa.array(size), bands, sketch], ["key", "text_key", "node", "size", "bands", "sketch"])

    source = _texts(docs, key, text)
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, text_key long, node long, size long, bands array<long>, sketch binary")


def bags(texts: DataFrame) -> DataFrame:
    """(node, bag) from (node, text)."""

    def run(batches):
        for batch in common.slices(batches, "text"):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            owner, value, count = shingles(raw)
            cuts = np.searchsorted(owner, np.arange(len(raw) + 1))
            packed = [pack(value[a:b], count[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], ["node", "bag"])

    return texts.select("node", "text").mapInArrow(run, "node long, bag binary")


def verified(pairs: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets are similar."""

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                keep = []
                for a, b in zip(batch.column("bag_a").to_pylist(), batch.column("bag_b").to_pylist(), strict=True):
                    common_ = overlap(a, b)
                    keep.append(common_ >= similarity * ((len(a) + len(b)) // 8 - common_) - 1e-9)
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = bag.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    two = bag.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a long, b long")


def _sized(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose sizes allow the similarity, smaller node first, once each."""
    possible = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9
    return pairs.where(possible).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def alike(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule out the similarity."""
    least = AGREE - SIZE * (SIMILARITY - similarity) if similarity < SIMILARITY else AGREE

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIZE) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least, pa.bool_()))

    one = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    two = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are not of one class."""
    for side in ("a", "b"):
        found = classes.select(F.col("node").alias(side), F.col("class").alias(f"class_{side}"))
        pairs = pairs.join(found, side, "left").withColumn(f"class_{side}", F.coalesce(f"class_{side}", side))
    return pairs.where("class_a <> class_b").drop("class_a", "class_b")


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after more links."""
    if links.isEmpty():
        return classes
    return components.components(links.unionByName(classes.select(F.col("node").alias("a"), F.col("class").alias("b"))))


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows: key, text_key, node, size; classes: node, class for nodes in a class of more than one)."""
    signed = common.stage(sign(docs, key, text), "signatures")
    rows = signed.select("key", "text_key", "node", "size")
    nodes = common.stage(signed.where("size > 0").select("node", "size", "bands", "sketch").dropDuplicates(["node"]), "nodes")
    entries = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    hubs = entries.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = common.stage(entries.join(hubs.drop("n"), "bucket"), "members")
    bag = common.stage(_bags_of(members.select("node").distinct(), rows, _texts(docs, key, text)), "bags")

    sizes = members.where("node = hub").select("hub", F.col("size").alias("size_b")).distinct()
    stars = members.where("node <> hub").select("node", "size", "hub").distinct().join(sizes, "hub")
    stars = _sized(stars.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("hub").alias("b"), "size_b"), similarity)
    near = common.stage(alike(stars, nodes.select("node", "sketch"), similarity), "pairs")  # a is the hub: it is the least of its bucket
    first = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    classes = components.components(common.stage(verified(first, bag, similarity), "edges"))
    others = _apart(near.join(first, ["a", "b"], "left_anti"), classes)
    classes = _joined(classes, common.stage(verified(others, bag, similarity), "edges"))

    at = _classed(members.select("bucket", "node", "size"), classes)
    left = common.stage(at.join(_live(at), "bucket").select("node", "size", "class").distinct().join(bag, "node"), "left")
    ranks = common.stage(ranked(left, similarity), "ranks")
    central = common.stage(central_pairs(ranks, similarity), "pairs")
    classes = _joined(classes, common.stage(verified(central, bag, similarity), "edges"))
    rest = common.stage(_met(_classed(ranks.drop("class"), classes), similarity), "pairs")
    closest = rest.groupBy("one", "two").agg(F.min(F.struct("apart", "a", "b")).alias("pair")).select("pair.a", "pair.b")
    classes = _joined(classes, common.stage(verified(closest, bag, similarity), "edges"))
    others = _apart(rest.select("a", "b").join(closest, ["a", "b"], "left_anti"), classes)
    classes = _joined(classes, common.stage(verified(others, bag, similarity), "edges"))
    common.discard(nodes, members, near, bag, left, ranks, central, rest)
    return rows, classes


def _bags_of(nodes: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, bag) of some nodes, each from one of its texts."""
    named = rows.groupBy("node").agg(F.min(F.struct("text_key", "key")).alias("one"))
    some = named.select("node", F.col("one.text_key").alias("k"), F.col("one.key").alias("i")).join(nodes, "node")
    wanted = texts.join(some, (F.col("text_key") == F.col("k")) & F.col("key").eqNullSafe(F.col("i")))
    return bags(wanted.dropDuplicates(["node"]))


def _classed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members with their class so far; a node without links is its own."""
    return members.join(classes.withColumnRenamed("class", "found"), "node", "left").withColumn("class", F.coalesce("found", "node")).drop("found")


def _live(at: DataFrame) -> DataFrame:
    """The buckets that hold several classes."""
    return at.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("bucket")


def _items(nodes: DataFrame) -> DataFrame:
    """(node, size, class, item): every (shingle, occurrence) of packed multisets."""

    def run(batches):
        for batch in batches:
            for k, bag in enumerate(batch.column("bag").to_pylist()):
                items = np.frombuffer(bag, np.int64)
                for start in range(0, len(items), 1 << 16):
                    some = pa.array(items[start : start + (1 << 16)])
                    own = [pa.repeat(batch.column(c)[k], len(some)) for c in ("node", "size", "class")]
                    yield pa.RecordBatch.from_arrays([*own, some], ["node", "size", "class", "item"])

    return nodes.select("node", "size", "class", "bag").mapInArrow(run, "node long, size long, class long, item long")


def _parities(nodes: DataFrame) -> DataFrame:
    """(node, parity0, ...): for each of 512 kinds of items, whether a packed multiset has an odd number of them."""
    kinds = 64 * len(PARITIES)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bags_ = [np.frombuffer(bag, np.uint64) for bag in batch.column("bag").to_pylist()]
            odd = np.stack([np.bincount((bag % np.uint64(kinds)).astype(np.int64), minlength=kinds) & 1 for bag in bags_])
            words = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(w) for w in words.T)], ["node", *PARITIES])

    return nodes.select("node", "bag").mapInArrow(run, "node long, " + ", ".join(f"{p} long" for p in PARITIES))


def ranked(nodes: DataFrame, similarity: float) -> DataFrame:
    """(item, node, size, class, place, own, earlier, parities): the rarest items of nodes (node, size, class, bag).

    Items that one node has alone stand first in its order, so only the shared
    ones are ranked; ``own`` is the share of the others.  ``earlier`` holds
    the shared items right before this one.
    """
    items = _items(nodes)
    shared = items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mine = Window.partitionBy("node")
    alone = F.col("size") - F.count(F.lit(1)).over(mine)
    placed = items.join(shared, "item").withColumn("alone", alone).withColumn("place", F.col("alone") + F.row_number().over(mine.orderBy("n", "item")))
    most = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    before = F.collect_list("item").over(mine.orderBy("n", "item").rowsBetween(-EARLIER, -1))
    prefix = placed.where(F.col("place") <= most).withColumn("earlier", before).withColumn("own", F.col("alone") / F.col("size"))
    return prefix.join(_parities(nodes), "node").select("item", "node", "size", "class", "place", "own", "earlier", *PARITIES)


def _side(ranks: DataFrame, end: str, *more: str) -> DataFrame:
    return ranks.select("item", *(F.col(c).alias(f"{c}_{end}") for c in ("node", "size", "class", "place", *more, *PARITIES)))


def _differing() -> Column:
    """Kinds of items of which one of two nodes has an odd and the other an even number."""
    return functools.reduce(operator.add, (F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITIES))


def _possible(similarity: float) -> Column:
    """Whether two nodes may be similar whose first common item is this one.

    By their sizes, by what is left from that item on, and because multisets
    of differing parities differ in as many items at least.
    """
    both = F.col("size_a") + F.col("size_b")
    sizes = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) + 1
    return sizes & (left * (1 + similarity) >= both * similarity - 1e-6) & (_differing() * (1 + similarity) <= both * (1 - similarity) + 1e-6)


def central_pairs(ranks: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of an item's most central node, that with the least share of its own, and those of other classes."""
    least = F.min(F.struct("own", "node", "size", "class", "place", *PARITIES)).alias("least")
    hubs = ranks.groupBy("item").agg(least, F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("item", "least.*")
    pairs = _side(ranks, "a").join(_side(hubs, "b"), "item").where(F.col("class_a") != F.col("class_b")).where(_possible(similarity))
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _met(ranks: DataFrame, similarity: float) -> DataFrame:
    """(a, b, one, two, apart): possible pairs of nodes of classes one and two, at their first common item.

    In an item's group the nodes of its largest class meet those of other
    classes only, and are never paired with each other.
    """
    counts = ranks.groupBy("item", "class").agg(F.count(F.lit(1)).alias("m"))
    largest = counts.groupBy("item").agg(F.max(F.struct("m", "class")).alias("most"), F.count(F.lit(1)).alias("classes"))
    largest = largest.where("classes > 1").select("item", F.col("most.class").alias("largest"))
    held = ranks.join(largest, "item")
    left, right = _side(held.where("class <> largest"), "a", "earlier"), _side(held.withColumn("top", F.col("class") == F.col("largest")), "b", "earlier", "top")
    pairs = left.join(right, "item").where("class_a <> class_b AND (top_b OR node_a < node_b)").where(_possible(similarity))
    first = pairs.where(~F.arrays_overlap("earlier_a", "earlier_b"))
    ends = (F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    between = (F.least("class_a", "class_b").alias("one"), F.greatest("class_a", "class_b").alias("two"))
    return first.select(*ends, *between, (_differing() / (F.col("size_a") + F.col("size_b"))).alias("apart")).distinct()


def rare_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes (node, size, class, bag) of different classes that share one of their rarest items and may be similar."""
    return _met(ranked(nodes, similarity), similarity).select("a", "b")


def classes_of(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, text_key, class, class_id, class_size, size): class_id is the least key of the class; classes may share one that has several texts."""
    rows, classes = link(docs, key, text, similarity)
    named = rows.join(classes, "node", "left").select("key", "text_key", "size", F.coalesce("class", "node").alias("class"))
    least = named.groupBy("class").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return named.join(least, "class").select("key", "text_key", "class", "class_id", "class_size", "size")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its class, the class's size, its number of shingles, whether it names the class."""
    found = classes_of(docs)
    return found.select(F.col("key").alias("doc_id"), "class_id", "class_size", F.col("size").alias("n_shingles"), F.col("key").eqNullSafe(F.col("class_id")).alias("representative"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, the one with the least key, all columns in place.

    Equal rows of that key and text count as one; of different texts under
    one key and class the one of least hash stays.
    """
    chosen = classes_of(docs, key, text).where(F.col("key").eqNullSafe(F.col("class_id")))
    named = chosen.groupBy("class", F.col("key").alias("_key")).agg(F.min("text_key").alias("_text_key"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    texts = docs.select(whole, F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_key"))
    kept = texts.join(named, F.col("key").eqNullSafe(F.col("_key")) & (F.col("text_key") == F.col("_text_key")))
    first = kept.withColumn("n", F.row_number().over(Window.partitionBy("key", "text_key").orderBy("text_key"))).where("n = 1")
    return first.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
