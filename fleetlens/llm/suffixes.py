"""Operator 1: benchmark decontamination by suffix arrays of the training texts.

Every task cuts its documents into shards of bounded size and sorts all word
suffixes of a shard by prefix doubling, as deep as the longest benchmark
item.  Every suffix of every benchmark item is then narrowed down in the
array by binary search, word by word, all suffixes in step: the interval at
the window's length holds all places of that window, and the deepest interval
that holds a place is the longest verbatim match from there on, of any item.
Nothing is shuffled.

Benchmark texts are the query set.  They reach the tasks in blocks of bounded
size, each searched in every shard.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words,
but not none, is one window.  Words are compared by 64-bit hashes.  Null and
empty texts have no words and are never hit; repeated rows are judged each on
its own; an empty benchmark hits nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlens.session import ship

from . import common, wordhash

WINDOW = 10
SHARD_BYTES = 6 << 20  # text of a shard, or one longer document
BLOCK_WORDS = 1 << 20  # benchmark words of one broadcast block


class SuffixArray:
    """All word suffixes of some texts in order, compared to ``depth`` words at least."""

    def __init__(self, texts: list[bytes | None], depth: int):
        words, begins = wordhash.hashes(texts)
        self.n_words = np.diff(begins)
        #: after each text stands word 0, which no query holds
        self.begins = begins + np.arange(len(begins))
        n = len(words) + len(texts)
        place = np.arange(len(words)) + np.repeat(np.arange(len(texts)), self.n_words)
        order = np.argsort(words)
        ordered = words[order]
        fresh = np.ones(len(words), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        self.vocabulary = ordered[fresh]
        self.text = np.zeros(n, np.int64)
        self.text[place[order]] = np.cumsum(fresh)
        # sorted by the first word: the ends of texts, then the words
        ends = self.begins[1:] - 1
        self.suffixes = np.concatenate([ends, place[order]])
        rank = np.zeros(n + 1, np.int64)
        rank[ends] = 1
        starts = np.flatnonzero(fresh)
        self.first = np.concatenate([starts + len(ends), [n]])
        rank[place[order]] = np.repeat(starts, np.diff(np.append(starts, len(words)))) + len(ends) + 1
        self._refine(rank, depth, n, len(ends))

    def _refine(self, rank: np.ndarray, depth: int, n: int, ends: int) -> None:
        """Sort ties of ``known`` words by the next ``known`` words until ``depth`` is reached or no tie is left."""
        sa, known = self.suffixes, 1
        slots = np.arange(ends, n)
        while known < depth and len(slots):
            ranks = rank[sa[slots]]
            same = np.zeros(len(slots) + 1, bool)
            same[1:-1] = ranks[1:] == ranks[:-1]
            slots = slots[same[1:] | same[:-1]]
            if not len(slots):
                break
            some = sa[slots]
            key = rank[some] * (n + 2) + rank[np.minimum(some + known, n)]
            order = np.argsort(key)
            some, key = some[order], key[order]
            sa[slots] = some
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            rank[some] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
            known *= 2

    def find(self, words: np.ndarray, lengths: np.ndarray, starts: np.ndarray, stops: np.ndarray, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the query suffixes ``words[starts:starts + lengths]``: longest match in words, and the interval of all
        suffixes that begin with its first ``stops`` words (empty if it matches less).

        ``reach``, one number for each suffix of the array, is raised to its longest match of at least ``stops`` words."""
        at = np.searchsorted(self.vocabulary, words)
        known = at < len(self.vocabulary)
        known[known] = self.vocabulary[at[known]] == words[known]
        ids = np.where(known, at + 1, -1)
        longest = np.zeros(len(starts), np.int64)
        low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        alive = np.flatnonzero(ids[starts] > 0)
        lo, hi = self.first[ids[starts[alive]] - 1], self.first[ids[starts[alive]]]
        depth = 1
        while len(alive):
            longest[alive] = depth
            full = stops[alive] == depth
            low[alive[full]], high[alive[full]] = lo[full], hi[full]
            more = np.flatnonzero(lengths[alive] > depth)
            want = ids[starts[alive[more]] + depth]
            next_lo, next_hi = self._bound(lo[more], hi[more], depth, want), self._bound(lo[more], hi[more], depth, want + 1)
            match = (next_hi > next_lo) & (want > 0)
            if reach is not None:
                # suffixes that all go on are raised at a later depth
                last = (stops[alive] > 0) & (stops[alive] <= depth)
                last[more[match & (next_lo == lo[more]) & (next_hi == hi[more])]] = False
                self._raise(reach, lo[last], hi[last], depth)
            alive, lo, hi = alive[more[match]], next_lo[match], next_hi[match]
            depth += 1
        return longest, low, high

    @staticmethod
    def _raise(reach: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> None:
        """Intervals of one depth are equal or apart."""
        lo, at = np.unique(lo, return_index=True)
        sizes = hi[at] - lo
        slots = np.arange(sizes.sum()) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)
        reach[slots] = np.maximum(reach[slots], depth)

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray) -> np.ndarray:
        """First place in each interval whose word at ``depth`` is not below ``want``."""
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            middle = (lo[open_] + hi[open_]) >> 1
            below = self.text[self.suffixes[middle] + depth] < want[open_]
            lo[open_[below]] = middle[below] + 1
            hi[open_[~below]] = middle[~below]
            open_ = open_[lo[open_] < hi[open_]]
        return lo


def query_block(items: list[tuple], window: int) -> dict:
    """Suffixes of some items: their words, where each starts, how long it is, where its window ends."""
    words, begins = wordhash.hashes([t.encode() if t else None for _, t in items])
    sizes = np.diff(begins)
    owner = np.repeat(np.arange(len(items)), sizes)
    starts = np.arange(len(words))
    left = np.repeat(begins[1:], sizes) - starts
    whole = np.minimum(window, sizes)[owner]
    stops = np.where(left >= whole, whole, 0)  # 0: too short to be a window
    return {"words": words, "starts": starts, "lengths": left, "stops": stops, "owner": owner, "ids": [i for i, _ in items], "depth": int(sizes.max(initial=0))}


def query_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list:
    """Broadcast blocks of the benchmark, each of bounded size."""
    context = benchmark.sparkSession.sparkContext
    blocks, held, size = [], [], 0
    for row in benchmark.select(F.col(item).alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        held.append((row.i, row.t))
        size += len(row.t or "") // 2
        if size >= block_words:
            blocks.append(context.broadcast(query_block(held, window)))
            held, size = [], 0
    return [*blocks, *([context.broadcast(query_block(held, window))] if held else [])]


def judge(texts: list[bytes | None], blocks: list[dict]) -> dict[str, list]:
    """For each text: words, hit words, matching items, its longest verbatim match in words and where that starts, the first of equals."""
    array = SuffixArray(texts, max((b["depth"] for b in blocks), default=0))
    n = len(array.text)
    edges = np.zeros(n + 1, np.int64)
    items: list[set] = [set() for _ in texts]
    reach = np.zeros(n, np.int64)

    def spread(low, high):
        """Text places of all suffixes in the intervals, and the interval of each."""
        sizes = high - low
        k = np.repeat(np.arange(len(low)), sizes)
        return array.suffixes[np.arange(len(k)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)], k

    for block in blocks:
        _, low, high = array.find(block["words"], block["lengths"], block["starts"], block["stops"], reach)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        # one window may stand in many items: its places are spread out once
        spans, which = np.unique(np.stack([low[hit], high[hit], block["stops"][hit]]), axis=1, return_inverse=True)
        places, span = spread(spans[0], spans[1])
        np.add.at(edges, places, 1)
        np.add.at(edges, places + spans[2][span], -1)
        docs = np.searchsorted(array.begins, places, side="right") - 1
        of_span = [set() for _ in range(spans.shape[1])]
        for k, q in zip(which.ravel().tolist(), hit.tolist(), strict=True):
            of_span[k].add(block["ids"][block["owner"][q]])
        for d, k in zip(docs.tolist(), span.tolist(), strict=True):
            items[d] |= of_span[k]
    longest = np.zeros(len(texts), np.int64)
    where = np.full(len(texts), -1, np.int64)
    slots = np.flatnonzero(reach)
    places = array.suffixes[slots]
    docs = np.searchsorted(array.begins, places, side="right") - 1
    order = np.lexsort((places, -reach[slots], docs))
    docs, first = np.unique(docs[order], return_index=True)
    longest[docs] = reach[slots][order][first]
    where[docs] = places[order][first] - array.begins[docs]
    hit_words = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
    n_hit = hit_words[array.begins[1:]] - hit_words[array.begins[:-1]]
    return {"n_words": array.n_words.tolist(), "n_hit": n_hit.tolist(), "items": [list(i) for i in items], "longest": longest.tolist(), "at_word": where.tolist()}


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_hit, items, longest, at_word) of every document.

    ``longest`` is the text's longest verbatim match of an item that contains
    a hit window, ``at_word`` the word where the first such match starts.
    """
    ship(docs.sparkSession)
    blocks = query_blocks(benchmark, item, "text", window)
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()

    def run(batches):
        for batch in common.slices(batches, "text", SHARD_BYTES):
            found = judge(_texts(batch, "text"), [b.value for b in blocks])
            kind = pa.list_({"bigint": pa.int64(), "int": pa.int32()}.get(kinds[1], pa.string()))
            columns = [batch.column("key"), *(pa.array(found[c], kind if c == "items" else pa.int64()) for c in ("n_words", "n_hit", "items", "longest", "at_word"))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "n_hit", "items", "longest", "at_word"])

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"key {kinds[0]}, n_words long, n_hit long, items array<{kinds[1]}>, longest long, at_word long").withColumnRenamed("key", key)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """The documents in which no window occurs, all columns in place."""
    ship(docs.sparkSession)
    blocks = query_blocks(benchmark, item, "text", window)

    def run(batches):
        for batch in common.slices(batches, "text", SHARD_BYTES):
            found = judge(_texts(batch, "text"), [b.value for b in blocks])
            yield batch.select(["row"]).filter(pa.array([n == 0 for n in found["n_hit"]], pa.bool_()))

    # the row travels as one struct, whatever its columns' names
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    source = docs.select(row.alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    kept = source.mapInArrow(run, StructType([source.schema["row"]]))
    return kept.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated, longest, at_word)."""
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        key,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest",
        "at_word",
    )
