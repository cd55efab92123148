"""Operator 2: encoding and decoding by a minimal acyclic transducer of frequent words.

``frequent_words`` counts every word of every text.  The most frequent ones
(a stated number) are compiled, with their ids as outputs, into an automaton
that shares suffixes: each arc carries the number of words that sort before
it, so the sum along a word's path is the word's place in one table of ids.
Executors map the compiled file into memory.  A word that the automaton does
not accept is merged exactly, so the result never depends on the lexicon.

Null texts are empty and have no ids; an empty table gives an empty table and
an empty lexicon.  Other columns are not read, whatever their names; repeated
rows are encoded each on its own.
"""

from __future__ import annotations

import functools
import mmap
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import ship

from . import common, wordbpe

#: Words in the automaton: bounds the file that every executor maps (about 2 MB).
LEXICON_WORDS = 1 << 16
#: Longer words are rare and only make the automaton deep.
LEXICON_BYTES = 64
#: Distinct words a worker keeps at a time.
KEPT = 500_000
#: Levels of counts in each power of two.
LEVELS = 16
MAGIC = np.frombuffer(b"lexicon1", "<i8")


# -- counting


def frequent_words(docs: DataFrame, tokenizer: str, text: str = "text", size: int = LEXICON_WORDS) -> DataFrame:
    """(word, n): the ``size`` most frequent words seen twice or more; ties by word."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = common.send_path(spark, tokenizer)

    def count(batches):
        bpe = wordbpe.load(common.local_file(vocabulary))
        chunks: Counter = Counter()
        for batch in common.slices(batches, "text"):
            for value in batch.column("text").to_pylist():
                for k, part in enumerate(bpe.parts(value or "")):
                    if k % 2 == 0:
                        chunks.update(bpe.chunks(part))
            if len(chunks) > KEPT:
                yield from counted(bpe, chunks)
                chunks.clear()
        yield from counted(bpe, chunks)

    def counted(bpe, chunks):
        words: Counter = Counter()
        for chunk, n in chunks.items():
            for word in bpe.words(chunk):
                if len(word) <= LEXICON_BYTES:
                    words[word] += n
        yield pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])

    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    total = common.stage(counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "words")
    # the least level of counts that is needed, so that no task sends words that can't be chosen
    level = F.floor(LEVELS * F.log2("n"))
    chosen = least = 0
    for row in total.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():  # 64 * LEVELS rows at most
        chosen, least = chosen + row.words, row.level
        if chosen >= size:
            break
    return total.where(level >= least).orderBy(F.desc("n"), "word").limit(size)


# -- the automaton


def compile_lexicon(words: list[str], bpe: wordbpe.WordBpe) -> bytes:
    """The automaton of ``words`` as one file: header, then arrays in fixed order.

    Words are added in byte order; as soon as a branch can no longer change,
    each of its states is replaced by an equal one met before, so the result
    is minimal.
    """
    entries = sorted({w.encode(): w for w in words if w and len(w.encode()) <= LEXICON_BYTES}.items())
    known: dict[tuple, int] = {}
    states: list[tuple] = []
    branch: list[list] = [[False, []]]  # open states: accepts, arcs (byte, state)

    def close(depth: int) -> None:
        while len(branch) > depth + 1:
            accepts, arcs = branch.pop()
            shape = (accepts, tuple(arcs))
            if shape not in known:
                known[shape] = len(states)
                states.append(shape)
            branch[-1][1][-1] = (branch[-1][1][-1][0], known[shape])

    last = b""
    for word, _ in entries:
        same = next((k for k, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        close(same)
        for byte in word[same:]:
            branch[-1][1].append((byte, -1))
            branch.append([False, []])
        branch[-1][0] = True
        last = word
    close(0)
    states.append((branch[0][0], tuple(branch[0][1])))
    total = []  # words accepted from each state; a state's targets come before it
    keys, targets, skips = [], [], []
    for k, (accepts, arcs) in enumerate(states):
        n = int(accepts)
        for byte, target in arcs:
            keys.append(k << 8 | byte)
            targets.append(target)
            skips.append(n)
            n += total[target]
        total.append(n)
    ids = [bpe.word_ids(w) for _, w in entries]
    arrays = [
        np.array(keys, "<i8"),
        np.array(targets, "<i8"),
        np.array(skips, "<i8"),
        np.array([accepts for accepts, _ in states], "<i8"),
        np.cumsum([0, *map(len, ids)]).astype("<i8"),
        np.array([i for word in ids for i in word], "<i8"),
    ]
    return b"".join([MAGIC.tobytes(), np.array([len(a) for a in arrays], "<i8").tobytes(), *(a.tobytes() for a in arrays)])


class Lexicon:
    """A compiled automaton, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), "<i8")
        if data[0] != MAGIC[0]:
            raise ValueError(f"{path} is no lexicon")
        ends = 7 + np.cumsum(data[1:7])
        self.keys, self.targets, self.skips, self.accepts, self.starts, self.ids = (data[e - n : e] for e, n in zip(ends, data[1:7], strict=True))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the table of ids, -1 if not accepted; all words walk in step."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        state = np.full(len(words), len(self.accepts) - 1, np.int64)
        place = np.zeros(len(words), np.int64)
        alive = np.flatnonzero(lengths <= LEXICON_BYTES) if len(self.keys) else np.empty(0, np.int64)
        found = np.full(len(words), -1, np.int64)
        step = 0
        while len(alive):
            ended = lengths[alive] == step
            done = alive[ended]
            done = done[self.accepts[state[done]] == 1]
            found[done] = place[done]
            alive = alive[~ended]
            want = state[alive] << 8 | text[begin[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            right = self.keys[arc] == want
            alive, arc = alive[right], arc[right]
            state[alive] = self.targets[arc]
            place[alive] += self.skips[arc]
            step += 1
        return found

    def outputs(self, place: int) -> list[int]:
        return self.ids[self.starts[place] : self.starts[place + 1]].tolist()


@functools.lru_cache(maxsize=2)
def mapped(path: str) -> Lexicon:
    return Lexicon(path)


@functools.lru_cache(maxsize=1)
def encoder(vocabulary: str, lexicon: str) -> Encoder:
    """One encoder for each worker process; what it has met serves later tasks, the one of an earlier lexicon is dropped."""
    return Encoder(wordbpe.load(vocabulary), mapped(lexicon))


class Encoder:
    """Ids of whole texts; blank-separated chunks met before are kept, at most ``KEPT`` of them."""

    def __init__(self, bpe: wordbpe.WordBpe, lexicon: Lexicon):
        self.bpe, self.lexicon = bpe, lexicon
        self.chunks: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        wordbpe.forget_late(self.chunks, KEPT)
        fresh = [c for c in chunks if c not in self.chunks]
        words = list(map(self.bpe.words, fresh))
        distinct = list({w for group in words for w in group})
        places = self.lexicon.places([w.encode() for w in distinct]).tolist()
        unseen = [w for w, place in zip(distinct, places, strict=True) if place < 0]
        ids = dict(zip(unseen, self.bpe.ids_of(unseen), strict=True))
        for word, place in zip(distinct, places, strict=True):
            if place >= 0:
                ids[word] = self.lexicon.outputs(place)
        for chunk, group in zip(fresh, words, strict=True):
            found = ids[group[0]] if len(group) == 1 else [i for w in group for i in ids[w]]
            self.chunks[chunk] = struct.pack(f"<{len(found)}i", *found)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [[p if k % 2 else self.bpe.chunks(p) for k, p in enumerate(self.bpe.parts(t or ""))] for t in texts]
        met: set[str] = set()
        for parts in cut:
            met.update(*parts[::2])
        self.learn(met)
        find = self.chunks.__getitem__
        out = []
        for parts in cut:
            pieces = [b"".join(map(find, p)) if k % 2 == 0 else np.array([self.bpe.special[p]], "<i4").tobytes() for k, p in enumerate(parts)]
            out.append(pieces[0] if len(pieces) == 1 else b"".join(pieces))
        return out


def id_lists(rows: list[bytes]) -> pa.Array:
    """An Arrow list column from rows of little-endian 32-bit ids."""
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(rows), "<i4"))
    return pa.ListArray.from_arrays(pa.array(ends), values)


# -- the operator


def build(docs: DataFrame, tokenizer: str, text: str = "text", size: int = LEXICON_WORDS) -> str:
    """Count, compile and send the lexicon of a corpus; returns its name on the executors."""
    spark = docs.sparkSession
    words = [r.word for r in frequent_words(docs, tokenizer, text, size).collect()]  # at most ``size`` words
    return common.send_file(spark, compile_lexicon(words, wordbpe.load(tokenizer)), "words.lexicon")


def encode(docs: DataFrame, tokenizer: str, lexicon: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row."""
    spark = docs.sparkSession
    vocabulary = common.send_path(spark, tokenizer)

    def run(batches):
        known = encoder(common.local_file(vocabulary), common.local_file(lexicon))
        for batch in common.slices(batches, "text"):
            rows = known.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("key"), id_lists(rows)], ["key", "ids"])

    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decoded(tokens: list[str], ids: np.ndarray) -> str:
    """The vocabulary's strings of some ids, joined by one space."""
    return " ".join(map(tokens.__getitem__, ids.tolist()))


def decode(encoded: DataFrame,tokenizer: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded): the vocabulary's strings of the ids, special ones too, joined by one space."""
    spark = encoded.sparkSession
    vocabulary = common.send_path(spark, tokenizer)

    def run(batches):
        tokens = wordbpe.load(common.local_file(vocabulary)).tokens
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [decoded(tokens, row) for row in batch.column("ids").to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("ids"), pa.array(texts, pa.string())], ["key", "ids", "decoded"])

    ship(spark)
    kind = encoded.schema[key].dataType.simpleString()
    source = encoded.select(F.col(key).alias("key"), "ids")
    return source.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def encode_decode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): every text's ids and the text they decode to, with a lexicon of this corpus.

    One worker does both, so ids cross to Python only once.
    """
    spark = docs.sparkSession
    lexicon = build(docs, tokenizer, text)
    vocabulary = common.send_path(spark, tokenizer)

    def run(batches):
        known = encoder(common.local_file(vocabulary), common.local_file(lexicon))
        for batch in common.slices(batches, "text", 1 << 20):
            rows = known.encode(batch.column("text").to_pylist())
            texts = pa.array([decoded(known.bpe.tokens, np.frombuffer(r, "<i4")) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), id_lists(rows), texts], ["key", "ids", "decoded"])

    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256)."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
