"""Operator 3: a quality classifier of averaged subword embeddings.

A text's features are its blank-separated words and the character n-grams of
3 to 5 bytes inside them (with the blanks at their ends), hashed to a fixed
number of buckets.  Their vectors are averaged and go through a softmax;
vectors and output weights are learned together by stochastic gradient
descent in numpy on a bounded, hash-ordered sample of labelled texts, one a
document id, in one task.  Since the output is linear in the average, the model is one number
per bucket, and scoring is a mean of numbers over the whole text.

Labels are used only for rows whose crc32 of the id is not 1 modulo 3; id,
language, source and labels are no inputs.  Null and empty texts have no
feature and score 0.5; without labels of both classes every text scores 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import ship

from . import common, wordhash

BUCKETS = 1 << 17
SIZE = 8
GRAMS = (3, 4, 5)
#: Training texts of each class at most: the bound of the sample.
SAMPLE = 1000
EPOCHS = 5
RATE = 1.0
SEED = 7
INK = bytes(0x20 if b in (9, 10, 11, 12, 13, 32) else b for b in range(256))


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature occurrence, ordered by text."""
    words, begins = wordhash.hashes(texts, INK)
    owners, found = [np.repeat(np.arange(len(texts)), np.diff(begins))], [words]
    block = (b" " + b" ".join(t or b"" for t in texts) + b" ").translate(INK)
    codes = np.frombuffer(block, np.uint8)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    blanks = np.concatenate([[0], np.cumsum(codes == 0x20)])
    wide = codes.astype(np.uint64)
    for n in GRAMS:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        value = np.full(count, n, np.uint64)
        for k in range(n):
            value = value << np.uint64(8) | wide[k : k + count]
        # no blank but at the ends, where it marks a word's edge
        inner = np.flatnonzero(blanks[n - 1 : n - 1 + count] == blanks[1 : count + 1])
        found.append(wordhash.mix(value[inner]))
        owners.append(np.searchsorted(ends, inner, side="right"))
    owner, value = np.concatenate(owners), np.concatenate(found)
    keep = owner < len(texts)
    return owner[keep], (value[keep] % np.uint64(BUCKETS)).astype(np.int64)


def train(texts: list[bytes | None], labels: list[int]) -> np.ndarray:
    """Score of each bucket: its vector times the difference of the two output weights."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    output = np.zeros((SIZE, 2), np.float32)
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32)
    rows = []
    for text, label in zip(texts, labels, strict=True):
        _, bucket = features([text])
        distinct, count = np.unique(bucket.astype(np.int32), return_counts=True)
        if len(distinct):
            rows.append((distinct, (count / count.sum()).astype(np.float32), label))
    step, steps = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            bucket, share, label = rows[k]
            rate = RATE * (1 - step / steps)
            mean = share @ vectors[bucket]
            logits = mean @ output
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[label] -= 1
            back = output @ chance
            output -= rate * np.outer(mean, chance)
            vectors[bucket] -= rate * share[:, None] * back
            step += 1
    return vectors @ (output[:, 1] - output[:, 0])


def scores(texts: list[bytes | None], model: np.ndarray) -> np.ndarray:
    owner, bucket = features(texts)
    total = np.bincount(owner, model[bucket], len(texts))
    count = np.bincount(owner, minlength=len(texts))
    return 1 / (1 + np.exp(-total / np.maximum(count, 1)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, size: int) -> DataFrame:
    """(key, text, label), staged: up to ``size`` labelled texts of each class, first by a hash of the id; of an id's texts the one of least hash.

    The documents are read by all tasks here; only the staged sample goes to the training task.
    """
    given = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    given = given.groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("label"))
    order = F.xxhash64("_key")
    some = given.where("label = 0").orderBy(order, "_key").limit(size).unionByName(given.where("label = 1").orderBy(order, "_key").limit(size))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(some, F.col("key") == F.col("_key"))
    one = rows.groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return common.stage(one.select("key", F.col("least.text").alias("text"), "label"), "sample")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", size: int = SAMPLE) -> np.ndarray:
    """Train in one task on the bounded sample; the model is ``BUCKETS`` numbers."""

    def run(batches):
        texts, given, keys = [], [], []
        for batch in batches:
            texts += batch.column("text").cast(pa.binary()).to_pylist()
            given += batch.column("label").to_pylist()
            keys += batch.column("key").to_pylist()
        order = sorted(range(len(keys)), key=lambda k: (str(keys[k]), texts[k] or b""))
        model = train([texts[k] for k in order], [given[k] for k in order])
        yield pa.RecordBatch.from_arrays([pa.array([model.astype("<f4").tobytes()], pa.binary())], ["model"])

    ship(docs.sparkSession)
    some = sample(docs, labels, label, key, text, size)
    rows = some.coalesce(1).mapInArrow(run, "model binary").collect()
    common.discard(some)
    return np.frombuffer(rows[0].model, "<f4") if rows else np.zeros(BUCKETS, np.float32)


def classify(docs: DataFrame, model: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(model, np.float32).tobytes())

    def run(batches):
        numbers = np.frombuffer(shared.value, np.float32).astype(np.float64)
        for batch in common.slices(batches, "text", 2 << 20):
            found = scores(batch.column("text").cast(pa.binary()).to_pylist(), numbers)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found)], ["key", "score"])

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    scored = source.mapInArrow(run, f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
