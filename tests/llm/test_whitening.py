"""Operator 11 against dense linear algebra on one machine."""

import math
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from fleetlens.llm import queries, whitening

VECTORS = "vec_id long, embedding array<float>"


def fit(vectors):
    """n, sums and x of plain lists."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    return len(x), [sum(c) for c in zip(*x, strict=True)], x


def check(rows, vectors, count=8):
    """``rows`` of the operator against {id: vector}."""
    n, sums, x = fit(list(vectors.values()))
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums, strict=True)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(count, len(sums))
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    assert len(rows) == n * k
    got = np.zeros((n, k))
    place = {key: i for i, key in enumerate(vectors)}
    for r in rows:
        i = place[r.vec_id]
        got[i, r.component - 1] = r.whitened
        assert r.n == n
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[i], sums, strict=True))
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-7


def test_whole_table(spark, small):
    table = pq.read_table(f"{small}/embeddings.parquet").to_pydict()
    check(queries.op11_whitening(spark, small).collect(), dict(zip(table["vec_id"], table["embedding"], strict=True)))


def drawn(n, d, seed=11):
    draw = np.random.default_rng(seed)
    mix = draw.normal(size=(d, d)) * np.linspace(2, 0.1, d)
    return {k: v for k, v in enumerate((draw.normal(size=(n, d)) @ mix + 3).astype(np.float32).tolist())}


def test_many_blocks_and_cells(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "GROUP", 2)
    vectors = drawn(700, 12)
    df = spark.createDataFrame(list(vectors.items()), VECTORS).repartition(5)
    assert whitening.side_of(45) == 5
    check(whitening.whiten(df).collect(), vectors)


def test_blocks_split_between_tasks(spark):
    """A block that comes in two parts counts once."""
    vectors = drawn(300, 5)
    n, sums, x = fit(vectors.values())
    rows = [(k, row, 0, k, k // whitening.ROWS) for k, row in enumerate(x)]
    placed = spark.createDataFrame(rows, "key long, x array<long>, part int, place long, block int").repartition(3)
    parts = whitening.blocks(placed, sums, n)
    assert parts.count() == 3
    centred = np.array(x, float) * n - np.array(sums)
    assert np.allclose(whitening.scatter(parts, 5, 1), centred.T @ centred, rtol=1e-12)
    total = sum(b[1].toArray() for b in whitening.projected(parts, 5, 1, np.eye(5)[:, :2]).blocks.collect())
    assert (total[:300] == centred[:, :2]).all()


def test_odd_vectors(spark):
    good = drawn(40, 6)
    rows = [(k, v, "x") for k, v in good.items()]
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] + [0.0] * 5, [float("inf")] + [0.0] * 5, [-float("inf")] * 6, [1e30] * 6, [1.0] * 5]
    rows += [(100 + k, v, None) for k, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string").withColumn("a.b", whitening.F.lit(1))
    check(whitening.whiten(df).collect(), good, 6)


def test_null_and_repeated_ids(spark):
    good = drawn(30, 4)
    rows = [(None if k < 3 else k // 2, v) for k, v in good.items()]
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(out) == 30 * 4
    assert sum(r.vec_id is None for r in out) == 3 * 4


def test_no_spread(spark):
    """Equal vectors have no variance; a flat direction gives 0 and no error."""
    same = whitening.whiten(spark.createDataFrame([(k, [0.5, 0.25]) for k in range(4)], VECTORS)).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in same] == [(0.0, 0.0, 0.0, 0)] * 8
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 1.0]) for k in range(4)], VECTORS)).collect()
    assert all(r.identity_error < 1e-12 for r in line)
    assert {r.whitened for r in line if r.component == 2} == {0.0}


def test_large_entries(spark):
    vectors = {k: [float(k) * 1e11, 1.0 + k % 3] for k in range(20)}
    for r in whitening.whiten(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")).collect():
        n, sums, x = fit(vectors.values())
        want = sum((n * c - s) ** 2 for c, s in zip(x[r.vec_id], sums, strict=True))
        assert r.deviation == (want if want < 1 << 63 else None)


def test_empty(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], VECTORS)).collect() == []
