"""Ids of drafted controls against drafting one risk after the other."""

import random

import pytest

from fleetlens.functions.ordered import positions
from fleetlens.operators import risk


def one_by_one(drafted, existing):
    taken, out = set(existing), {}
    for key, base in sorted(drafted):
        name, i = base, 2
        while name in taken:
            name, i = f"{base}-{i}", i + 1
        taken.add(name)
        out[key, base] = name
    return out


def found(spark, drafted, existing):
    rows = risk.risk_id_collision(spark.createDataFrame(drafted, "risk_id long, base_id string"), spark.createDataFrame([(i,) for i in existing], "id string")).collect()
    assert len(rows) == len(drafted)
    return {(r.risk_id, r.base_id): r.id for r in rows}


def test_a_base_that_is_another_ones_number(spark):
    drafted = [(1, "G-ALPHA"), (2, "G-ALPHA"), (65, "G-ALPHA"), (3, "G-ALPHA-2")]
    ids = found(spark, drafted, [])
    assert ids == {(1, "G-ALPHA"): "G-ALPHA", (2, "G-ALPHA"): "G-ALPHA-2", (3, "G-ALPHA-2"): "G-ALPHA-2-2", (65, "G-ALPHA"): "G-ALPHA-3"}


@pytest.mark.parametrize("seed", range(3))
def test_drawn(spark, seed, monkeypatch):
    monkeypatch.setattr(risk, "BLOCK", 4)
    draw = random.Random(seed)
    names = ["A", "A-2", "A-3", "A-5", "A-2-2", "A-2-3", "A-2-2-2", "B-2", "B-01", "C-1", "C"]
    drafted = [(k, draw.choice(names)) for k in range(60)]
    existing = draw.sample(["A", "A-1", "A-4", "A-7", "A-2", "A-2-4", "C-2", "B-2-2", "A-99999999999999999999"], 4)
    assert found(spark, drafted, existing) == one_by_one(drafted, existing)


def test_no_base_and_no_rows(spark):
    assert found(spark, [(1, None), (2, "A")], []) == {(1, None): None, (2, "A"): "A"}
    assert found(spark, [], ["A"]) == {}


def test_positions_cut_a_large_group(spark):
    rows = [("hub", k) for k in range(500)] + [(f"g{k % 7}", k) for k in range(100)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v int").repartition(6)
    got = {(r.g, r.v): r.place for r in positions(df, ["g"], ["v"]).collect()}
    for g in {g for g, _ in rows}:
        assert [got[g, v] for v in sorted(v for h, v in rows if h == g)] == list(range(1, 1 + sum(h == g for h, _ in rows)))
