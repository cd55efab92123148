"""Operator 12 against plain counting, and on odd tables."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow.parquet as pq

from fleetlens.llm import queries, survival

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def failed(rows):
    """The letters that each (id, text, part) fails."""
    least = {}
    for key, text, _ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    for key, text, _ in rows:
        text = text or ""
        words = re.findall("[^ \t-\r]+", text)
        out = "A" if len(words) < 50 else ""
        out += "B" if 100 * len(set(words)) < 65 * len(words) else ""
        out += "C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else ""
        out += "D" if re.search("[#$%&*|]", text) else ""
        yield out + ("E" if key is not None and key > least[text] else "")


def brute(rows, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    docs = [(r[0], r[2] or "", f) for r, f in zip(rows, failed(rows), strict=True)]
    out = {}
    for part in {p for _, p, _ in docs}:
        mine = [(k, f) for k, p, f in docs if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [(k, f) for k, f in left if letter in f]
                left = [(k, f) for k, f in left if letter not in f]
                shapley[letter] += len(gone)
                out[part, order, step] = [
                    len(left),
                    len(gone),
                    sum(letter in f for _, f in mine) - len(gone),
                    sum(f == letter for _, f in mine),
                    sum(k in good for k, _ in gone),
                    sum(k in toxic for k, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    return {tuple(r[:3]): tuple(r[3:]) for r in df.collect()}


def test_whole_tables(spark, small):
    docs = pq.read_table(f"{small}/documents.parquet").to_pydict()
    labels = pq.read_table(f"{small}/labels.parquet").to_pydict()
    want = brute(list(zip(docs["doc_id"], docs["text"], docs["source"], strict=True)), list(zip(labels["doc_id"], labels["quality"], labels["toxic"], strict=True)))
    assert found(queries.op12_filter_audit(spark, small)) == want


def test_odd_rows(spark):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [
        (1, words, "s"),
        (2, words, "s"),
        (2, words, "s"),  # a repeated row does not copy itself
        (1, words, "t"),
        (None, words, "s"),
        (None, None, None),
        (3, None, None),
        (4, "", ""),
        (4, " \x0b\t ", ""),
        (5, "A" * 200_000 + " $ " + words, "t"),
        (6, words.upper() + " " + words, "s"),
        (7, "a a a b " * 40, "s"),
        (7, "　 é " * 60, "s"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (4, 1, None), (99, 1, 1), (7, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", True) for r in rows], DOCS + ", n int, bits string, `a.b` boolean")
    marks = spark.createDataFrame([(*r, 1) for r in labels], LABELS + ", source int")
    assert found(survival.report(docs, marks)) == brute(rows, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert survival.report(docs, labels).collect() == []
    some = spark.createDataFrame([(1, "x", "s")], DOCS)
    assert found(survival.report(some, labels)) == brute([(1, "x", "s")], [])


def test_no_table_goes_through_the_driver(spark, tmp_path):
    """Both joins merge, however small the files by which Spark would broadcast a side."""
    rows = [(k, f"w{k % 7} $", "st"[k % 2]) for k in range(40)]
    labels = [(k, k % 4 // 2, int(k % 3 == 0)) for k in range(0, 40, 2)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    df = queries.op12_filter_audit(spark, str(tmp_path))
    plans = [df._jdf.queryExecution().executedPlan().toString()]
    assert found(df) == brute(rows, labels)
    plans.append(df._jdf.queryExecution().executedPlan().toString())  # as it ran
    for plan in plans:
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_sql_on_documents_and_labels(spark, tmp_path):
    draw = random.Random(12)
    texts = [" ".join(draw.choices(["w", "x", "Y", "$", "zz"], k=draw.choice([3, 60]))) for _ in range(20)]
    rows = [(k // 2, draw.choice([*texts, None]), draw.choice(["s", "t", None])) for k in range(120)]
    labels = [(k % 70, draw.choice([0, 1, None]), draw.choice([0, 1])) for k in range(90)]
    with duckdb.connect() as db:
        for name, values, schema in (("documents", rows, DOCS), ("labels", labels, LABELS)):
            spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        expected = db.execute(queries.oracle_sql()["op12_filter_audit"]).fetchall()
        columns = [d[0] for d in db.description]
    ours = [tuple(r[c] for c in columns) for r in queries.op12_filter_audit(spark, str(tmp_path)).collect()]
    assert sorted(ours) == sorted(expected) and len(ours) == 3 * 120 * 5


def test_popcounts():
    draw = random.Random(5)
    for n in (0, 1, 2, 3, 4, 5, 64, 1000):
        words = np.array([draw.getrandbits(32) for _ in range(n)], np.uint32)
        times = np.array([draw.choice([1, 1, 2, 7, 1000]) for _ in range(n)], np.int64)
        want = [sum(int(t) for w, t in zip(words, times, strict=True) if int(w) >> s & 1) for s in range(32)]
        assert survival.popcounts(words, times).tolist() == want
