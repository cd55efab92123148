"""Rows of a table dealt out over tasks whose work does not grow with the table."""

from pyspark.sql import functions as F

from fixtures.registry import Tables
from fleetlens.operators import report as R
from fleetlens.session import spread, stage


def tasks(df):
    return df.rdd.getNumPartitions()


def test_few_bytes_of_many_rows_use_all_cores(spark, tmp_path):
    spark.range(20_000).coalesce(1).write.parquet(f"{tmp_path}/t")
    assert tasks(spread(spark.read.parquet(f"{tmp_path}/t"))) == spark.sparkContext.defaultParallelism


def test_tasks_grow_with_the_table(spark, tmp_path):
    spark.range(40_000).repartition(8).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    dealt = spread(table, rows=1_000)
    assert tasks(dealt) == 40 and dealt.count() == 40_000 and dealt.distinct().count() == 40_000
    assert tasks(spread(table, size=sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet")) // 20)) >= 20
    assert tasks(spread(table, rows=40_000)) == tasks(table)


def test_small_and_empty_tables_stay(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/t")
    spark.range(0).write.parquet(f"{tmp_path}/e")
    assert tasks(spread(spark.read.parquet(f"{tmp_path}/t"))) == 1
    assert spread(spark.read.parquet(f"{tmp_path}/e")).count() == 0


def test_rows_that_are_only_read_stay(spark, tmp_path):
    spark.range(40_000).repartition(8).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert tasks(spread(table, rows=1_000, costly=False)) == tasks(table)


def test_only_costly_views_have_their_tables_dealt_out(spark, tmp_path):
    rows = spark.range(60_000).selectExpr("id AS doc_id", "'t' AS text")
    rows.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    t = Tables(spark, str(tmp_path))
    before = tasks(t.code_docs)
    assert tasks(t.code_corpus) >= before and tasks(t.evidence_index_lines) == before


def test_checks_of_one_task_are_sorted_by_several(spark, monkeypatch):
    staged = []

    def kept(df, name, **options):
        staged.append(stage(df, name, **options))
        return staged[-1]

    monkeypatch.setattr(R, "stage", kept)
    order = F.struct(F.lit("pact").alias("tool"), F.col("id").alias("pos"))
    rows = spark.range(0, 120_000, 1, 1).select(
        F.lit("p").alias("project"), F.lit("pact").alias("tool"), F.lit("c").alias("check_id"), F.lit("t").alias("target"),
        F.lit("WARN").alias("severity"), F.lit("WARN").alias("status"), F.col("id").cast("string").alias("message"), order.alias("ord"),
    )
    log = R.check_log(rows)
    assert [len(df.inputFiles()) for df in staged[:1]] == [3] and log.count() == 120_000
    assert [r.ord.pos for r in log.orderBy("seq").select("ord").collect()] == list(range(120_000))
