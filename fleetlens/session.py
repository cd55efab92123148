"""Session settings and staging of shared intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no Python call site per expression; plans here are large
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # one row is one file, so Arrow batches are kept small in rows
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}

#: A table of fewer rows and less than a megabyte is not dealt out.
FEW_ROWS = 10_000


def local_session(app: str, cores: str = "8", memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    A session of one machine, as in tests, may leave it unset and gets a
    scratch folder; any other master without the setting is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not hasattr(context, "_fleetlens_scratch"):
        context._fleetlens_scratch = tempfile.mkdtemp(prefix="fleetlens-")
    return context._fleetlens_scratch


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None, rows: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage without executor-local blocks, so a lost executor costs
    nothing but its running tasks.  With ``rows`` no file has more of them, so
    what a single task wrote is read by several.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_folder(spark), f"{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("errorifexists")
    if rows:
        writer = writer.option("maxRecordsPerFile", rows)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The same as ``--py-files``; for sessions somebody else started.
    """
    context = spark.sparkContext
    if getattr(context, "_fleetlens_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="fleetlens-"), "fleetlens.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("fleetlens", os.path.relpath(full, package)))
    context.addPyFile(archive)
    context._fleetlens_shipped = True


def spread(df: DataFrame, smallest: int = 1 << 20, rows: int = 50_000, size: int = 32 << 20, costly: bool = True) -> DataFrame:
    """Deal out the rows of a table of files where a task would get too many.

    A row group is the least one task can read.  Where fewer tasks than there
    are cores have any rows, or where rows are ``costly`` and the largest task
    has more than ``rows`` of them or ``size`` bytes of files, the rows are
    dealt out once: then the number of tasks grows with the table, the work of
    a task does not.  Only footers are read for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    file = F.struct("_metadata.file_path", "_metadata.file_size")
    pieces = df.groupBy(F.spark_partition_id().alias("part"), file.alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not pieces:
        return df
    tasks: dict[int, int] = {}
    for piece in pieces:  # one for each split of a file
        tasks[piece.part] = tasks.get(piece.part, 0) + piece.n
    total, largest, busy = sum(tasks.values()), max(tasks.values()), len(tasks)
    held = sum({piece.file.file_path: piece.file.file_size for piece in pieces}.values())
    most = max(1, min(rows, total * size // held)) if costly else total
    if largest <= most and (busy >= cores or (held < smallest and total < FEW_ROWS)):
        return df
    return df.repartition(max(cores, -(-total // most)))
