"""Small helpers of the corpus operators: bounded batches, shipped files, staged tables."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from fleetlens.session import checkpoint_folder, ship

#: Text handled at a time inside a task.
SLICE_BYTES = 4 << 20
_SCRATCH: list[str] = []


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for k, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def map_slices(df: DataFrame, column: str, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """One output batch for each bounded slice of the input; no state between slices."""
    ship(df.sparkSession)

    def run(batches):
        for batch in slices(batches, column, limit):
            yield function(batch)

    return df.mapInArrow(run, schema)


def send_file(spark: SparkSession, data: bytes, name: str) -> str:
    """Give every executor, also later ones, a copy of a small file; returns its name for ``local_file``.

    Only for data of a stated bound (a vocabulary, a compiled lexicon).
    """
    stem, end = os.path.splitext(name)
    name = f"{stem}-{hashlib.sha256(data).hexdigest()[:16]}{end}"
    context = spark.sparkContext
    sent = context.__dict__.setdefault("_fleetlens_sent", set())
    if name not in sent:
        path = os.path.join(tempfile.mkdtemp(prefix="fleetlens-"), name)
        with open(path, "wb") as out:
            out.write(data)
        context.addFile(path)
        sent.add(name)
    return name


def local_file(name: str) -> str:
    """The executor's own copy of a file sent by ``send_file``."""
    return SparkFiles.get(name)


def send_path(spark: SparkSession, path: str) -> str:
    with open(path, "rb") as file:
        return send_file(spark, file.read(), os.path.basename(path))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    return os.path.join(checkpoint_folder(spark), f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, lost executors cost nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        folder = checkpoint_folder(spark).rstrip("/")
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if os.path.basename(folder) in name:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
