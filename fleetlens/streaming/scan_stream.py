"""The file scanners over a stream of newly landed files.

A file is scanned on its own, without state: the operators of
``operators.line_scan`` and ``operators.code_scan`` that use no aggregation
run on a streaming corpus as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

CORPUS_SCHEMA = "project string, path string, lang string, content string"


def corpus_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of corpus rows as they arrive in ``folder``."""
    return spark.readStream.schema(CORPUS_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def scan_to(
    corpus: DataFrame, scanner: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Append the facts of every new file to a parquet folder, exactly once."""
    writer = scanner(corpus).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(out)
