"""Source trees as tables: one row per file, keyed by (project, path)."""

from __future__ import annotations

import math
import posixpath
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens import values as V
from fleetlens.functions.regexkit import matches_any_glob
from fleetlens.functions.text import constant_map
from fleetlens.session import stage


LISTING = "path string, bytes bigint, mtime timestamp, is_dir boolean"
RAW = "path string, bytes bigint, mtime timestamp, part bigint, raw binary"
ENTRIES_PER_TASK = 100_000  # a folder walk stops here and hands the rest on
BATCH_BYTES = 32 << 20
PART_BYTES = 16 << 20  # a larger file is read in parts
COMPRESSED = r"\.(bz2|gz|lz4|zst)$"  # such files are decompressed as they are read, so always whole
TASK_BYTES = 128 << 20


def _open(root: str):
    """(file system, absolute path) of a URI or a local path; runs on executors."""
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def _lister(root: str, budget: int):
    """Walks folders breadth first; folders beyond the budget come back unread."""

    def entry(info: fs.FileInfo, base: str, is_dir: bool) -> dict:
        return {"path": posixpath.relpath(info.path, base), "bytes": info.size or 0, "mtime": info.mtime, "is_dir": is_dir}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        for batch in batches:
            for start in batch.column(0).to_pylist():
                queue, seen = deque([start]), 0
                while queue:
                    found = system.get_file_info(fs.FileSelector(posixpath.join(base, queue.popleft())))
                    seen += len(found)
                    rows = [entry(i, base, False) for i in found if i.type == fs.FileType.File]
                    folders = [i for i in found if i.type == fs.FileType.Directory]
                    if seen < budget:
                        queue.extend(entry(i, base, True)["path"] for i in folders)
                    else:
                        rows += [entry(i, base, True) for i in folders]
                        rows += [{"path": p, "bytes": 0, "mtime": None, "is_dir": True} for p in queue]
                        queue.clear()
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_LISTED)

    return walk


_LISTED = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("is_dir", pa.bool_())])
_READ = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("part", pa.int64()), ("raw", pa.binary())])


def _reader(root: str):
    """Reads each row's part of a file; the last part ends with the file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                name, last = posixpath.join(base, row["path"]), row.pop("last")
                try:
                    if row["part"] == 0 and last:
                        with system.open_input_stream(name) as f:
                            row["raw"] = f.read()
                    else:
                        with system.open_input_file(name) as f:
                            f.seek(min(row["part"] * PART_BYTES, f.size()))
                            row["raw"] = f.read() if last else f.read(PART_BYTES)
                except OSError:  # unreadable files are left out
                    continue
                rows.append(row)
                held += len(row["raw"])
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return read


def list_tree(spark: SparkSession, root: str, budget: int = ENTRIES_PER_TASK) -> DataFrame:
    """(path, bytes, mtime) of every file below ``root``, names relative to it.

    Spark's own file sources skip names that start with a dot or an
    underscore; registries and many source files have such names.  The walk
    runs in rounds: a task reads up to ``budget`` entries and passes the
    folders it did not reach to the next round, so no tree is too large for
    one task.
    """
    tasks = spark.sparkContext.defaultParallelism * 4
    todo = spark.createDataFrame([("",)], "path string")
    found = None
    while True:
        level = stage(todo.mapInArrow(_lister(root, budget), LISTING), "listing")
        files = level.where("NOT is_dir").drop("is_dir")
        found = files if found is None else found.unionByName(files)
        folders = level.where("is_dir").select("path")
        if folders.isEmpty():
            return found
        todo = folders.repartition(tasks)


def _parts() -> Column:
    return F.ceil(F.col("bytes") / PART_BYTES)


def _joined(parts: DataFrame) -> DataFrame:
    """Files of the parts read, those with all their parts."""
    pieces = F.array_sort(F.collect_list(F.struct("part", "raw")))
    text = F.array_join(F.transform(pieces, lambda p: p["raw"].cast("string")), "")
    files = parts.groupBy("path", "bytes", "mtime").agg(F.count("raw").alias("n"), text.cast("binary").alias("raw"))
    return files.where(F.col("n") == _parts()).drop("n")


def corpus_read(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """Every file below ``root``; text is decoded lossily.

    ``project`` names the one project; otherwise the first folder below
    ``root`` is the project and ``path`` is relative to that folder.
    """
    listing = list_tree(spark, root)
    large = (F.col("bytes") > PART_BYTES) & ~F.col("path").rlike(COMPRESSED)
    total, some_large = listing.agg(F.sum("bytes"), F.max(large)).first()
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil((total or 0) / TASK_BYTES))
    parts = listing.where(large).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), _parts() - 1)))
    read = lambda some: some.repartition(tasks).mapInArrow(_reader(root), RAW)
    whole = read(listing.where(~large).select("*", F.lit(0).cast("bigint").alias("part"), F.lit(True).alias("last"))).drop("part")
    joined = _joined(read(parts.withColumn("last", F.col("part") == _parts() - 1)))
    table = in_project(whole.unionByName(joined) if some_large else whole, project)
    return corpus_language(table, keep_unknown=True).select(
        "project", "path", "lang", F.col("raw").cast("string").alias("content"), is_binary(F.col("raw"), V.BINARY_PROBE_BYTES).alias("is_binary"), "raw", "mtime", "bytes"
    )


def in_project(files: DataFrame, project: str | None = None) -> DataFrame:
    """Adds ``project`` and makes ``path`` relative to it."""
    if project is not None:
        return files.withColumn("project", F.lit(project))
    inside = F.col("path").contains("/")
    return files.where(inside).withColumns(
        {"project": F.substring_index("path", "/", 1), "path": F.regexp_replace("path", "^[^/]*/", "")}
    )


def corpus_language(files: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Language by file extension; files of no known language are dropped."""
    lang = constant_map(V.EXTENSION_LANGUAGE)[F.regexp_extract("path", r"\.[^./]+$", 0)]
    tagged = files.withColumn("lang", lang)
    return tagged if keep_unknown else tagged.where(F.col("lang").isNotNull())


def corpus_exclude(files: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Drop files with an excluded folder or file name anywhere in their path."""
    names = V.SOURCE_EXCLUDE if exclude is None else exclude
    if not names:
        return files
    return files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(n) for n in names])))


def is_source_file(dirs: list[str] | None = None, languages: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Is a file (path, lang) of a known language and below a source folder?"""
    wanted = F.lit(False)
    for folder in V.SOURCE_DIRS if dirs is None else dirs:
        rel = posixpath.normpath(folder)
        wanted = wanted | (F.lit(True) if rel == "." else F.col("path").startswith(rel + "/"))
    names = V.SOURCE_EXCLUDE if exclude is None else exclude
    if names:
        wanted = wanted & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(n) for n in names]))
    return wanted & (F.col("lang").isNotNull() if languages is None else F.coalesce(F.col("lang").isin(languages), F.lit(False)))


def source_files(
    corpus: DataFrame,
    dirs: list[str] | None = None,
    languages: list[str] | None = None,
    exclude: list[str] | None = None,
) -> DataFrame:
    """Files the discovery scanners read: known language, below a source folder."""
    return corpus.where(is_source_file(dirs, languages, exclude))


def evidence_path_ok(
    path: Column,
    include: list[str] | str = V.DEFAULT_INCLUDE,
    exclude: list[str] | str | None = None,
    excluded_parts: list[str] | None = None,
    excluded_part_prefixes: list[str] | None = None,
    excluded_prefixes: list[str] | None = None,
) -> Column:
    """Path test for files that count as evidence.

    ``excluded_parts``, ``excluded_part_prefixes`` and ``excluded_prefixes``
    add to the fixed lists: pass the names of generated folders there.
    """
    include = [include] if isinstance(include, str) else list(include)
    exclude = [exclude] if isinstance(exclude, str) else list(exclude or [])
    parts = F.split(path, "/")
    names = V.EVIDENCE_EXCLUDED_PARTS + list(excluded_parts or [])
    ok = ~F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    for prefix in excluded_part_prefixes or []:
        ok = ok & ~F.exists(parts, lambda p, prefix=prefix: p.startswith(prefix))
    for prefix in V.EVIDENCE_EXCLUDED_PREFIXES + list(excluded_prefixes or []):
        ok = ok & ~path.startswith(prefix) & (path != prefix.rstrip("/"))
    if exclude:
        ok = ok & ~matches_any_glob(path, exclude)
    return ok & matches_any_glob(path, include)


def evidence_file_select(files: DataFrame, **rules) -> DataFrame:
    return files.where(evidence_path_ok(F.col("path"), **rules))


def binary_filter(files: DataFrame, raw: str = "raw", probe: int | None = None) -> DataFrame:
    """Drop files with a NUL; with ``probe`` only that many first bytes are looked at."""
    return files.where(~is_binary(F.col(raw), probe))


def is_binary(raw: Column, probe: int | None = None) -> Column:
    return F.contains(raw if probe is None else F.substring(raw, 1, probe), F.lit(bytes([0])))


def corpus_lines(corpus: DataFrame) -> DataFrame:
    """(project, path, line, text); lines end at LF only."""
    return corpus.select(
        "project", "path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "text")
    ).select("project", "path", (F.col("pos") + 1).alias("line"), "text")
