"""Operator 7: token ids as Arrow files of equal-length sequences.

The ids of all documents, in ascending key order and with an end id after
each, are one long stream, cut into files by key ranges.  A file is an Arrow
IPC file with two columns, ``ids`` and ``mask``, both fixed-size lists of one
length, in batches of a fixed number of sequences, so sequence ``i`` is row
``i % BATCH`` of batch ``i // BATCH``: a reader maps the file and slices it
without copying.  The mask is false only on the filling at a file's end.  A
second, small file lists each document's key, place and length.

Tasks write under a name of their own and rename at the end, so a repeated
task replaces a whole file by an equal one.  Null texts are empty documents
(only the end id); rows of equal keys are ordered by a hash of their text;
null keys come first; an empty table gives no file and no row.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import ship

from . import common, wordbpe

LENGTH = 2048  # tokens in a sequence
BATCH = 64  # sequences in a batch
END_ID = 2
KEPT = 500_000
DOC_ROWS = 1 << 16


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str, kind: str) -> LibraryEncoder:
    """One encoder for each worker process; what it has met serves later tasks."""
    return LibraryEncoder(vocabulary, kind)


class LibraryEncoder:
    """Ids by the tokenizers library; each distinct word and blank-separated chunk is encoded once while it is kept."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library, self.bpe, self.kind = wordbpe.library_at(path), wordbpe.load(path), kind
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.shown = self.library.model, dict(enumerate(wordbpe.byte_symbols()))
        self.code = {"<u2": "H", "<u4": "I"}[kind]
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def learn(self, fresh: list[str]) -> None:
        """Ids of chunks not met before, from their words; the library's model gets each distinct word once while it is kept."""
        words, pack = self.words, self.pack
        wordbpe.forget_late(words, KEPT)
        groups = list(map(self.bpe.words, fresh))
        for group in groups:
            for word in group:
                if word not in words:
                    # the model's ids of printable words are those of the word itself
                    symbols = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.shown)
                    words[word] = pack([t.id for t in self.model.tokenize(symbols)])
        for chunk, group in zip(fresh, groups, strict=True):
            self.chunks[chunk] = words[group[0]] if len(group) == 1 else b"".join([words[w] for w in group])

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        bpe, chunks = self.bpe, self.chunks
        wordbpe.forget_late(chunks, KEPT)
        cut = [[p if k % 2 else bpe.chunks(p) for k, p in enumerate(bpe.parts(t or ""))] for t in texts]
        met: set[str] = set()
        for parts in cut:
            met.update(*parts[::2])
        self.learn([c for c in met if c not in chunks])
        one = {s: np.array([i], self.kind).tobytes() for s, i in bpe.special.items()}
        find = chunks.__getitem__
        return [b"".join(one[p] if k % 2 else b"".join(map(find, p)) for k, p in enumerate(parts)) for parts in cut]


def id_type(tokenizer: str) -> str:
    """The narrowest unsigned type that holds every id of the vocabulary."""
    return "<u2" if len(wordbpe.load(tokenizer).tokens) <= 1 << 16 else "<u4"


# -- files


class _Publisher:
    """A file that appears under its name only when complete."""

    def __init__(self, folder: str, name: str):
        self.system, base = fs.FileSystem.from_uri(folder)
        self.system.create_dir(base, recursive=True)
        self.path, self.draft = f"{base}/{name}", f"{base}/_{name}-{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.draft)

    def publish(self) -> None:
        self.stream.close()
        self.system.move(self.draft, self.path)


class SequenceWriter:
    """Fills sequences with a stream of ids."""

    def __init__(self, folder: str, name: str, kind: str, length: int):
        self.kind, self.length = np.dtype(kind), length
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = _Publisher(folder, name)
        self.writer = pa.ipc.new_file(self.file.stream, self.schema)
        self.held: list[bytes] = []
        self.n_held = self.n = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n_held += len(ids) // self.kind.itemsize
        self.n += len(ids) // self.kind.itemsize
        if self.n_held >= self.length * BATCH:
            self._write(np.frombuffer(b"".join(self.held), self.kind))

    def _write(self, ids: np.ndarray) -> None:
        step = self.length * BATCH
        for start in range(0, len(ids) - len(ids) % step, step):
            self._batch(ids[start : start + step], step)
        rest = ids[len(ids) - len(ids) % step :]
        self.held, self.n_held = [rest.tobytes()], len(rest)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t.type) for x, t in zip((ids, mask), self.schema, strict=True)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.held), self.kind)
        if len(ids):
            self._batch(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        self.writer.close()
        self.file.publish()


class SequenceReader:
    """Random access to a file's sequences, masks and stream ranges; nothing is copied where the file can be mapped."""

    def __init__(self, folder: str, name: str):
        system, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/{name}"
        source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batch = functools.lru_cache(maxsize=2)(self.file.get_batch)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``i``."""
        batch, row = self.batch(i // BATCH), i % BATCH
        ids = batch.column("ids").flatten().to_numpy()
        return ids[row * self.length : (row + 1) * self.length], batch.column("mask").flatten().slice(row * self.length, self.length)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the stream."""
        step, parts = self.length * BATCH, []
        while n > 0:
            ids = self.batch(start // step).column("ids").flatten().to_numpy()
            parts.append(ids[start % step : start % step + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def sequence_file(part: int) -> str:
    return f"part-{part:06d}.tokens.arrow"


def document_file(part: int) -> str:
    return f"part-{part:06d}.documents.arrow"


# -- the operator


def write(docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Write all files under ``folder``; returns the manifest (part, n_docs, n_tokens, base), one row for each file."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = common.send_path(spark, tokenizer)
    kind = id_type(tokenizer)
    end = np.array([end_id], kind).tobytes()

    def run(batches):
        part = TaskContext.get().partitionId()
        known = encoder(common.local_file(vocabulary), kind)
        sequences = index = None
        n_docs = 0
        for batch in common.slices(batches, "text"):
            if sequences is None:
                sequences = SequenceWriter(folder, sequence_file(part), kind, length)
                index = _Publisher(folder, document_file(part))
                schema = pa.schema([("key", batch.schema.field("key").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                listing = pa.ipc.new_file(index.stream, schema)
            starts, sizes = [], []
            for ids in known.encode(batch.column("text").to_pylist()):
                starts.append(sequences.n)
                sequences.add(ids + end)
                sizes.append(sequences.n - starts[-1])
            listing.write_batch(pa.RecordBatch.from_arrays([batch.column("key"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=schema))
            n_docs += batch.num_rows
        if sequences is not None:
            sequences.close()
            listing.close()
            index.publish()
            yield pa.RecordBatch.from_pylist([{"part": part, "n_docs": n_docs, "n_tokens": sequences.n}])

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("tie", F.octet_length("text"))
    ordered = source.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "text").select("key", "text")
    manifest = common.stage(ordered.mapInArrow(run, "part long, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, folder: str, key_type: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files alone."""
    ship(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                reader = SequenceReader(folder, sequence_file(row["part"]))
                system, base = fs.FileSystem.from_uri(folder)
                with system.open_input_file(f"{base}/{document_file(row['part'])}") as source:
                    listing = pa.ipc.open_file(source)
                    for k in range(listing.num_record_batches):
                        found = listing.get_batch(k)
                        starts, sizes = found.column("start").to_numpy(), found.column("n_tokens").to_numpy()
                        sums = [zlib.crc32(reader.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                        columns = [found.column("key"), pa.array(starts + row["base"]), pa.array(sizes), pa.array(sums, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["key", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(run, f"key {key_type}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)
