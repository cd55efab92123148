"""Files that are read in parts."""

import gzip

import pyarrow as pa
import pytest

from fleetlens.sources import corpus as C


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(C, "PART_BYTES", 10)


def test_large_files_are_whole(spark, tmp_path, small_parts):
    files = {
        "a/large.py": "é€𝄞 text of parts that cut characters\n".encode() * 40,
        "a/.hidden.md": bytes(range(256)) * 3 + b"\xff\xfe",
        "a/even.txt": b"x" * 30,
        "a/one.txt": b"0123456789",
        "a/empty": b"",
    }
    (tmp_path / "a").mkdir()
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    rows = C.corpus_read(spark, str(tmp_path)).collect()
    assert {f"{r.project}/{r.path}": bytes(r.raw) for r in rows} == files
    assert {r.path: r.content for r in rows}["large.py"] == files["a/large.py"].decode()
    assert all(r.bytes == len(r.raw) for r in rows)


def test_a_task_holds_one_part_of_a_large_file(tmp_path, small_parts):
    (tmp_path / "f").write_bytes(b"0123456789" * 5)
    rows = [{"path": "f", "bytes": 50, "mtime": None, "part": k, "last": k == 4} for k in range(5)]
    got = [r for b in C._reader(str(tmp_path))([pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
    assert [len(r["raw"]) for r in got] == [10] * 5


def test_files_without_all_their_parts_are_left_out(spark, small_parts):
    rows = [("f", 25, None, 0, b"a" * 10), ("f", 25, None, 2, b"c" * 5), ("g", 15, None, 1, b"b" * 5), ("g", 15, None, 0, b"a" * 10)]
    assert [(r.path, bytes(r.raw)) for r in C._joined(spark.createDataFrame(rows, C.RAW)).collect()] == [("g", b"a" * 10 + b"b" * 5)]


def test_large_compressed_files_are_read_whole(spark, tmp_path, small_parts):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/t.py.gz").write_bytes(gzip.compress(b"some text " * 9))
    row = C.corpus_read(spark, str(tmp_path)).first()
    assert row.bytes > 10 and row.content == "some text " * 9
