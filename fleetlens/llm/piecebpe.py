"""Operator 13: sentence pieces by backtracking over longest matches.

A merge-type encoding is the only sequence of pieces in which merging any two
neighbours' characters again gives these two pieces, so it is found without
merging the text.  An Aho-Corasick automaton of the pieces gives the longest
matches of many parts in one scan; if each fits the one before, they are the
encoding.  Else at each place the longest piece is tried first, then its next
shorter prefixes, and one is taken if it fits the one before.  Where none
fits, the place can't be a border, whatever led to it: its bit is set in a
field of failed places and the search steps back, so every place fails once at
most and the work is linear.

Blanks become ``▁`` and one is put in front.  No piece runs over the start of
a word or over a line's end, so texts are cut there and every distinct part
is encoded once.  A character without a piece becomes its bytes' pieces.

Null and empty texts have no ids and decode to the empty text; texts of any
length are encoded whole, in memory of a few times the longest text; repeated
rows are encoded each; an empty table gives an empty table; other columns are
not read, whatever their names.  Only models of merge type that change nothing
but blanks and fall back to bytes are accepted; others raise ValueError.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import ship

from . import common, lexicon, wordbpe

SPACE = "▁"
#: Distinct parts of texts that a worker keeps at a time, and pairs of pieces.
KEPT, PAIRS = 350_000, 250_000
#: Longer parts are rare and are encoded anew each time.
KEPT_LENGTH = 64
#: Characters that go through the automaton at a time.
SCANNED = 1 << 16
MERGE_TYPE = 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
START = -1


class PieceBpe:
    """Vocabulary, encoder and decoder of one model file.

    Inside the search a character without a piece has the number
    ``-2 - ord(character)``.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        plain = not normal.precompiled_charsmap and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces
        if model.trainer_spec.model_type != MERGE_TYPE or not plain or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or BYTE not in kinds:
            raise ValueError(f"{path} is no merge-type model that only escapes blanks and falls back to bytes")
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p: model.pieces[i].score for p, i in self.ids.items()}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.raw = [b""] * len(self.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == NORMAL:
                self.raw[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == UNKNOWN:
                self.raw[i] = model.trainer_spec.unk_surface.encode()
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_sizes = np.array([len(r) for r in self.raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.spaced = np.array([p.startswith(SPACE) for p in self.pieces])
        self.control = frozenset(i for i, p in enumerate(model.pieces) if p.type == CONTROL)
        self.control_array = np.array(sorted(self.control), np.int32)
        self.byte_ids = frozenset(self.bytes.values())
        #: the next shorter piece that a piece starts with
        self.shorter = {i: self._prefix(p) for p, i in self.ids.items()}
        self.length = {i: len(p) for p, i in self.ids.items()}
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.matcher.add_word(piece, i)
        self.matcher.make_automaton()
        self.reach = max(self.length.values())
        self.fits: dict[tuple[int, int], bool] = {}
        inside = {c for p in self.ids for c in p if len(p) > 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            self.part = re.compile("(?s).+")
        elif "\n" in inside:
            self.part = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self.part = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
        #: a character that no piece holds, so that no match runs over it
        self.wall = next(c for c in map(chr, range(0xFDD0, 0xFFFF)) if c not in inside and c not in self.ids)

    def _prefix(self, piece: str) -> int | None:
        for n in range(len(piece) - 1, 0, -1):
            if (found := self.ids.get(piece[:n])) is not None:
                return found
        return -2 - ord(piece[0]) if len(piece) > 1 else None

    def _text(self, token: int) -> str:
        return self.pieces[token] if token >= 0 else chr(-2 - token)

    # -- merging, for short texts

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves: the pair of best score first, the leftmost of equal ones."""
        parts = list(text)
        score = self.score.get
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                found = score(parts[k] + parts[k + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, left: int, right: int) -> bool:
        """Does merging leave these two tokens as they are, side by side?"""
        found = self.fits.get((left, right))
        if found is None:
            wordbpe.forget_late(self.fits, PAIRS)
            pair = [self._text(right)] if left == START else [self._text(left), self._text(right)]
            found = self.fits[left, right] = self.merged("".join(pair)) == pair
        return found

    # -- the search

    def longest(self, text: str, place: int, end: int) -> int:
        """The longest piece that starts at a place; the character itself if there is none."""
        size = self.matcher.longest_prefix(text[place : min(end, place + self.reach)])
        find = self.ids.get
        while size:
            if (token := find(text[place : place + size])) is not None:
                return token
            size -= 1
        return -2 - ord(text[place])

    def greedy(self, text: str, begins: list[int], ends: list[int]) -> Iterator[list[int] | None]:
        """For each span the tokens that always taking the longest gives, None if some neighbours don't fit.

        The automaton finds the longest matches of all spans in one scan; no
        match runs over the wall between two spans.
        """
        fits, length = self.fits, self.length
        matches = self.matcher.iter_long(text)
        stop, token = next(matches, (len(text), None))
        for begin, end in zip(begins, ends, strict=True):
            out: list[int] = []
            place, last, good = begin, START, True
            while place < end:
                if stop < end:
                    after, now = stop + 1, token
                    start = after - length[now]
                else:
                    start = after = end
                while place < start:  # characters without a piece
                    held = -2 - ord(text[place])
                    good = good and self.fit(last, held)
                    out.append(held)
                    last = held
                    place += 1
                if start < end:
                    if good:
                        good = fits.get((last, now))
                        if good is None:
                            good = self.fit(last, now)
                    out.append(now)
                    place, last = after, now
                    stop, token = next(matches, (len(text), None))
            yield out if good else None

    def search(self, text: str, begin: int, end: int) -> list[int]:
        """The tokens of the text between two places."""
        fits, shorter, length, longest = self.fits, self.shorter, self.length, self.longest
        failed = bytearray(((end - begin) >> 3) + 1)
        out: list[int] = []
        place, last, token = begin, START, longest(text, begin, end)
        while True:
            after = place + (length[token] if token >= 0 else 1)
            bit = after - begin
            if not failed[bit >> 3] >> (bit & 7) & 1:
                good = fits.get((last, token))
                if good is None:
                    good = self.fit(last, token)
                if good:
                    out.append(token)
                    if after == end:
                        return out
                    place, last, token = after, token, longest(text, after, end)
                    continue
            token = shorter[token] if token >= 0 else None
            while token is None:
                if not out:
                    raise ValueError(f"no encoding at place {place - begin}")
                failed[(place - begin) >> 3] |= 1 << ((place - begin) & 7)
                gone = out.pop()
                place -= length[gone] if gone >= 0 else 1
                last = out[-1] if out else START
                token = shorter[gone] if gone >= 0 else None

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each part."""
        out: list[bytes] = []
        start = 0
        while start < len(parts):
            end, size = start, 0
            begins, ends = [], []
            while end < len(parts) and (end == start or size + len(parts[end]) < SCANNED):
                begins.append(size)
                ends.append(size + len(parts[end]))
                size = ends[-1] + 1
                end += 1
            text = self.wall.join(parts[start:end])
            for begin, stop, tokens in zip(begins, ends, self.greedy(text, begins, ends), strict=True):
                if tokens is None:
                    tokens = self.search(text, begin, stop)
                if min(tokens) < 0:
                    tokens = [i for t in tokens for i in ([t] if t >= 0 else map(self.bytes.__getitem__, chr(-2 - t).encode()))]
                out.append(array("i", tokens).tobytes())
            start = end
        return out

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: the blank in front goes, bytes that make no character are shown as U+FFFD."""
        if not self.control.isdisjoint(ids):
            return self._decode_runs(ids)
        joined = b"".join(map(self.raw.__getitem__, ids))
        if ids and self.pieces[ids[0]].startswith(SPACE):
            joined = joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids)

    def decode_rows(self, rows: list[bytes]) -> pa.Array:
        """The texts of many rows of little-endian 32-bit ids: the bytes of all their pieces in one gather."""
        counts = np.array([len(r) // 4 for r in rows], np.int64)
        ends = np.cumsum(counts)
        ids = np.frombuffer(b"".join(rows), "<i4")
        if len(ids) and np.isin(ids, self.control_array).any():
            return pa.array([self.decode(np.frombuffer(r, "<i4").tolist()) for r in rows], pa.string())
        starts, sizes = self.raw_starts[ids], self.raw_sizes[ids]
        firsts = (ends - counts)[counts > 0]
        firsts = firsts[self.spaced[ids[firsts]]]
        starts[firsts] += 1
        sizes[firsts] -= 1
        data = []
        for k in range(0, len(ids), SCANNED):
            size = sizes[k : k + SCANNED]
            after = np.cumsum(size)
            data.append(self.raw_flat[np.arange(after[-1]) + np.repeat(starts[k : k + SCANNED] - after + size, size)].tobytes())
        joined = b"".join(data)
        try:
            joined.decode()
        except UnicodeDecodeError:
            return pa.array([self.decode(np.frombuffer(r, "<i4").tolist()) for r in rows], pa.string())
        places = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])].astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(places), pa.py_buffer(joined)).cast(pa.string())

    def _decode_runs(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_ids:
                held += self.raw[i]
                continue
            place = 0
            while place < len(held):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(held[place : place + size]).decode())
                        place += size
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    place += 1
            held.clear()
            if i is not None and i not in self.control:
                text = self.raw[i].decode()
                out.append(text[1:] if not out and self.pieces[i].startswith(SPACE) else text)
        return "".join(out)


class Encoder:
    """Ids of whole texts; parts met before are kept, at most ``KEPT`` of them."""

    def __init__(self, bpe: PieceBpe):
        self.bpe = bpe
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        part = self.bpe.part.findall
        cut = [part(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known = self.known
        wordbpe.forget_late(known, KEPT)
        fresh = [p for p in {p for parts in cut for p in parts} if p not in known]
        known.update(zip(fresh, self.bpe.encode_parts(fresh), strict=True))
        out = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        for p in fresh:
            if len(p) > KEPT_LENGTH:
                del known[p]
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceBpe:
    return PieceBpe(path)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process; what it has met serves later tasks."""
    return Encoder(load(path))


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row."""
    return encode_decode(docs, model, key, text, decoded=False)


def encode_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """(key, ids, decoded): every text's ids and the text they decode to, by one worker, so ids cross to Python once."""
    spark = docs.sparkSession
    ship(spark)
    name = common.send_path(spark, model)

    def run(batches):
        known = encoder(common.local_file(name))
        for batch in common.slices(batches, "text", 1 << 20):
            rows = known.encode(batch.column("text").to_pylist())
            columns = {"key": batch.column("key"), "ids": lexicon.id_lists(rows)}
            if decoded:
                columns["decoded"] = known.bpe.decode_rows(rows)
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {kind}, ids array<int>" + (", decoded string" if decoded else "")
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded) of a table of ids, whichever encoder made them; null ids decode to the empty text."""
    spark = encoded.sparkSession
    ship(spark)
    name = common.send_path(spark, model)

    def run(batches):
        bpe = load(common.local_file(name))
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                rows = [np.array(row or [], "<i4").tobytes() for row in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("ids"), bpe.decode_rows(rows)], ["key", "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), "ids").mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256)."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
