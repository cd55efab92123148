"""Operator 13 against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from fleetlens.llm import piecebpe, queries

MODEL = public_tokenizers.path(queries.PIECES)
ODD = list("  \n\t▁abcdefgehinorst<>/sé̀ü中文字あ\x00​﻿　\U0001f600﷐.,12#")
ODD += ["the", "ing", "    ", " " * 17, "\r\n", "<0x0A>", "<unk>", "<s>", "aaaa", "----", "\n\n\n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def bpe():
    return piecebpe.load(MODEL)


def fuzzed(bpe):
    draw = random.Random(13)
    pool = ODD + bpe.pieces[259::7]
    texts = ["".join(draw.choice(pool) for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(draw.choice(" a▁\n") for _ in range(draw.randint(0, 60))) for _ in range(500)]
    texts += ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(0, 80))) for _ in range(500)]
    texts += [chr(draw.choice([draw.randint(0, 0xD7FF), draw.randint(0xE000, 0x10FFFF)])) * draw.randint(1, 5) for _ in range(500)]
    return texts + [c * n for c in " a-\n" for n in range(0, 150, 7)]


def test_encode_and_decode(bpe, library):
    texts = fuzzed(bpe)
    for text, ids, row in zip(texts, library.encode(texts), piecebpe.Encoder(bpe).encode(texts), strict=True):
        assert np.frombuffer(row, "<i4").tolist() == ids, repr(text)
        assert bpe.decode(ids) == library.decode(ids), repr(text)


def test_decode_of_any_ids(bpe, library):
    draw = random.Random(7)
    rows = [[draw.choice([draw.randint(0, 31999), draw.randint(3, 258), draw.randint(0, 3), 259, 28705]) for _ in range(draw.randint(0, 12))] for _ in range(3000)]
    for ids in rows:
        assert bpe.decode(ids) == library.decode(ids), ids
        assert bpe.decode_rows([np.array(ids, "<i4").tobytes(), b""]).to_pylist() == [library.decode(ids), ""]
    plain = [[i for i in ids if i > 258] for ids in rows]
    assert bpe.decode_rows([np.array(ids, "<i4").tobytes() for ids in plain]).to_pylist() == library.decode(plain)
    assert bpe.decode_rows([]).to_pylist() == []


def test_decode_in_steps(bpe, library, monkeypatch):
    monkeypatch.setattr(piecebpe, "SCANNED", 7)
    texts = fuzzed(bpe)
    rows = piecebpe.Encoder(bpe).encode(texts)
    assert bpe.decode_rows(rows).to_pylist() == library.decode(library.encode(texts))


def test_longest_is_the_longest(bpe):
    text = "▁international\n▁▁▁x中￰"
    for k in range(len(text)):
        known = [text[k:n] for n in range(k + 1, len(text) + 1) if text[k:n] in bpe.ids]
        assert bpe._text(bpe.longest(text, k, len(text))) == (max(known, key=len) if known else text[k])


def test_greedy_takes_the_longest(bpe):
    """The scan's matches are the longest from place to place, in every part."""
    parts = ["▁international", "\n", "▁▁▁x中￰", "￰", "▁the", bpe.wall, "▁" * 40, "▁unbelievably", "abcabc"]
    text = bpe.wall.join(parts)
    begins = [sum(len(p) + 1 for p in parts[:k]) for k in range(len(parts))]
    ends = [b + len(p) for b, p in zip(begins, parts, strict=True)]
    for part, tokens in zip(parts, bpe.greedy(text, begins, ends), strict=True):
        want, place = [], 0
        while place < len(part):
            want.append(bpe.longest(part, place, len(part)))
            place += len(bpe._text(want[-1]))
        fitting = bpe.fit(-1, want[0]) and all(bpe.fit(a, b) for a, b in zip(want, want[1:]))
        assert tokens == (want if fitting else None)


def test_search_marks_and_steps_back(bpe):
    """Some words need a shorter piece than the longest at their start; the search also gives what the scan gives."""
    words = ["▁" + p for p in bpe.pieces[300:9000] if p.isalpha() and p.isascii()]
    short = 0
    for word, row in zip(words, bpe.encode_parts(words), strict=True):
        want = bpe.merged(word)
        short += want[0] != bpe._text(bpe.longest(word, 0, len(word)))
        assert [bpe.pieces[i] for i in np.frombuffer(row, "<i4")] == want
        assert list(map(bpe._text, bpe.search(word, 0, len(word)))) == want
    assert short > 0


def test_long_texts(bpe, library):
    draw = random.Random(3)
    for text in ("ab" * 200_000, " " * 100_000, "".join(draw.choice("abc中é\n") for _ in range(200_000)), "word " * 100_000):
        row = piecebpe.Encoder(bpe).encode([text])[0]
        assert np.frombuffer(row, "<i4").tolist() == library.encode(text)


def test_kept_parts_are_bounded(bpe, library, monkeypatch):
    monkeypatch.setattr(piecebpe, "KEPT", 10)
    monkeypatch.setattr(piecebpe, "SCANNED", 50)
    known = piecebpe.Encoder(bpe)
    texts = [f"word{k} and {k % 3} more " + "x" * k for k in range(90)]
    for k in range(0, 90, 30):
        some = texts[k : k + 30]
        assert [np.frombuffer(r, "<i4").tolist() for r in known.encode(some)] == library.encode(some)
    assert max(map(len, known.known)) <= piecebpe.KEPT_LENGTH


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    other = tmp_path / "other.model"
    other.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        piecebpe.PieceBpe(str(other))


def test_whole_table(spark, small, documents, library):
    seen = 0
    for r in queries.op13_sentence_pieces(spark, small).collect():
        ids = library.encode(documents[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        seen += 1
    assert seen == len(documents)


def test_odd_table(spark, odd, library):
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    both = piecebpe.encode_decode(odd.withColumn("key", odd.doc_id).withColumn("a.b", odd.text), MODEL)
    rows = both.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id])
        assert r.decoded == library.decode(r.ids)
    assert {tuple(r) for r in piecebpe.digests(piecebpe.decode(piecebpe.encode(odd, MODEL), MODEL)).collect()} == {tuple(r) for r in piecebpe.digests(both).collect()}
    none = odd.limit(0)
    assert piecebpe.digests(piecebpe.encode_decode(none, MODEL)).collect() == []
