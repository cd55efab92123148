"""Operators 2, 7 and 10 against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import common, lexicon, prefixcount, queries, tokenfile, wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abethn'sltremvd !!<|>&é́ÀßİΣ中가ᄀ1२½  \u0085 ​　\n\r\x1c\x1e"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(1)
    some = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return [*some, "a" * 3000, "x<|endoftext|>y", "!<|startoftext|><|endoftext|", "it'll we've don't", " \n"]


def test_texts_match_the_library(library, tmp_path):
    given = texts()
    expected = [e.ids for e in library.encode_batch(given, add_special_tokens=False)]
    bpe = wordbpe.load(PATH)
    assert [bpe.text_ids(t) for t in given] == expected
    words = sorted({w for t in given for w in bpe.words(t) if "<|" not in w})
    file = tmp_path / "words.lexicon"
    file.write_bytes(lexicon.compile_lexicon(words[::2], bpe))
    automaton = lexicon.Lexicon(str(file))
    places = automaton.places([w.encode() for w in words])
    assert all((p >= 0) == (k % 2 == 0 and len(w.encode()) <= lexicon.LEXICON_BYTES) for k, (w, p) in enumerate(zip(words, places, strict=True)))
    assert [np.frombuffer(r, "<i4").tolist() for r in lexicon.Encoder(bpe, automaton).encode(given)] == expected
    assert [np.frombuffer(r, "<u2").tolist() for r in tokenfile.LibraryEncoder(PATH, "<u2").encode(given)] == expected


def test_automaton_shares_suffixes(tmp_path):
    bpe = wordbpe.load(PATH)
    file = tmp_path / "words.lexicon"
    file.write_bytes(lexicon.compile_lexicon(["walking", "talking", "stalking"], bpe))
    assert len(lexicon.Lexicon(str(file)).accepts) == 9  # "alking" once, and "", "s", "st"/"w"/"t" share states
    empty = tmp_path / "none.lexicon"
    empty.write_bytes(lexicon.compile_lexicon([], bpe))
    assert lexicon.Lexicon(str(empty)).places([b"a", b""]).tolist() == [-1, -1]


def test_every_prefix_count(library):
    counter = prefixcount.PrefixCounter(wordbpe.load(PATH))
    for text in texts()[:150] + texts()[-4:]:
        prefixes = [text[:k] for k in range(1, len(text) + 1)]
        expected = [len(e.ids) for e in library.encode_batch(prefixes, add_special_tokens=False)]
        assert counter.text(text).tolist() == expected


def test_queries(spark, small, documents, library):
    ids = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in documents.items()}
    found = {r.doc_id: r for r in queries.op2_bpe(spark, small).collect()}
    counts = {r.doc_id: r for r in queries.op10_token_counts(spark, small).collect()}
    files = {r.doc_id: r for r in queries.op7_token_file(spark, small).collect()}
    start = 0
    for key in sorted(ids):
        expected, r = ids[key], found[key]
        assert r.n_tokens == len(expected)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(expected, skip_special_tokens=False).encode()).hexdigest()
        assert (counts[key].n_bytes, counts[key].n_tokens, counts[key].over_limit) == (len((documents[key] or "").encode()), len(expected), len(expected) > 2048)
        crc = zlib.crc32(np.array([*expected, 2], "<u4").tobytes())
        assert (files[key].start, files[key].n_tokens, files[key].ids_crc32) == (start, len(expected) + 1, crc)
        start += len(expected) + 1


def test_odd_rows(spark, odd):
    decoded = lexicon.encode_decode(odd, PATH)
    assert decoded.count() == 6 and decoded.where("doc_id = 2").first().ids == []
    counted = prefixcount.prefix_counts(odd, PATH)
    assert sorted(r.n_tokens for r in prefixcount.digests(counted, 5).collect()) == [0, 0, 1, 5, 21000, 21000]
    folder = common.shared_folder(spark, "test-tokens")
    manifest = tokenfile.write(odd, PATH, folder)
    assert tokenfile.read_documents(manifest, folder, "bigint").count() == 6
    none = odd.where("false")
    assert lexicon.encode_decode(none, PATH).count() == 0 and prefixcount.prefix_counts(none, PATH).count() == 0
    folder = common.shared_folder(spark, "test-tokens")
    assert tokenfile.read_documents(tokenfile.write(none, PATH, folder), folder, "bigint").count() == 0


def test_sequences_are_read_without_copies(tmp_path):
    writer = tokenfile.SequenceWriter(f"file://{tmp_path}", "x.arrow", "<u2", 16)
    ids = np.arange(16 * tokenfile.BATCH + 40, dtype="<u2")
    for part in np.split(ids, [7, 100, 1000]):
        writer.add(part.tobytes())
    writer.close()
    reader = tokenfile.SequenceReader(f"file://{tmp_path}", "x.arrow")
    sequence, mask = reader.sequence(tokenfile.BATCH + 2)
    assert sequence[:8].tolist() == ids[-8:].tolist() and mask.to_pylist() == [True] * 8 + [False] * 8
    assert not sequence.flags.owndata
    assert reader.tokens(5, 1030).tolist() == ids[5:1035].tolist()
