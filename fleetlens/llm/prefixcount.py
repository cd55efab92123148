"""Operator 10: exact token counts of every prefix of every text.

A word's prefixes are counted by dynamic programming: the encoding of a
prefix ends in the one token that ends there and stands next to the last
token of the prefix before it without the merges ever joining across them,
so its count is that prefix's count and one.  Counts inside a text are the
sum over the words before and the count inside the current word.  They say
how long a truncated text is, and how much of a text fits a budget, without
encoding again.

``counts[p - 1]`` is the number of tokens the library gives for the first
``p`` characters of the raw text taken as a whole text; special strings are
one token as soon as they are complete.  Counts can fall as a word grows.
Null is the empty text and has no counts; other columns are not read.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import ship

from . import common, wordbpe

#: Distinct words a worker keeps at a time; chunks and token pairs twice as many.
KEPT = 400_000
SPLIT_WHEN_CUT = ("'re", "'ve", "'ll")


@functools.lru_cache(maxsize=2)
def counter_of(vocabulary: str) -> PrefixCounter:
    """One counter for each worker process; what it has met serves later tasks."""
    return PrefixCounter(wordbpe.load(vocabulary))


def _matcher(tokens: dict[bytes, int]) -> ahocorasick.Automaton:
    """Finds all tokens that end at each byte of a text."""
    found = ahocorasick.Automaton()
    for token, i in tokens.items():
        found.add_word(token.decode("latin-1"), i)
    found.make_automaton()
    return found


class PrefixCounter:
    """Counts for one vocabulary."""

    def __init__(self, bpe: wordbpe.WordBpe):
        self.bpe = bpe
        self.inner_ends, self.final_ends = _matcher(bpe.inside), _matcher(bpe.at_end)
        self.length = {i: len(t) for tokens in (bpe.inside, bpe.at_end) for t, i in tokens.items()}
        self.base = {i: [bpe.inner[b] for b in t] for t, i in bpe.inside.items()}
        self.base |= {i: bpe.symbols(t) for t, i in bpe.at_end.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.words: dict[str, list[int]] = {}

    def fit(self, left: int, right: int) -> bool:
        """Do the merges leave these two tokens as they are, side by side?  left -1: the start of a word."""
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) > 2 * KEPT:
                self.fits.clear()
            if left < 0:
                found = self.bpe.merged(list(self.base[right])) == [right]
            else:
                found = self.bpe.merged(self.base[left] + self.base[right]) == [left, right]
            self.fits[left, right] = found
        return found

    def word(self, word: str) -> list[int]:
        """Token count of each prefix of a word, as a word of its own."""
        if word not in self.words:
            self.count_words([word])
        return self.words[word]

    def count_words(self, words: Iterable[str]) -> None:
        """Put the counts of all words into ``words``."""
        words = {w for w in words if w not in self.words}
        cut = words.intersection(SPLIT_WHEN_CUT)
        for word in words | {w[1] for w in cut}:
            self.words[word] = self._prefixes(word)
        for word in cut:  # after its second character it is two words
            counts = self.words[word]
            self.words[word] = [counts[0], counts[0] + self.words[word[1]][0], counts[2]]

    def _prefixes(self, word: str) -> list[int]:
        """The dynamic program over a word's bytes: counts inside a word, then of each prefix as a whole word.

        Only one of the tokens that end at a place can stand there, so the
        first that fits is it.
        """
        text = word.encode()
        n, shown = len(text), text.decode("latin-1")
        fits, fit, length = self.fits, self.fit, self.length
        counts, last, done = [0] * (n + 1), [-1] * (n + 1), 0
        for end, token in self.inner_ends.iter(shown):
            end += 1
            if end == done:
                continue
            start = end - length[token]
            left = last[start]
            good = fits.get((left, token))
            if good or good is None and fit(left, token):
                counts[end], last[end], done = counts[start] + 1, token, end
        whole, done = [0] * (n + 1), 0
        for end, token in self.final_ends.iter(shown):
            end += 1
            if end == done:
                continue
            start = end - length[token]
            left = last[start]
            good = fits.get((left, token))
            if good or good is None and fit(left, token):
                whole[end], done = counts[start] + 1, end
        if 0 in whole[1:] or 0 in counts[1:]:
            raise ValueError(f"no encoding of a prefix of {word!r} ends in a token")
        if n == len(word):
            return whole[1:]
        return [whole[i] for i in range(1, n + 1) if i == n or text[i] & 0xC0 != 0x80]

    def chunk(self, chunk: str) -> bytes:
        """Counts of every prefix of a piece without a blank and of the piece with one blank after it, as 32-bit numbers."""
        bpe = self.bpe
        words = bpe.words(chunk)
        if not chunk.isascii() and not self._by_character(chunk, words):
            out = [sum(self.word(w)[-1] for w in bpe.words(chunk[:j])) for j in range(1, len(chunk) + 1)]
        elif words and sum(map(len, words)) == len(chunk):
            out, before = [], 0
            for word in words:
                out += [before + n for n in self.word(word)]
                before = out[-1]
        else:  # with other white space inside
            out, before = [], 0
            rest = iter(words)
            word = next(rest, None)
            held: list[int] = []
            for c in chunk:
                if c.isspace() and not "\x1c" <= c <= "\x1f":
                    out.append(before)
                    continue
                if not held:
                    held, word = [before + n for n in self.word(word)][::-1], next(rest, None)
                out.append(held.pop())
                before = out[-1]
        return np.array([*out, out[-1] if out else 0], "<i4").tobytes()

    @staticmethod
    def _by_character(chunk: str, words: list[str]) -> bool:
        """Is each character of the normal form made of one character here, whatever follows?"""
        inked = sum(1 for c in chunk if not c.isspace() or "\x1c" <= c <= "\x1f")
        return unicodedata.is_normalized("NFC", chunk) and "İ" not in chunk and sum(map(len, words)) == inked

    def learn(self, chunks: set[str]) -> None:
        fresh = [c for c in chunks if c not in self.known]
        if not fresh:
            return
        wordbpe.forget_late(self.known, 2 * KEPT)
        wordbpe.forget_late(self.words, KEPT)
        self.count_words({w for c in fresh for w in self.bpe.words(c)})
        for chunk in chunks:
            if chunk not in self.known:
                self.known[chunk] = self.chunk(chunk)

    def plain(self, text: str) -> np.ndarray:
        """Counts of a text without special strings."""
        if not text:
            return np.empty(0, np.int32)
        chunks = text.split(" ")
        known = self.known
        self.learn(set(chunks))
        counts = np.frombuffer(b"".join(map(known.__getitem__, chunks)), "<i4")
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
        totals = counts[np.cumsum(lengths) - 1]
        before = (np.cumsum(totals) - totals).astype(np.int32)
        return (counts + np.repeat(before, lengths))[: len(text)]

    def text(self, text: str | None) -> np.ndarray:
        """Counts of every prefix of a raw text."""
        text = text or ""
        parts = self.bpe.parts(text)
        if len(parts) == 1:
            return self.plain(text)
        out, before = [], 0
        for k in range(0, len(parts), 2):
            special = parts[k + 1] if k + 1 < len(parts) else ""
            counts = self.plain(parts[k] + special[:-1])  # up to its last character a special string is text
            out.append(counts + before)
            if special:
                before += (int(counts[len(parts[k]) - 1]) if parts[k] else 0) + 1
                out.append(np.array([before], np.int32))
        return np.concatenate(out).astype(np.int32)


def prefix_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, counts array<int>) of every row."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = common.send_path(spark, tokenizer)

    def run(batches):
        counter = counter_of(common.local_file(vocabulary))
        for batch in common.slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            met: set[str] = set()
            for value in texts:
                if "<" not in (value or ""):
                    met.update(value.split(" "))
            counter.learn(met)
            rows = [counter.text(t) for t in texts]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), lists], ["key", "n_bytes", "counts"])

    kind = docs.schema[key].dataType.simpleString()
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.col(key).alias("key"), whole.alias("text"), F.octet_length(whole).cast("long").alias("n_bytes"))
    return source.mapInArrow(run, f"key {kind}, n_bytes long, counts array<int>").withColumnRenamed("key", key)


def total(counts: Column) -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.get(counts, F.size(counts) - 1), F.lit(0)).cast("long")


def tokens_at(counts: Column, characters: Column | int) -> Column:
    """Tokens of the first ``characters`` characters; of the whole text if it is shorter."""
    place = F.least(F.lit(characters) if isinstance(characters, int) else characters, F.size(counts))
    return F.coalesce(F.get(counts, place - 1), F.lit(0)).cast("long")


def longest_within(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fitting = F.transform(counts, lambda n, p: F.when(n <= budget, p + 1))
    return F.coalesce(F.array_max(fitting), F.lit(0)).cast("long")


def digests(counted: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit)."""
    return counted.select(key, "n_bytes", total(F.col("counts")).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
