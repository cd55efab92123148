"""The word-level byte pair encoding of a tokenizers file, without the library.

A text is cut at the special strings, each piece is normalised (NFC, lower
case one character at a time), split into words by the file's pattern, and
every word is encoded on its own: its bytes are base symbols, the last one
with the end-of-word mark, and the adjacent pair of lowest rank, leftmost
first, is merged until no pair has a rank.  Since words are independent, a
text's ids are the ids of its words in order.

Null is the empty text.  Works on one word or text at a time; memory is
bounded by the longest text.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata

import numpy as np
import regex

ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
#: Characters outside these ranges change class or case between Unicode
#: versions; texts that hold one are cut by the library's own tables.
UNSETTLED = re.compile("[^\x00-\u052f\u1e00-\u1eff\u2000-\u2060\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")
INK = re.compile(r"[\S\x1c-\x1f]+")
SHORT = 48
NO_RANK = 1 << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairTable:
    """Ranks of symbol pairs for whole arrays: open addressing, as many probes as the fullest run needs."""

    BITS = 20

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        size = 1 << self.BITS
        keys = [-1] * (size + 64)
        ranks = [NO_RANK] * (size + 64)
        self.probes = 1
        for (a, b), (rank, _) in merges.items():
            key = a << 20 | b
            slot = self.slot(key)
            first = slot
            while keys[slot] != -1:
                slot += 1
            keys[slot], ranks[slot] = key, rank
            self.probes = max(self.probes, slot - first + 1)
        self.keys, self.rank = np.array(keys, np.int64), np.array(ranks, np.int64)
        self.merged = np.array([new for _, new in sorted(merges.values())], np.int64)

    def slot(self, key):
        return (key * 0x9E3779B1 >> 11) & ((1 << self.BITS) - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        slot = self.slot(key)
        found = np.where(self.keys[slot] == key, self.rank[slot], NO_RANK)
        for probe in range(1, self.probes):
            hit = self.keys[slot + probe] == key
            if hit.any():
                found[hit] = self.rank[slot + probe][hit]
        return found


class WordBpe:
    """Vocabulary, merges and splitting of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocabulary = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: (left id, right id) -> (rank, merged id)
        self.merges = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        shown = byte_symbols()
        self.inner = [vocabulary[c] for c in shown]
        self.final = [vocabulary[c + self.end] for c in shown]
        self.inner_array, self.final_array = np.array(self.inner), np.array(self.final)
        self.pairs = PairTable(self.merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]
        self.path = path
        self.back = back = {c: b for b, c in enumerate(shown)}
        #: bytes of a token -> its id, for tokens inside a word and at its end
        self.inside, self.at_end = {}, {}
        for token, i in vocabulary.items():
            ended = bool(self.end) and token.endswith(self.end)
            body = token[: -len(self.end)] if ended else token
            (self.at_end if ended else self.inside)[bytes(back[c] for c in body)] = i
        self.longest = max(map(len, [*self.inside, *self.at_end]))
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    # -- texts to words

    @staticmethod
    def normal(text: str) -> str:
        """Lower case of the composed form, each character by itself."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def words(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        if text.isascii():
            return ASCII_WORD.findall(text.lower())
        if UNSETTLED.search(text):
            return self.library_words(text)
        return self.word.findall(self.normal(text))

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Runs without white space; words never cross it.  The four separators that only Python calls blank stay."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return INK.findall(text)
        return text.split()

    def library_words(self, text: str) -> list[str]:
        library = library_at(self.path)
        normal = library.normalizer.normalize_str(text)
        return [bytes(map(self.back.__getitem__, word)).decode() for word, _ in library.pre_tokenizer.pre_tokenize_str(normal)]

    def parts(self, text: str) -> list[str]:
        """Text, special string, text, ... of a raw text."""
        return self.cut.split(text) if "<" in text else [text]

    # -- words to ids

    def symbols(self, word: bytes) -> list[int]:
        return [self.inner[b] for b in word[:-1]] + [self.final[word[-1]]] if word else []

    def merged(self, ids: list[int]) -> list[int]:
        """Merge until no adjacent pair has a rank."""
        if len(ids) > SHORT:
            return self._merged_long(ids)
        find = self.merges.get
        while len(ids) > 1:
            best, at = None, 0
            left = ids[0]
            for k in range(1, len(ids)):
                right = ids[k]
                found = find((left, right))
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, k
                left = right
            if best is None:
                break
            ids[at - 1 : at + 1] = [best[1]]
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list: n log n for words without a break."""
        n, find = len(ids), self.merges.get
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        heap = [(*found, k) for k in range(n - 1) if (found := find((ids[k], ids[k + 1])))]
        heap = [(rank, k, new) for rank, new, k in heap]
        heapq.heapify(heap)
        while heap:
            _, k, new = heapq.heappop(heap)
            right = after[k]
            if ids[k] < 0 or right < 0:
                continue
            found = find((ids[k], ids[right]))
            if found is None or found[1] != new:
                continue
            ids[k], ids[right] = new, -1
            after[k] = after[right]
            if after[right] >= 0:
                before[after[right]] = k
                if found := find((new, ids[after[k]])):
                    heapq.heappush(heap, (found[0], k, found[1]))
            if (left := before[k]) >= 0 and (found := find((ids[left], new))):
                heapq.heappush(heap, (found[0], left, found[1]))
        return [i for i in ids if i >= 0]

    def ids_of(self, words: list[str]) -> list[list[int]]:
        """Ids of many words at once: every round merges the best pair of each word that still has one."""
        out: list[list[int]] = [[]] * len(words)
        texts = [w.encode() for w in words]
        by_size: dict[int, list[int]] = {}
        for k, text in enumerate(texts):
            if len(text) > SHORT:
                out[k] = self.merged(self.symbols(text))
            else:
                by_size.setdefault(len(text), []).append(k)
        for size, group in by_size.items():
            if size == 0:
                continue
            for start in range(0, len(group), 4096):
                some = group[start : start + 4096]
                flat = np.frombuffer(b"".join([texts[k] for k in some]), np.uint8).reshape(len(some), size)
                ids = np.concatenate([self.inner_array[flat[:, :-1]], self.final_array[flat[:, -1:]]], axis=1)
                ids, left = self._merged_rows(ids)
                for k, row, n in zip(some, ids.tolist(), left.tolist(), strict=True):
                    out[k] = row[:n]
        return out

    def _merged_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of symbols of one length, merged; and how many symbols each row has left."""
        n, width = ids.shape
        left = np.full(n, width)
        if width == 1:
            return ids, left
        rank = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        rank = np.concatenate([rank, np.full((n, 2), NO_RANK, np.int64)], axis=1)
        ids = np.concatenate([ids, np.zeros((n, 1), ids.dtype)], axis=1)
        place = np.arange(width + 1)
        rows = np.arange(n)
        while len(rows):
            at = rank[rows].argmin(axis=1)
            best = rank[rows, at]
            going = best < NO_RANK
            rows, at, best = rows[going], at[going], best[going]
            if not len(rows):
                break
            source = np.minimum(place + (place > at[:, None]), width)
            ids[rows] = ids[rows[:, None], source]
            rank[rows] = rank[rows[:, None], source]
            ids[rows, at] = self.pairs.merged[best]
            left[rows] -= 1
            right = np.where(at + 1 < left[rows], self.pairs.ranks(ids[rows, at], ids[rows, np.minimum(at + 1, width)]), NO_RANK)
            rank[rows, at] = right
            inner = at > 0
            some, before = rows[inner], at[inner] - 1
            rank[some, before] = self.pairs.ranks(ids[some, before], ids[some, before + 1])
        return ids, left

    def word_ids(self, word: str) -> list[int]:
        return self.merged(self.symbols(word.encode()))

    def text_ids(self, text: str | None) -> list[int]:
        """Ids of a whole text, word by word; the plain form of the batch encoders."""
        out = []
        for k, part in enumerate(self.parts(text or "")):
            if k % 2:
                out.append(self.special[part])
            else:
                for word in self.words(part):
                    out += self.word_ids(word)
        return out


def forget_late(known: dict, most: int) -> None:
    """Keep the first half of a full table: what is met first is what is met often."""
    if len(known) > most:
        for key in list(known)[most // 2 :]:
            del known[key]


@functools.lru_cache(maxsize=4)
def library_at(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """One vocabulary for each worker process."""
    return WordBpe(path)
