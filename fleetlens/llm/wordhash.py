"""64-bit hashes of all words of many texts at once.

Words are runs of letters a-z (A-Z lower-cased), digits and bytes above 127.
A word's hash is a polynomial of its bytes, taken from one running sum over
the whole block, so no word becomes a Python object.
"""

from __future__ import annotations

import numpy as np

_BLANK = 0x20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else _BLANK for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_VALUES[_BLANK] = 0
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    """1, base, base^2, ...; kept for the longest block so far."""
    if name not in _powers or len(_powers[name]) < n:
        table = np.full(n + n // 4, base, np.uint64)
        table[0] = 1
        _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers[name][:n]


def hashes(texts: list[bytes | None], fold: bytes = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order (``fold`` maps bytes, separators to a blank), and where each text's words start (one place more than texts)."""
    block = (b" ".join(t or b"" for t in texts) + b" ").translate(fold)
    codes = np.frombuffer(block, np.uint8)
    inked = codes != _BLANK
    edge = np.diff(inked.view(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.cumsum(_VALUES[codes] * _power(_BASE, len(codes), "up"), dtype=np.uint64)
    before = np.where(start > 0, sums[start - 1], np.uint64(0))
    words = mix((sums[end - 1] - before) * _power(_INVERSE, len(codes), "down")[start] + (end - start).astype(np.uint64))
    begins = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return words, np.searchsorted(start, begins)
