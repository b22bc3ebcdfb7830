r"""Word shingles of texts as numpy arrays, for operators that run in tasks.

Words are runs without space and \x09-\x0D of the text with A-Z lower-cased (bytes.lower and bytes.split do exactly that on
UTF-8). A shingle is `width` words in a row; a text with fewer words has one, its whole word sequence; without words none.
"""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MEMO = 300_000


class _Words(dict):
    """A bounded memo of 64-bit word hashes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hash = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    span = min(width, len(w))
    n = len(w) - span + 1
    h = np.full(n, span, np.uint64)
    for k in range(span):
        h = h * _BASE + mixed(w[k : k + n])
    return np.unique(mixed(h))


def linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether 100 * intersection >= percent * union; empty sets link with nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
