"""Words of a text as 64-bit codes, and hashes of runs of words."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile("[a-z0-9]+")
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_S33, _S29 = np.uint64(33), np.uint64(29)


class WordCodes(dict):
    """Codes of words seen so far; forgets all when it holds ``most`` words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S33)) * _MIX
    return h ^ (h >> _S29)


def runs(codes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every ``width`` consecutive words, in order."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = codes[:n].copy()
    for i in range(1, width):
        h = mix(h * _STEP + codes[i : i + n])
    return mix(h)


def shingles(text: str, width: int, known: WordCodes) -> np.ndarray:
    """The distinct hashes of ``width`` consecutive words of the whole text, sorted."""
    words = WORD.findall(text.lower())
    return np.unique(runs(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), width))
