"""Word shingles as 64-bit hashes, for Arrow batches of UTF-8 texts."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_U = np.uint64
WIDTH = 5  # words in a shingle
#: Multipliers of a public 64-bit finalizer (a bijection on 64-bit integers).
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_STEP = _U(0x9E3779B97F4A7C15)
_S33 = _U(33)


def mix(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """A fixed permutation of the 64-bit integers; works in place when ``out`` is ``x``."""
    y = np.bitwise_xor(x, x >> _S33, out=out)
    y *= _M1
    y ^= y >> _S33
    y *= _M2
    y ^= y >> _S33
    return y


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, filled on first use and emptied when it holds too many words."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: bytes, cache: WordHashes) -> np.ndarray:
    """One hash per word of the text, A-Z lower-cased; words are split at space and 0x09 to 0x0D."""
    words = text.lower().split()
    return np.fromiter(map(cache.__getitem__, words), dtype=_U, count=len(words))


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hash of every ``width``-word window, in order; a shorter text gives its whole sequence as one."""
    n = len(words)
    if n == 0:
        return words
    size = min(n, width)
    with np.errstate(over="ignore"):
        h = np.full(n - size + 1, _U(size), dtype=_U)
        for k in range(size):
            h *= _STEP
            h += words[k:n - size + 1 + k]
        return mix(h, out=h)


def shingle_set(text: bytes, cache: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(shingles(word_hashes(text, cache), width))


def set_key(distinct: np.ndarray) -> bytes:
    """128-bit digest of a sorted shingle set: equal for equal sets."""
    return hashlib.blake2b(distinct.tobytes(), digest_size=16).digest()
