"""Sets of word shingles as 64-bit hashes, made in numpy from the bytes of a text."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a worker remembers.
REMEMBERED = 100_000
#: Odd multipliers, one for each place in a shingle, from the golden ratio's fraction.
PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 | 1 for i in range(64)], np.uint64)
_33 = np.uint64(33)
#: The multipliers of the usual 64-bit finaliser.
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> _33)) * _M1
    h = (h ^ (h >> _33)) * _M2
    return h ^ (h >> _33)


class WordHashes(dict):
    """word -> hash, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


WORDS = WordHashes()


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text: A-Z lowered, split at ASCII white space."""
    words = text.lower().split() if text else []
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of so many words; a shorter text is one shingle; none without words."""
    ids = word_hashes(text)
    n = len(ids)
    if n == 0:
        return ids
    if n < width:
        return mixed(np.array([(ids * PLACES[:n]).sum() + np.uint64(n)], np.uint64))
    h = ids[: n - width + 1] * PLACES[0]
    for j in range(1, width):
        h = h + ids[j : n - width + 1 + j] * PLACES[j]
    return np.unique(mixed(h))


def set_hash(shingles: np.ndarray, seed: int = 0) -> int:
    """A signed 64-bit name of a set; equal sets have equal names."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed) - 2**63
