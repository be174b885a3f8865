"""Sets of word shingles, computed on UTF-8 buffers."""

from __future__ import annotations

import numpy as np

from dialogue_factors.llm.common import mix

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
# The bytes that part words, and A-Z in lower case.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts in turn, and the offsets of each text."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = ~space & edge[:-1]
    begins[1:] |= ~space[1:] & space[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    per_text = np.searchsorted(starts, offsets)
    # Every byte adds its value, spread by a table, times a power of the base for its
    # place in the word; a word's hash is the sum over its bytes.
    number = np.cumsum(begins) - 1
    place = np.arange(len(data)) - starts[np.maximum(number, 0)]
    powers = np.cumprod(np.full(int(place[~space].max()) + 1, _BASE, np.uint64))
    table = mix(np.arange(1, 257, dtype=np.uint64))
    terms = table[_LOWER[data]] * powers[np.maximum(place, 0) % len(powers)]
    terms[space] = 0
    return mix(np.add.reduceat(terms, starts)), per_text


def shingle_sets(data: np.ndarray, offsets: np.ndarray, frequent: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: five words in turn, or all of fewer.

    The three highest bits of a shingle count its words that are in `frequent` (sorted
    hashes), so that in ascending order those of rare words come first.
    """
    words, cuts = word_hashes(data, offsets)
    common = np.zeros(len(words), np.uint64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
        common = (frequent[at] == words).astype(np.uint64)
    out = []
    rolled = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    rank = np.zeros(len(rolled), np.uint64)
    for j in range(WORDS):
        rolled = mix(rolled * _BASE + words[j:j + len(rolled)])
        rank += common[j:j + len(rolled)]
    rolled = rank << np.uint64(61) | rolled >> np.uint64(3)
    for low, high in zip(cuts[:-1], cuts[1:]):
        if high - low >= WORDS:
            out.append(np.unique(rolled[low:high - WORDS + 1]))
        elif high > low:
            whole = np.full(1, high - low, np.uint64)
            for w in words[low:high]:
                whole = mix(whole * _BASE + w)
            out.append(whole >> np.uint64(3))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
