"""Hashes of words and of word shingles, in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .common import Cache

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def _word(token: str) -> int:
    word = _EDGES.sub("", token)
    return (xxhash.xxh3_64_intdigest(word) | 1) if word else 0


_WORDS: Cache = Cache(_word)


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word: split at white space, lower case, without punctuation around it; what has only that is none."""
    found = np.fromiter(map(_WORDS.__getitem__, text.lower().split()), np.uint64)
    return found[found != 0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Hashes of all runs of so many words; of all words of a shorter text; none of a text without words."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(words, len(h))):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out
