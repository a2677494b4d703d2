"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_P = np.uint64(0x9E3779B97F4A7C55)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _GAMMA
    x ^= x >> np.uint64(30)
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


def words_of(values: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word (split at white space), its text's index, and its start and end.

    ``fold`` lower-cases A-Z. Places count through all texts with a space after each.
    """
    data = np.frombuffer(b" ".join([*values, b""]), np.uint8)
    ends_of = np.cumsum([len(v) + 1 for v in values]) if values else np.zeros(0, np.int64)
    inner = ~_SPACE[data]
    edge = np.diff(inner.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts, ends
    lengths = ends - starts
    longest = int(lengths.max())
    powers = np.cumprod(np.full(longest, _P, np.uint64))
    chars = np.flatnonzero(inner)
    offsets = np.cumsum(lengths) - lengths
    codes = _LOWER[data[chars]] if fold else data[chars].astype(np.uint64)
    terms = (codes + np.uint64(1)) * powers[chars - np.repeat(starts, lengths)]
    return mixed(np.add.reduceat(terms, offsets)), np.searchsorted(ends_of, starts, "right"), starts, ends


def word_hashes(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (A-Z lower-cased) and its text's index."""
    return words_of(values)[:2]


def shingles(values: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: text index, hash, multiplicity; sorted by text, then hash.

    A text of fewer words has one shingle of them all; a text without words none.
    """
    hashes, doc = word_hashes(values)
    counts = np.bincount(doc, minlength=len(values))
    n = len(hashes)
    parts_h, parts_d = [], []
    if n >= words:
        start = np.arange(n - words + 1)
        start = start[doc[: n - words + 1] == doc[words - 1 :]]
        h = hashes[start]
        for k in range(1, words):
            h = mixed(h * _P + hashes[start + k])
        parts_h.append(h)
        parts_d.append(doc[start])
    few = (counts > 0) & (counts < words)
    if few.any():
        firsts = np.cumsum(counts) - counts
        for k in range(1, words):
            of_k = np.flatnonzero(counts == k)
            h = mixed(hashes[firsts[of_k]] + np.uint64(k))
            for i in range(1, k):
                h = mixed(h * _P + hashes[firsts[of_k] + i])
            parts_h.append(h)
            parts_d.append(of_k)
    if not parts_h:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    h, d = np.concatenate(parts_h), np.concatenate(parts_d)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
    return d[new], h[new], np.diff(np.append(new, len(h))).astype(float)
