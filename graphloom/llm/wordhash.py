"""Words and word shingles as 64-bit hashes, computed for whole batches of texts in numpy.

A word is a maximal run of bytes other than space and U+0009 to U+000D, so UTF-8 needs no decoding.
A word's hash is a polynomial over its bytes modulo 2**64, mixed; a shingle's hash combines the
hashes of its words by position. Equal words always have equal hashes.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A byte's digit in the polynomial; white space adds nothing.
_CODE = np.where(_WS, 0, np.arange(1, 257)).astype(np.uint16)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse, for i below n at least."""
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _POW, _INV = np.cumprod(up), np.cumprod(down)
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """(start, end, doc, hash) of each word; starts and ends are byte positions in data."""
    if lower:
        data = _LOWER[data]
    ink = ~_WS[data]
    n = len(data)
    if not ink.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, ink[:-1]
    start = np.flatnonzero(ink & (~before | fresh[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, ink[1:]
    end = np.flatnonzero(ink & (~after | fresh[1:])) + 1
    up, down = _powers(n)
    value = _CODE[data].astype(np.uint64)
    value *= up[:n]
    raw = np.add.reduceat(value, start) * down[start]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return start, end, doc, mix(raw + (end - start).astype(np.uint64))


_STEP = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(doc: np.ndarray, word: np.ndarray, size: int = 5):
    """(index of the first word, hash) of each window of `size` words within one text."""
    if len(word) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(word) - size + 1
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += word[j : j + n] * (_STEP[j % len(_STEP)] + np.uint64(2 * (j // len(_STEP))))
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return at, mix(total[at])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its lower-cased shingles; the whole sequence where it
    has fewer words; empty without words."""
    _, _, doc, word = words(data, offsets)
    docs = len(offsets) - 1
    at, value = shingles(doc, word, size)
    first = np.searchsorted(doc[at], np.arange(docs + 1))
    span = np.searchsorted(doc, np.arange(docs + 1))
    out = []
    for d in range(docs):
        n = span[d + 1] - span[d]
        if n >= size:
            own = np.sort(value[first[d] : first[d + 1]])
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append(own[fresh])
        elif n:
            tag = np.full(1, n, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            out.append(mix(tag + (word[span[d] : span[d + 1]] * np.array(_STEP[:n])).sum(dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
