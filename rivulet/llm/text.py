"""Words, lines and windows of many texts at once, as numpy arrays over one UTF-8 buffer.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  Words, lines and
windows are named by 64-bit hashes: a polynomial over random byte values,
taken from prefix sums, then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (two multiply-xorshift rounds)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U(BASE))


#: Entries of the tables that a worker keeps; those of longer texts are made anew.
KEPT_POWERS = 1 << 20
_held: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    def table(b):
        out = np.ones(n, np.uint64)
        if n > 1:
            out[1:] = U(b)
            out = np.multiply.accumulate(out)
        return out
    return table(BASE), table(BASE_INV)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of at least n entries, grown by need."""
    size = 1 << max(16, int(n).bit_length())
    if size > KEPT_POWERS:
        return _powers(size)
    if not _held or len(_held[0][0]) < size:
        _held[:] = [_powers(size)]
    return _held[0]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums of byte value x BASE**position."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data))[0][:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inv = powers(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """doc: row of each word; first: first word of each row (n + 1 entries); hash: per word."""
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray | None = None) -> Words:
    n = len(data)
    ink = ~SPACE[data]
    start, end = ink.copy(), ink.copy()
    if n:
        start[1:] &= ~ink[:-1]
        end[:-1] &= ~ink[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        start[edge] |= ink[edge]
        end[edge - 1] |= ink[edge - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offsets, "left")
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(starts, ends, doc, first, span_hash(prefix_hash(data) if prefix is None else prefix, starts, ends))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each window of ``k`` words inside one row."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1:])
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = mix(h * U(BASE) + w.hash[at + j])
    return at, h


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many positions of ``mask`` are set in each row."""
    run = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one after another, and the n + 1 offsets of the rows.

    A-Z are lower-cased.  A row with words, but fewer than ``k``, has one
    shingle: all its words; a row without words has none.
    """
    w = words(LOWER[data], offsets)
    at, h = windows(w, k)
    n = len(offsets) - 1
    doc = w.doc[at]
    few = np.diff(w.first)
    parts, sizes = [], np.zeros(n + 1, np.int64)
    cut = np.searchsorted(doc, np.arange(n + 1))
    for i in range(n):
        if cut[i + 1] > cut[i]:
            s = np.sort(h[cut[i]:cut[i + 1]])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif few[i]:
            a = np.array([few[i]], np.uint64)
            for x in w.hash[w.first[i]:w.first[i + 1]]:
                a = mix(a * U(BASE) + x)
            s = a
        else:
            continue
        parts.append(s)
        sizes[i + 1] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)
