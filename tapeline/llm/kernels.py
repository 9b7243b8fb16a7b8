"""Vectorised word, window and shingle hashing over Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64 bit: a polynomial of table values
modulo 2^64, taken from prefix sums so that no Python loop runs over words, then finalised.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
#: Bytes of text handled at once, so that the temporary arrays stay small.
SLICE = 1 << 18


class _Powers:
    """Powers of an odd number modulo 2^64, and of its inverse, as long as needed."""

    def __init__(self, base: int):
        self.base, self.n = base, 0
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                    x = np.full(self.n, b, np.uint64)
                    x[0] = 1
                    setattr(self, name, np.multiply.accumulate(x))


_p, _q = _Powers(_P), _Powers(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Words(NamedTuple):
    """Words of rows [first, first + len(base) - 1): hash, row (from 0), and where each row's words begin."""

    first: int
    h: np.ndarray
    row: np.ndarray
    base: np.ndarray


def _hash(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of data and their start bytes; words end at offsets."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word = ~_SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = False
    before[1:], after[:-1] = word[:-1], word[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[(offsets[1:] - 1)[offsets[1:] > 0]] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    _p.grow(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _p.up[:n], out=total[1:])
        h = (total[ends] - total[starts]) * _p.down[starts] + (ends - starts).astype(np.uint64) * U(_Q)
    return mix(h), starts


_TOKEN_END = np.ones(256, bool)
_TOKEN_END[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def token_features(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Features of texts' tokens (runs of letters, digits and non-ASCII bytes, A-Z lower-cased).

    Returns each token's row and its 64-bit features: the token's hash and one for each prefix length.
    """
    low = _LOWER[data]
    n = len(low)
    word = ~_TOKEN_END[low]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[(offsets[1:] - 1)[offsets[1:] > 0]] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    _p.grow(n + 1)
    feats = np.empty((1 + len(prefixes), len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[low] * _p.up[:n], out=total[1:])
        for k, length in enumerate((0, *prefixes)):
            stop = np.minimum(ends, starts + length) if length else ends
            feats[k] = mix((total[stop] - total[starts]) * _p.down[starts] + U(k * 0x9E3779B97F4A7C15 % 2**64))
    return np.searchsorted(offsets, starts, side="right") - 1, feats


def _long(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long text, in pieces that end at white space."""
    hs, at, out = 0, [], []
    while hs < len(data):
        end = min(hs + SLICE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end = min(end + 4096, len(data))
            if end < len(data):
                gap = np.flatnonzero(_SPACE[data[end - 4096 : end]])
                if len(gap):
                    end = end - 4096 + int(gap[0])
        piece = data[hs:end]
        h, s = _hash(piece, np.array([0, len(piece)]))
        out.append(h)
        at.append(s + hs)
        hs = end
    return np.concatenate(out), np.concatenate(at)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offsets, data = col.buffers()
    o = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return d, o


def row_ranges(sizes: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about limit bytes, one row at least."""
    a, held = 0, 0
    for b, s in enumerate(sizes.tolist()):
        if b > a and held + s > limit:
            yield a, b
            a, held = b, 0
        held += s
    if a < len(sizes):
        yield a, len(sizes)


def text_sizes(col: pa.Array) -> np.ndarray:
    return np.diff(buffers(col)[1])


def words(col: pa.Array, lower: bool = False) -> Iterator[Words]:
    """Word hashes of a string column (null: no words), whole texts, about SLICE bytes at a time."""
    data, offsets = buffers(col)
    for a, b in row_ranges(np.diff(offsets)):
        o = offsets[a : b + 1] - offsets[a]
        d = data[offsets[a] : offsets[b]]
        d = _LOWER[d] if lower else d
        h, starts = _long(d) if len(d) > 4 * SLICE else _hash(d, o)
        row = np.searchsorted(o, starts, side="right") - 1
        yield Words(a, h, row, np.searchsorted(row, np.arange(b - a + 1)))


def spans(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int, salt: int = 0) -> np.ndarray:
    """Hash of the words [start, start + length) for each start."""
    _q.grow(len(h) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h + U(salt)) * _q.up[: len(h)], out=total[1:])
        x = (total[starts + lengths] - total[starts]) * _q.down[starts]
        return mix(x + np.asarray(lengths, np.uint64) * U(_P))


class Sets(NamedTuple):
    """Distinct shingles of rows [first, first + len(count)): sorted by (row, hash)."""

    first: int
    h: np.ndarray
    row: np.ndarray
    count: np.ndarray


def shingle_sets(col: pa.Array, k: int) -> Iterator[Sets]:
    """Distinct k-word shingles of each row; a row of fewer words has one shingle, of no words none."""
    for w in words(col, lower=True):
        n_rows, n_words = len(w.base) - 1, np.diff(w.base)
        short = np.flatnonzero((n_words > 0) & (n_words < k))
        last = w.base[w.row + 1] if len(w.row) else np.empty(0, np.int64)
        full = np.flatnonzero(np.arange(len(w.h)) + k <= last)
        starts = np.concatenate([full, w.base[short]]).astype(np.int64)
        lengths = np.concatenate([np.full(len(full), k), n_words[short]]).astype(np.int64)
        h = spans(w.h, starts, lengths)
        row = w.row[starts] if len(starts) else np.empty(0, np.int64)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
        yield Sets(w.first, h, row, np.bincount(row, minlength=n_rows))
