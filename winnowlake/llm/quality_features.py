"""Hashed n-gram features of texts, vectorised over Arrow slices; the quality operators share them.

Tokens are runs of letters (and non-ASCII bytes), of digits, or of other characters between white
space. Features: token unigrams and bigrams (lower-cased; digits only by their number), bigrams of
letter-case shapes, bins of how many tokens equal the one before and of how many stand in token
4-grams that the text repeats, and on request character (byte) 3- and 5-grams. A feature's value is
its share of the tokens (or bytes) of the text; a bin's value is 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import LOWER, SPACE, hashed_spans, mix

#: Hash buckets: token features in the lower half, character features in the upper.
BITS = 18
HALF = 1 << (BITS - 1)

_CLASS = np.full(256, 3, np.uint8)
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[SPACE] = 0
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_EDGES = np.array([1e-9, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
_ONE = np.uint64(1)
#: Bytes of text that one step works on, and positions of character n-grams taken at once.
SLICE_BYTES, STEP = 1 << 19, 1 << 17


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h + np.uint64(salt)) & np.uint64(HALF - 1)).astype(np.int64)


def features(data: np.ndarray, offs: np.ndarray, chars: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket, value) of the features of all texts of a slice, group by group; buckets may repeat."""
    n_rows = len(offs) - 1
    cls = _CLASS[data]
    prev = np.zeros(len(data), np.uint8)
    prev[1:] = cls[:-1]
    prev[offs[:-1][offs[:-1] < len(data)]] = 0
    starts = np.flatnonzero((cls != 0) & (cls != prev))
    nxt = np.zeros(len(data), np.uint8)
    nxt[:-1] = cls[1:]
    last = offs[1:] - 1
    nxt[last[last >= 0]] = 0
    ends = np.flatnonzero((cls != 0) & (cls != nxt)) + 1
    first = np.searchsorted(starts, offs)
    n = np.diff(first)
    row = np.repeat(np.arange(n_rows), n)
    low = LOWER[data]
    h = hashed_spans(low, starts, ends)
    size, kind = ends - starts, cls[starts]
    h = np.where(kind == 2, mix(np.minimum(size, 6).astype(np.uint64)), h)
    ups = np.append(0, np.cumsum(_UPPER[data]))
    up = ups[ends] - ups[starts]
    shape = np.where(kind == 1, np.where(up == 0, 0, np.where(up == 1, 1, np.where(up * 3 >= size * 2, 2, 3))), kind + 2).astype(np.int64)
    share = 1.0 / np.maximum(n, 1)
    value = share[row]
    same_row = np.append(False, row[1:] == row[:-1])[: len(row)]
    two = np.flatnonzero(same_row)
    yield row, _bucket(h, 1), value
    yield row[two], _bucket(h[two] * np.uint64(0x9E3779B97F4A7C15) ^ h[two - 1], 2), value[two]
    yield row[two], _bucket((shape[two] * 8 + shape[two - 1]).astype(np.uint64), 3), value[two]
    # bins
    equal = np.bincount(row[two][h[two] == h[two - 1]], minlength=n_rows) * share
    at = np.arange(max(0, len(h) - 3))
    at = at[row[at] == row[at + 3]]
    four = hashed_spans(h, at, at + 4) ^ mix(row[at].astype(np.uint64) + _ONE)
    order = np.argsort(four)
    f = four[order]
    twin = np.zeros(len(f), bool)
    if len(f) > 1:
        eq = f[1:] == f[:-1]
        twin[1:] |= eq
        twin[:-1] |= eq
    again = np.bincount(row[at][order][twin], minlength=n_rows) * share
    for salt, frac in ((4, equal), (5, again)):
        yield np.arange(n_rows), _bucket(np.searchsorted(_EDGES, frac).astype(np.uint64), salt), np.where(n > 0, 1.0, 0.0)
    if chars:
        owner = np.repeat(np.arange(n_rows), np.diff(offs))
        per = 1.0 / np.maximum(np.diff(offs), 1)
        for k in (3, 5):
            for lo in range(0, len(low) - k + 1, STEP):
                hi = min(lo + STEP, len(low) - k + 1)
                b = low[lo : hi + k - 1].astype(np.uint64) + _ONE
                g = b[: hi - lo].copy()
                for j in range(1, k):
                    g = g * np.uint64(0x100000001B3) + b[j : j + hi - lo]
                at = owner[lo:hi]
                inside = at == owner[lo + k - 1 : hi + k - 1]
                yield at[inside], _bucket(g[inside], 5 + k) + HALF, per[at[inside]]


def sparse(data: np.ndarray, offs: np.ndarray, chars: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of every text, each bucket once; for fitting."""
    row, bucket, value = (np.concatenate(x) for x in zip(*features(data, offs, chars), strict=True))
    key = row << BITS | bucket
    u, inv = np.unique(key, return_inverse=True)
    v = np.bincount(inv, weights=value)
    cut = np.searchsorted(u, np.arange(len(offs)) << BITS)
    return [(u[lo:hi] & ((1 << BITS) - 1), v[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]


def dots(data: np.ndarray, offs: np.ndarray, weights: np.ndarray, chars: bool = False) -> np.ndarray:
    """Sparse dot product of every text's features with the weights."""
    out = np.zeros(len(offs) - 1)
    for row, bucket, value in features(data, offs, chars):
        out += np.bincount(row, weights=weights[bucket] * value, minlength=len(out))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))
