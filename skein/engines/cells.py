"""Pairs of near points of two clouds by cells, without trees: (rows of a, rows of b)."""

from __future__ import annotations

import itertools

import numpy as np

#: Odd weights of cell coordinates in a key of 64 bits.
PRIMES = np.array([73856093, 19349663000077, 8349279134200033], dtype=np.int64)


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and member of ranges low[i] .. high[i] - 1."""
    n = high - low
    owner = np.repeat(np.arange(len(low)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def in_box(a: np.ndarray, b: np.ndarray, half) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose coordinates all differ by less than half (a number or one an axis), strictly."""
    dim = a.shape[1] if len(a) else b.shape[1] if len(b) else 3
    half = np.broadcast_to(np.asarray(half, float), (dim,))
    none = np.empty(0, np.intp), np.empty(0, np.intp)
    fa, fb = np.flatnonzero(np.isfinite(a).all(1)) if len(a) else none[0], np.flatnonzero(np.isfinite(b).all(1)) if len(b) else none[0]
    if not len(fa) or not len(fb) or (half <= 0).any():
        return none
    ca, cb = np.floor(a[fa] / half).astype(np.int64), np.floor(b[fb] / half).astype(np.int64)
    weight = PRIMES[:dim]  # keys may wrap and collide; the exact test drops what does not belong
    key = (cb * weight).sum(1)
    order = np.argsort(key, kind="stable")
    key = key[order]
    own, of = np.unique((ca * weight).sum(1), return_inverse=True)  # each cell is looked up once, in order of keys
    left, right = [], []
    for step in itertools.product((-1, 0, 1), repeat=dim):
        want = own + (np.array(step) * weight).sum()
        owner, member = _expand(np.searchsorted(key, want, "left")[of], np.searchsorted(key, want, "right")[of])
        i, k = fa[owner], fb[order[member]]
        near = (np.abs(a[i] - b[k]) < half).all(1)
        left.append(i[near])
        right.append(k[near])
    return np.concatenate(left), np.concatenate(right)


def within(a: np.ndarray, b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs within radius, inclusive, and their squared distances."""
    i, k = in_box(a, b, np.nextafter(radius, np.inf) * (1 + 1e-12) if radius > 0 else 1e-300)
    d2 = ((a[i] - b[k]) ** 2).sum(1)
    ok = d2 <= radius * radius
    return i[ok], k[ok], d2[ok]


def nearest(i: np.ndarray, k: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n nearest of each i among pairs, ties by k, ordered by (i, d, k)."""
    order = np.lexsort((k, d, i))
    own = i[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1]) if len(own) else np.empty(0, int)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[rank < n]


def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, start, of): the rows of x place by place, in order within each; where each place's rows begin, and the end; the place of every row."""
    if not len(x):
        return np.empty(0, np.intp), np.zeros(1, np.intp), np.empty(0, np.intp)
    x = x + 0.0  # one zero
    rows = np.lexsort(x.T[::-1])
    new = np.concatenate([[True], (x[rows[1:]] != x[rows[:-1]]).any(1)])
    of = np.empty(len(x), np.intp)
    of[rows] = np.cumsum(new) - 1
    return rows, np.append(np.flatnonzero(new), len(x)), of
