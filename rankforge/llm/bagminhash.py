"""BagMinHash signatures of multisets: weighted-Jaccard estimates from hierarchical Poisson processes.

Weights are counts, so the discretisation to whole levels loses nothing. The weight axis of an element is cut into the
dyadic intervals (0,1], (1,2], (2,4], (4,8] ...; each carries an independent Poisson process whose rate is its
length. Points arrive in order of time; each falls to a level of its interval by successive halving (the bits of its
hash) and to a register of the signature. An element of weight w sees exactly the points at levels up to w, so two
multisets share a register's first point with probability sum(min) / sum(max). Arrival is cut at a time by which the
registers are almost surely full, and carried on for the rows where they are not.
"""

from __future__ import annotations

import numpy as np

from rankforge.llm.textbytes import BASE, ROWS, U, hashed_words, mix

GOLD = U(0x9E3779B97F4A7C15)
ELEMENTS = 1 << 19  # elements whose points arrive together


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of every shingle of `size` words (a shorter text is one shingle), and two hashes of each row's words."""
    h, rows = hashed_words(data, offsets)
    n = len(offsets) - 1
    first = np.searchsorted(rows, np.arange(n))
    counts = np.diff(np.append(first, len(rows)))
    place = np.arange(len(h), dtype=np.uint64) - first[rows].astype(np.uint64)
    whole = np.zeros((n, 2), dtype=np.uint64)
    some = counts > 0
    for k, salt in enumerate((U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25))):
        if len(h):
            whole[some, k] = mix(np.add.reduceat(mix(h + (place + U(1)) * salt), first[some]) + counts[some].astype(np.uint64))
    if len(h) < size:
        s, r = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    else:
        m = len(h) - size + 1
        s = np.zeros(m, dtype=np.uint64)
        for k in range(size):
            s *= U(BASE)
            s += h[k : k + m]
        ok = rows[:m] == rows[size - 1 :]
        s, r = mix(s[ok]), rows[:m][ok]
    short = np.flatnonzero(some & (counts < size))
    if len(short):
        s, r = np.concatenate([s, whole[short, 0]]), np.concatenate([r, short])
    return r, s, whole


def counted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 48-bit hash and count of the distinct elements of each row; rows are numbered below ROWS."""
    if len(rows) and rows.max() >= ROWS:
        raise ValueError("too many rows in one part")
    key = np.sort((rows.astype(np.uint64) << U(48)) | (hashes >> U(16)))
    if not len(key):
        return rows[:0], key, np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    key, weights = key[at], np.diff(np.append(at, len(key)))
    return (key >> U(48)).astype(np.int64), key & U(2**48 - 1), weights


def _arrive(sig: np.ndarray, rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, until: np.ndarray) -> None:
    m = sig.shape[1]
    flat = sig.reshape(-1)
    intervals = np.ceil(np.log2(weights)).astype(np.int64) + 1
    own = np.repeat(np.arange(len(rows)), intervals)
    i = np.arange(len(own)) - np.repeat(np.cumsum(intervals) - intervals, intervals)
    length = np.left_shift(1, np.maximum(i - 1, 0))
    seed = mix(elements[own] + (i.astype(np.uint64) + U(1)) * U(0xD1342543DE82EF95))
    row, weight, end = rows[own], weights[own], until[rows[own]]
    low = np.where(i == 0, 0, length)
    t = np.zeros(len(own))
    while len(row):
        seed += GOLD
        z = mix(seed)
        u = ((z >> U(11)) + U(1)).astype(np.float64)
        u *= 2.0**-53
        np.log(u, out=u)
        u /= length
        t -= u
        live = t <= end
        if not live.all():
            row, weight, end, length, low, t, seed, z = (x[live] for x in (row, weight, end, length, low, t, seed, z))
        z = mix(z ^ U(0x94D049BB133111EB))
        level = low + 1 + (z & (length - 1).astype(np.uint64)).astype(np.int64)
        register = ((z >> U(32)) * U(m) >> U(32)).astype(np.int64)
        seen = level <= weight
        if seen.all():
            np.minimum.at(flat, row * m + register, t)
        else:
            np.minimum.at(flat, (row * m + register)[seen], t[seen])


def signatures(n: int, rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """(n, m) first arrival times; rows without elements stay infinite."""
    sig = np.full((n, m), np.inf)
    total = np.bincount(rows, weights=weights, minlength=n)
    todo, reach = total > 0, np.log(m) + 3.0
    while todo.any():
        until = np.where(todo, m * reach / np.maximum(total, 1), 0.0)
        mine = np.flatnonzero(todo[rows])
        for a in range(0, len(mine), ELEMENTS):
            part = mine[a : a + ELEMENTS]
            _arrive(sig, rows[part], elements[part], weights[part], until)
        todo &= ~np.isfinite(sig).all(axis=1)
        reach *= 2
    return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """(n, bands) 64-bit keys, each of one band's registers."""
    n, m = sig.shape
    bits = sig.view(np.uint64).reshape(n, bands, m // bands)
    key = np.zeros((n, bands), dtype=np.uint64)
    for k in range(m // bands):
        key = mix(key + bits[:, :, k])
    return mix(key + np.arange(1, bands + 1, dtype=np.uint64) * GOLD).view(np.int64)
