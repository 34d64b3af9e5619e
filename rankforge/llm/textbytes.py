"""Vectorised text features over Arrow batches: bytes, words and their 64-bit hashes, without a Python loop over words.

A word is a maximal run of ASCII letters, digits and bytes from 0x80 on (parts of characters beyond ASCII) of the
lower-cased text. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240517))
BYTE_HASH = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE, WORD = 0x9E3779B97F4A7C15 | 1, np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
ROWS, PIECE = 1 << 15, 1 << 21  # rows of a part, bytes of a part and of a piece of a long text
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        inverse = pow(BASE, -1, 2**64)
        for k, b in enumerate((BASE, inverse)):
            p = np.full(n, b & (2**64 - 1), dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; returns a new array."""
    z = z ^ (z >> U(30))
    z *= U(0xBF58476D1CE4E5B9)
    z ^= z >> U(27)
    z *= U(0x94D049BB133111EB)
    z ^= z >> U(31)
    return z


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(offsets: np.ndarray, most: int, rows: int = ROWS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `rows` rows and `most` bytes each, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        b = min(b, n, a + rows)
        yield a, b
        a = b


def pieces(data: np.ndarray, most: int = PIECE, word: np.ndarray = WORD) -> Iterator[tuple[int, int]]:
    """Byte ranges of one text of about `most` bytes, cut after a byte outside words; a longer word stays whole."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + most)
        if b < n:
            outside = np.flatnonzero(~word[data[a:b]])
            if len(outside):
                b = a + int(outside[-1]) + 1
            while b < n and word[data[b - 1]] and word[data[b]]:
                more = np.flatnonzero(~word[data[b : b + most]])
                b = b + int(more[0]) if len(more) else min(n, b + most)
                if len(more):
                    break
        yield a, b
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of all words; rows' ends break words."""
    if not len(data):
        return (np.zeros(0, dtype=np.int64),) * 3
    is_word = np.zeros(len(data) + 2, dtype=bool)
    is_word[1:-1] = word[data]
    edge = is_word[1:] != is_word[:-1]
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[is_word[cuts] & is_word[cuts + 1]]  # a word runs over the end of a row
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span that depends on its bytes alone."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_HASH[data] * power[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    h += (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93)
    return mix(h)


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and their rows. A long text goes by pieces, so that only its words' hashes are held whole."""
    if len(offsets) > 2 or len(data) <= PIECE:
        starts, ends, rows = word_spans(data, offsets)
        return word_hashes(data, starts, ends), rows
    found = [word_hashes(data[a:b], *word_spans(data[a:b], np.array([0, b - a]))[:2]) for a, b in pieces(data)]
    h = np.concatenate(found)
    return h, np.zeros(len(h), dtype=np.int64)


def hash_word(word: str) -> int:
    """The hash that word_hashes gives one word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def each_part(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and offsets of every part of a column."""
    data, offsets = utf8(column)
    for a, b in parts(offsets, most):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def rows_of(column_lists: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array a row."""
    sizes = np.array([0, *[len(x) for x in column_lists]], dtype=np.int64)
    values = np.concatenate(column_lists) if column_lists else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(values, type=kind))
