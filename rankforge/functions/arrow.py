"""Bounded work on Arrow batches: pieces of a batch, texts mapped one by one or by expressions, words, memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS, BYTES = 1024, 1 << 22
NO_WORD = r"[^\pL\p{Nl}\p{No}]+"


def pieces(sizes: np.ndarray, most: int, rows: int = ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of at most `most` in all and at most `rows` rows; a row above that is by itself."""
    upto, a = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), 0
    while a < len(sizes):
        b = min(a + rows, len(sizes), max(a + 1, int(np.searchsorted(upto, upto[a] + most, side="right")) - 1))
        yield a, b
        a = b


def lengths(lists: pa.Array) -> np.ndarray:
    """The lengths of lists; 0 for null."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def mapped(texts: pa.Array, f: Callable[[str], str]) -> pa.Array:
    """f of every text that is not null; as Python's strings no more than some BYTES of them exist at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    parts = [pa.array([t if t is None else f(t) for t in texts.slice(a, b - a).to_pylist()], texts.type) for a, b in pieces(sizes, BYTES)]
    return pa.concat_arrays(parts) if parts else texts


def replaced(texts: pa.Array, steps: list[tuple[str, str]], trim: str) -> pa.Array:
    """texts after RE2 replacements, one after another, without the characters of `trim` at their ends; some BYTES of them at a time."""
    parts = []
    for a, b in pieces(byte_lengths(texts), BYTES):
        part = texts.slice(a, b - a)
        for pattern, new in steps:
            part = pc.replace_substring_regex(part, pattern, new)
        parts.append(pc.utf8_trim(part, characters=trim).cast(texts.type))
    return pa.concat_arrays(parts) if parts else texts


def byte_lengths(texts: pa.Array) -> np.ndarray:
    """The bytes of texts; 0 for null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lowered(words: pa.Array) -> pa.Array:
    """Lower case as Python and Spark have it; Arrow's own is by single characters."""
    out, wide = pc.utf8_lower(words), pc.invert(pc.string_is_ascii(words))
    return pc.replace_with_mask(out, wide, pa.array([w.lower() for w in words.filter(wide).to_pylist()], out.type))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of functions.text.words: their number in each text, the code of each of them, and the distinct ones by code."""
    cut = pc.split_pattern_regex(texts, NO_WORD)
    known = pc.dictionary_encode(cut.flatten())
    low = pc.dictionary_encode(_lowered(known.dictionary))
    code = low.indices.to_numpy(zero_copy_only=False)[known.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
    row = np.repeat(np.arange(len(texts)), lengths(cut))
    held = code != pc.index(low.dictionary, "").as_py()  # at the ends of texts, -1 if there are none
    return np.bincount(row[held], minlength=len(texts)), code[held], low.dictionary


def release() -> None:
    """Give freed memory back to the system, which allocators would keep for the life of a Python worker."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function that releases its memory when a task ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run
