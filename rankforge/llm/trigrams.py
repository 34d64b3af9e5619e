"""Boolean trigram queries derived from regular expressions, and an inverted index to answer them.

A query is True (no mandatory trigram), a trigram of three ASCII-lower-cased bytes, or ("and" | "or", parts). Any text
that a pattern matches satisfies its query once the text's ASCII letters are lower-cased.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np

try:
    from re import _constants as sre, _parser
except ImportError:  # named otherwise before Python 3.11
    import sre_constants as sre
    import sre_parse as _parser

MOST_STRINGS, MOST_CLASS, PIECE = 128, 12, 1 << 22
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _join(kind: str, parts: list) -> object:
    if kind == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif any(p is True for p in parts):
        return True
    flat = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == kind else [p]
    flat = list(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _of_strings(strings: set[str]) -> object:
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items: list) -> set[str] | None:
    found: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            found.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 128:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_CLASS and all(c.isascii() for c in found) else None


def _exact(tree: list) -> set[str] | None:
    """All strings that the tree matches, lower-cased, if they are few."""
    runs, query = _walk(tree)
    return runs[0] if len(runs) == 1 and query is True else None


def _walk(tree: list) -> tuple[list[set[str]], object]:
    """Runs of exact strings with gaps between them, and what else must hold."""
    runs: list[set[str]] = [{""}]
    must: list[object] = []

    def add(strings: set[str]) -> None:
        if len(runs[-1]) * len(strings) > MOST_STRINGS:
            gap()
        runs[-1] = {a + b for a, b in product(runs[-1], strings)}

    def gap() -> None:
        runs.append({""})

    for op, arg in tree:
        if op is sre.LITERAL and arg < 128:
            add({chr(arg).lower()})
        elif op is sre.IN and (found := _class(arg)):
            add(found)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        elif op in (sre.SUBPATTERN, sre.ATOMIC_GROUP):
            inner = arg[-1] if op is sre.SUBPATTERN else arg
            more, also = _walk(list(inner))
            must.append(also)
            add(more[0])
            for run in more[1:]:
                gap()
                add(run)
        elif op is sre.BRANCH:
            exact = [_exact(list(x)) for x in arg[1]]
            if all(x is not None for x in exact) and len(set().union(*exact)) <= MOST_STRINGS:
                add(set().union(*exact))
            else:
                must.append(_join("or", [_query(list(x)) for x in arg[1]]))
                gap()
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = arg
            exact = _exact(list(inner))
            if exact is None:
                if least:
                    must.append(_query(list(inner)))
                gap()
            elif (least, most) == (0, 1):
                add(exact | {""})
            elif least == most and len(exact) ** least <= MOST_STRINGS and least <= 64:
                for _ in range(least):
                    add(exact)
            elif least:
                add(exact)
                gap()
                add(exact)
            else:
                gap()
        else:
            gap()
    return runs, _join("and", must)


def _query(tree: list) -> object:
    runs, must = _walk(tree)
    return _join("and", [must, *[_of_strings(run) for run in runs]])


def trigram_query(pattern: str) -> object:
    return _query(list(_parser.parse(pattern, re.ASCII)))


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*[trigrams_of(p) for p in query[1]])


class Index:
    """Postings of the trigrams that some query names, over the rows of one batch."""

    def __init__(self, wanted: set[str]):
        self.names = sorted(wanted)
        codes = np.array([int.from_bytes(w.encode(), "big") for w in self.names], dtype=np.uint32)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        self.filter = np.zeros(1 << 16, dtype=bool)
        self.filter[self._small(self.codes)] = True

    @staticmethod
    def _small(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(0x9E3779B1)) >> np.uint32(16)

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """Rows by trigram. A long text goes by pieces that share two bytes, as its trigrams take several times its room."""
        if len(offsets) == 2 and len(data) > PIECE + 2:
            found: set[str] = set()
            for a in range(0, len(data) - 2, PIECE):
                part = data[a : a + PIECE + 2]
                found |= set(self.postings(part, np.array([0, len(part)])))
            return {name: np.zeros(1, dtype=np.int64) for name in found}
        if len(data) < 3 or not len(self.codes):
            return {}
        b = FOLD[data].astype(np.uint32)
        codes = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        at = np.flatnonzero(self.filter[self._small(codes)])
        k = np.searchsorted(self.codes, codes[at])
        k[k == len(self.codes)] = 0
        hit = self.codes[k] == codes[at]
        at, k = at[hit], k[hit]
        rows = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[rows + 1]
        pairs = np.unique((k[inside].astype(np.int64) << 32) | rows[inside])
        which, rows = pairs >> 32, pairs & 0xFFFFFFFF
        cuts = np.searchsorted(which, np.arange(len(self.codes) + 1))
        return {self.names[self.order[i]]: rows[cuts[i] : cuts[i + 1]] for i in range(len(self.codes)) if cuts[i] < cuts[i + 1]}


def candidates(query: object, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    """The rows that satisfy the query, by intersecting and uniting postings."""
    if query is True:
        return np.arange(n)
    if isinstance(query, str):
        return postings.get(query, np.zeros(0, dtype=np.int64))
    found = None
    for rows in sorted((candidates(p, postings, n) for p in query[1]), key=len) if query[0] == "and" else [candidates(p, postings, n) for p in query[1]]:
        found = rows if found is None else (np.intersect1d(found, rows, assume_unique=True) if query[0] == "and" else np.union1d(found, rows))
        if query[0] == "and" and not len(found):
            break
    return found
