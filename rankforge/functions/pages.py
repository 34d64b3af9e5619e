"""Removal of headers and footers that repeat over the pages of a document."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from rankforge.functions import arrow

DEEPEST, SHORTEST = 4, 5


def _edge(keys: list[str], depth: int) -> tuple[str, ...]:
    """The first `depth` normalised lines of at least SHORTEST characters."""
    return tuple([k for k in keys if len(k) >= SHORTEST][:depth])


def _repeated(pages: list[list[str]], required: int) -> tuple[tuple[str, ...], int] | None:
    """The deepest edge that enough pages share, the first such by page order, with its depth."""
    for depth in range(DEEPEST, 0, -1):
        for edge, n in Counter(e for e in (_edge(p, depth) for p in pages) if e).items():
            if n >= required:
                return edge, depth
    return None


def _without(lines: list[str], count: int) -> list[str]:
    """Without the first `count` lines that are not blank."""
    out = []
    for line in lines:
        if count and line.strip():
            count -= 1
        else:
            out.append(line)
    return out


def strip_edges(text: str, headers: bool = True, footers: bool = True, threshold: float = 0.7) -> str:
    """The edge is compared by its long lines, but as many non-blank lines go as it is deep; once an edge repeats, every page loses its trailing white space."""
    pages = [p.splitlines() for p in text.split("\f")]
    if len(pages) < 2:
        return text
    keys = [[re.sub(r"\s+", " ", line).strip().lower() for line in p] for p in pages]
    required = max(2, int(len(pages) * threshold))
    backward = [k[::-1] for k in keys]
    top, bottom = _repeated(keys, required), _repeated(backward, required)
    if top is None and bottom is None:
        return text
    out = []
    for page, down, up in zip(pages, keys, backward):
        if headers and top and _edge(down, top[1]) == top[0]:
            page = _without(page, top[1])
        if footers and bottom and _edge(up, bottom[1]) == bottom[0]:
            page = _without(page[::-1], bottom[1])[::-1]
        out.append("\n".join(page).rstrip())
    return "\f".join(out)


def remove_page_edges(text: Column, headers: bool = True, footers: bool = True, threshold: float = 0.7) -> Column:
    """Only texts with a form feed are sent to Python; the others are null to it."""

    @F.arrow_udf("string")
    def edges(texts: pa.Array) -> pa.Array:
        out = arrow.mapped(texts, lambda t: strip_edges(t, headers, footers, threshold))
        arrow.release()
        return out

    return F.coalesce(edges(F.when(F.contains(text, F.lit("\f")), text)), text)
