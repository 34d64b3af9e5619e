"""Cleaning, tokenising, hashing and formatting of text as Spark columns.

The patterns give in Java what the usual Unicode-aware classes give elsewhere; WS also holds U+001C to U+001F.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from rankforge.functions import arrow

WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"  # the characters of WS
WORD_CHAR = r"\pL\pN_"
TOKEN = rf"([{WORD_CHAR}]+|[^{WORD_CHAR}{WS[1:-1]}])"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"
PAGE_NUMBER = rf"(?i)^{WS}*(?:page{WS}+)?\p{{Nd}}+(?:{WS}+of{WS}+\p{{Nd}}+)?{WS}*$"


def _c(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: str | Column) -> Column:
    """Without white space at the ends; a search from both ends, which an expression for the same would extend to every space between."""
    return F.btrim(_c(text), F.lit(WS_CHARS))


def tokens(text: str | Column) -> Column:
    """Words and single punctuation marks, in order."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN), F.lit(1))


@F.arrow_udf(IntegerType())
def _token_count(texts: pa.Array) -> pa.Array:
    return pc.count_substring_regex(texts, pattern=TOKEN).cast(pa.int32())


def token_count(text: str | Column) -> Column:
    """The number of tokens; not for use inside lambdas."""
    return _token_count(F.make_valid_utf8(_c(text)))


def number_of_tokens(text: str | Column) -> Column:
    """The same as token_count, in the JVM, for use inside lambdas."""
    return F.regexp_count(_c(text), F.lit(TOKEN))


@F.arrow_udf(ArrayType(StringType()))
def _words(texts: pa.Array) -> pa.Array:
    parts = []
    for a, b in arrow.pieces(arrow.byte_lengths(texts), arrow.BYTES):
        part = texts.slice(a, b - a)
        sizes, code, distinct = arrow.words(part)
        parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), distinct.take(pa.array(code)), mask=part.is_null()))
    arrow.release()
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


def words(text: str | Column) -> Column:
    """Lower-cased runs of letters, without digits and underscores; not for use inside lambdas."""
    return _words(F.make_valid_utf8(_c(text)))


def lines(text: str | Column) -> Column:
    """The lines of a text; a final line break adds none."""
    parts = F.split(_c(text), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def tail_tokens(text: str | Column, limit: int) -> Column:
    t = tokens(text)
    return F.array_join(F.slice(t, F.greatest(F.lit(1), F.size(t) - limit + 1), limit), " ") if limit > 0 else F.lit("")


def sentences(text: str | Column) -> Column:
    parts = F.transform(F.split(_c(text), rf"(?<=[.!?]){WS}+"), strip)
    return F.filter(parts, lambda s: s != "")


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    out = arrow.mapped(texts, lambda t: unicodedata.normalize("NFKC", t))
    arrow.release()
    return out


def normalize_unicode(text: str | Column) -> Column:
    """NFKC; only texts beyond ASCII are sent to Python. A function of Python is run on every row whatever branch it stands in, so that the others are null to it."""
    text = _c(text)
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


# (pattern, replacement) in RE2's syntax, where line breaks become \n before what surrounds them goes
CLEANUP = [
    (r"[ \t]{2,}|\t", " "),
    (rf"{WS}+([.,;:!?])", r"\1"),
    (rf"{WS}*@{WS}*", "@"),
    (rf"{WS}*\.{WS}*", "."),
    (rf"https?{WS}*:{WS}*/{WS}*/", "https://"),
    (rf"{WS}*/{WS}*", "/"),
    (rf"(\p{{Nd}}){WS}*-{WS}*(\p{{Nd}})", r"\1-\2"),
    (r"\r\n|[\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]", "\n"),
    (r"[\t\x1f \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]*\n[\t\x1f \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]*", "\n"),
]


@F.arrow_udf(StringType())
def _cleaned(texts: pa.Array) -> pa.Array:
    out = arrow.replaced(texts, CLEANUP, WS_CHARS)
    arrow.release()
    return out


def cleanup_whitespace(text: str | Column) -> Column:
    """Single spaces, none around . @ / and before punctuation, http addresses and number ranges mended, lines trimmed.

    White space around a full stop goes whatever follows it, line breaks included, and http:// becomes https://. It is done by RE2 in
    Arrow, whose time does not grow with the white space that a pattern might begin with; bytes that are no UTF-8 become U+FFFD.
    """
    return _cleaned(F.make_valid_utf8(_c(text)))


def remove_page_numbers(text: str | Column) -> Column:
    """Without the lines that hold only a page number; every kind of line break becomes \\n."""
    return F.array_join(F.filter(lines(text), lambda x: ~x.rlike(PAGE_NUMBER)), "\n")


def remove_empty_lines(text: str | Column) -> Column:
    return strip(F.regexp_replace(_c(text), r"\n{3,}", "\n\n"))


def normalize_pdf_text(text: str | Column) -> Column:
    t = normalize_unicode(text)
    for pattern, new in (
        (r"[\x{fffd}\x{ad}]", ""),
        (r"\r\n?", "\n"),
        (r"[ \t]+", " "),
        (r"\n{3,}", "\n\n"),
        (r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}\x{feff}]", ""),
        (r" *\n *", "\n"),
    ):
        t = F.regexp_replace(t, pattern, new)
    return strip(t)


def document_id(filename: str | Column, text: str | Column) -> Column:
    """16 hex digits of the SHA-256 of name and raw text."""
    return F.substring(F.sha2(F.concat(_c(filename), F.lit("::"), _c(text)), 256), 1, 16)


def cache_key(model: str | Column, text: str | Column) -> Column:
    return F.sha2(F.concat(model if isinstance(model, Column) else F.lit(model), F.lit("::"), _c(text)), 256)


def model_file_name(name: str | Column) -> Column:
    return F.regexp_replace(_c(name), r"[^A-Za-z0-9_.-]+", "_")


def preview(text: str | Column, width: int = 160) -> Column:
    return F.substring(strip(F.replace(F.replace(_c(text), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))), 1, width)


def notes(*parts: str | None) -> str | None:
    """Notes joined by a bar, without the missing ones."""
    return " | ".join(p for p in parts if p) or None
