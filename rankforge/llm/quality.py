"""Quality rules by distribution divergence: Jensen-Shannon distance between a document and its language.

Two histograms a document: six character classes (a-z, A-Z, 0-9, white space, beyond ASCII, other) and the common
words of its language against all other words. The references are the sums over all documents that carry the
language. A document is dropped if the distance (square root of the base-2 divergence, 0 to 1) of either histogram is beyond its limit; a histogram
is judged only above a minimum length, so that short documents are not dropped for being short.

Cases: a null language, null, empty and short texts are not judged and are kept; a language without a list of common
words is judged by its characters alone. Texts are read whole. Repeated rows are judged and counted each. An empty
table gives an empty result. Other columns are not read by judge().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.shared import lean, pick, written
from rankforge.llm.textbytes import each_part, hash_word, hashed_words, lowered, pieces

COMMON = {
    "en": "the of and to in is that for on with as was be by at this from or an are it a he not have",
    "fr": "de la le et les des en un du une que est pour qui dans par au sur pas plus ce il avec ne se",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le",
}
COMMON = {k: v.split() for k, v in COMMON.items()}
MIN_CHARS, MIN_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 200, 40, 0.25, 0.35
CLASS = np.full(256, 5, dtype=np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[[9, 10, 13, 32]], CLASS[0xC0:] = 0, 1, 2, 3, 4
CLASS[0x80:0xC0] = 6  # the rest of a character beyond ASCII


def _histograms(batches: Iterator[pa.RecordBatch], common: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
    words = sorted({w for listed in common.values() for w in listed})
    hashes = np.array([hash_word(w) for w in words], dtype=np.uint64)
    order = np.argsort(hashes)
    hashes, place = hashes[order], {words[k]: i for i, k in enumerate(order)}
    column = {lang: np.array([place[w] for w in listed]) for lang, listed in common.items()}
    for batch in batches:
        n = batch.num_rows
        chars, seen, total = np.zeros((n, 7), dtype=np.int64), np.zeros((n, len(words)), dtype=np.int64), np.zeros(n, dtype=np.int64)
        for a, b, data, offsets in each_part(batch.column("text")):
            if b - a == 1:  # perhaps a long text
                chars[a] = sum(np.bincount(CLASS[data[x:y]], minlength=7) for x, y in pieces(data))
                continue
            row = np.repeat(np.arange(b - a), np.diff(offsets))
            chars[a:b] = np.bincount(row * 7 + CLASS[data], minlength=(b - a) * 7).reshape(-1, 7)
        for a, b, data, offsets in each_part(lowered(batch.column("text"))):
            h, rows = hashed_words(data, offsets)
            total[a:b] = np.bincount(rows, minlength=b - a)
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[k] == h
            seen[a:b] = np.bincount(rows[hit] * len(words) + k[hit], minlength=(b - a) * len(words)).reshape(-1, len(words))
        width = max(map(len, common.values()), default=0)
        own = np.zeros((n, width + 1), dtype=np.int64)
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang, at in column.items():
            mine = np.flatnonzero(langs == lang)
            own[mine, : len(at)] = seen[mine][:, at]
        own[:, width] = total - own.sum(axis=1)
        flat = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), flat(chars[:, :6]), flat(own)], names=["doc_id", "lang", "chars", "words"])


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; null if either is empty of counts."""
    sp, sq = (F.aggregate(x, F.lit(0.0), lambda s, v: s + v) for x in (p, q))

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    # the totals are arrays beside the counts, since a lambda would compute them anew for every element
    p, q = (F.zip_with(x, F.array_repeat(s, F.size(x)), lambda v, t: v / t) for x, s in ((p, sp), (q, sq)))
    each = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.when((sp > 0) & (sq > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / 2)))


def judge(docs: DataFrame, common: dict[str, list[str]] = COMMON, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """(doc_id, lang, n_words, char_distance, word_distance, keep) of every document; distances null where not judged."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = max(map(len, common.values()), default=0)
    rows = pick(docs, doc_id="doc_id", lang=F.col("lang").cast("string"), text="text")
    counts = written(rows.mapInArrow(lean(lambda it: _histograms(it, common)), f"doc_id {kind}, lang string, chars array<bigint>, words array<bigint>"), "histograms")
    sums = lambda c, n: F.array(*[F.sum(F.element_at(c, i + 1)) for i in range(n)])
    reference = counts.where("lang is not null").groupBy("lang").agg(sums("chars", 6).alias("all_chars"), sums("words", width + 1).alias("all_words"))
    joined = counts.join(reference, "lang", "left")
    n_chars, n_words = (F.aggregate(c, F.lit(0).cast("bigint"), lambda s, v: s + v) for c in ("chars", "words"))
    judged = joined.select(
        "doc_id",
        "lang",
        n_words.alias("n_words"),
        F.when(n_chars >= MIN_CHARS, F.round(distance(F.col("chars"), F.col("all_chars")), 6)).alias("char_distance"),
        F.when((n_words >= MIN_WORDS) & F.col("lang").isin(*common), F.round(distance(F.col("words"), F.col("all_words")), 6)).alias("word_distance"),
    )
    return judged.withColumn("keep", (F.coalesce("char_distance", F.lit(0.0)) <= max_char) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    lists = " ".join("WHEN '{}' THEN [{}]".format(k, ", ".join(f"'{w}'" for w in v)) for k, v in COMMON.items())
    classes = ["[a-z]", "[A-Z]", "[0-9]", "[ \\t\\n\\r]", "[^\\x00-\\x7F]"]
    of = ", ".join(f"length(t) - length(regexp_replace(t, '{c}', '', 'g'))" for c in classes)
    other = "length(regexp_replace(t, '[a-zA-Z0-9 \\t\\n\\r]|[^\\x00-\\x7F]', '', 'g'))"
    jsd = (
        "sqrt(greatest(0.0, list_sum(list_transform(range(1, len({0}) + 1), lambda i: "
        "(CASE WHEN {0}[i] > 0 THEN {0}[i] / {2} * log2(2 * ({0}[i] / {2}) / ({0}[i] / {2} + {1}[i] / {3})) ELSE 0.0 END)"
        " + (CASE WHEN {1}[i] > 0 THEN {1}[i] / {3} * log2(2 * ({1}[i] / {3}) / ({0}[i] / {2} + {1}[i] / {3})) ELSE 0.0 END))) / 2))"
    )
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, CASE lang {lists} ELSE [] END AS listed FROM documents),
found AS (SELECT *, [{of}, {other}] AS c, regexp_extract_all(lower(t), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM texts),
tally AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w, listed FROM found) WHERE list_contains(listed, w) GROUP BY r, w),
slots AS (SELECT r, i, w FROM (SELECT r, unnest(range(1, len(listed) + 1)) AS i, unnest(listed) AS w FROM found)),
filled AS (SELECT s.r, list(coalesce(n, 0) ORDER BY i) AS ns FROM slots s LEFT JOIN tally t ON s.r = t.r AND s.w = t.w GROUP BY s.r),
docs AS (SELECT f.r, doc_id, lang, c, len(ws) AS n_words, list_append(coalesce(ns, []), len(ws) - coalesce(list_sum(ns), 0)) AS w FROM found f LEFT JOIN filled g ON f.r = g.r),
ref_c AS (SELECT lang, list(s ORDER BY i) AS qc FROM (SELECT lang, i, sum(v) AS s FROM (SELECT lang, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS v FROM docs) GROUP BY lang, i) GROUP BY lang),
ref_w AS (SELECT lang, list(s ORDER BY i) AS qw FROM (SELECT lang, i, sum(v) AS s FROM (SELECT lang, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS v FROM docs) GROUP BY lang, i) GROUP BY lang),
joined AS (SELECT d.*, qc, qw, list_sum(c)::DOUBLE AS sc, list_sum(qc)::DOUBLE AS sqc, list_sum(w)::DOUBLE AS sw, list_sum(qw)::DOUBLE AS sqw FROM docs d LEFT JOIN ref_c USING (lang) LEFT JOIN ref_w USING (lang)),
judged AS (SELECT doc_id, lang, n_words, CASE WHEN sc >= {MIN_CHARS} THEN round({jsd.format("c", "qc", "sc", "sqc")}, 6) END AS char_distance,
  CASE WHEN n_words >= {MIN_WORDS} AND len(w) > 1 THEN round({jsd.format("w", "qw", "sw", "sqw")}, 6) END AS word_distance FROM joined)
SELECT doc_id, lang, n_words, char_distance, word_distance, coalesce(char_distance, 0) <= {MAX_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE} AS keep FROM judged"""


ORACLE_SQL = _oracle()
