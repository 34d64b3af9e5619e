"""Okapi BM25 as tables: a table of chunks with their terms, and batches of queries answered in one pass over it.

Score: the sum over the query's tokens, repeated ones included, of idf * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)). idf is
ln(N - n + 0.5) - ln(n + 0.5); where that is negative it is EPSILON times the mean over the vocabulary. All chunks are
ranked: those without a query term score 0 and fill up to k, ahead of negative scores. Ties keep the chunks' order.

The postings stay with their chunks, so that building shuffles nothing but the vocabulary's counts, and a search adds up a chunk's score
where the chunk lies: every task keeps the k best of its chunks for each query, and only these meet in a shuffle. The query terms, which
go to all tasks, are those of at most QUERIES queries; more are answered in several passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.functions import arrow
from rankforge.functions import text as T

EPSILON, QUERIES, HITS, TOKENS = 0.25, 4096, 1 << 18, 1 << 18


@dataclass
class Bm25Index:
    """chunks(chunk_id, ordinal, dl, terms, tfs), terms(term, df, idf), corpus(n, avgdl) of one row."""

    chunks: DataFrame
    terms: DataFrame
    corpus: DataFrame

    TABLES = ("chunks", "terms", "corpus")

    @property
    def postings(self) -> DataFrame:
        """(term, chunk_id, ordinal, tf, dl)."""
        return self.chunks.select("chunk_id", "ordinal", "dl", F.inline(F.arrays_zip("terms", "tfs"))).select(F.col("terms").alias("term"), "chunk_id", "ordinal", F.col("tfs").alias("tf"), "dl")

    def save(self, path: str) -> Bm25Index:
        """Parquet tables under path."""
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        return Bm25Index.load(self.chunks.sparkSession, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bm25Index:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in cls.TABLES])

    def cache(self) -> Bm25Index:
        """Kept by Spark, in memory or on disk; the statistics are derived from the kept chunks."""
        kept = self.chunks.cache()
        return Bm25Index(kept, *[d.cache() for d in _statistics(kept)])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each chunk, as codes of a piece's distinct words."""
    for batch in batches:
        for a, b in arrow.pieces(arrow.byte_lengths(batch.column("text")), arrow.BYTES):
            sizes, code, words = arrow.words(batch.column("text").slice(a, b - a))
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.DictionaryArray.from_arrays(pa.array(code), words))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("chunk_id", "ordinal")), tokens], names=["chunk_id", "ordinal", "tokens"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of each chunk and their counts."""
    for batch in batches:
        lengths = arrow.lengths(batch.column("tokens"))
        for a, b in arrow.pieces(lengths, TOKENS):
            tokens, sizes = batch.column("tokens").slice(a, b - a), lengths[a:b]
            known = pc.dictionary_encode(tokens.flatten())
            code, words = known.indices.to_numpy(zero_copy_only=False).astype(np.int64), known.dictionary
            key, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(words)) + code, return_counts=True)
            offsets = pa.array(np.searchsorted(key, np.arange(len(sizes) + 1) * max(1, len(words))).astype(np.int32))
            terms = pa.ListArray.from_arrays(offsets, words.take(pa.array(key % max(1, len(words)))))
            held = [batch.column(c).slice(a, b - a) for c in ("chunk_id", "ordinal")]
            yield pa.RecordBatch.from_arrays([*held, pa.array(sizes, pa.int32()), terms, pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))], names=["chunk_id", "ordinal", "dl", "terms", "tfs"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, tf, df) of a piece of a batch of (key, text); rows without a key count for tf only."""
    for batch in batches:
        for a, b in arrow.pieces(arrow.byte_lengths(batch.column(1)), arrow.BYTES):
            sizes, code, words = arrow.words(batch.column(1).slice(a, b - a))
            width, row = max(1, len(words)), np.repeat(np.arange(len(sizes)), sizes)
            named = pc.is_valid(batch.column(0).slice(a, b - a)).to_numpy(zero_copy_only=False)[row]
            tf, df = np.bincount(code, minlength=len(words)), np.bincount(np.unique(row[named] * width + code[named]) % width, minlength=len(words))
            some = pa.array(np.flatnonzero(tf))
            yield pa.RecordBatch.from_arrays([words.take(some), pa.array(tf.astype(np.int64)).take(some), pa.array(df.astype(np.int64)).take(some)], names=["term", "tf", "df"])


def term_counts(texts: DataFrame, key: str) -> DataFrame:
    """(term, tf, df): occurrences of each word and distinct keys that have it. Each task counts its own rows, only keys that repeat are shuffled with their words."""
    repeated = texts.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    single, several = texts, None
    if not repeated.isEmpty():
        single, several = texts.join(repeated, key, "left_anti"), texts.join(repeated, key, "left_semi")
    parts = single.select(key, F.make_valid_utf8("text").alias("text")).mapInArrow(arrow.lean(_summed), "term string, tf bigint, df bigint")
    if several is not None:
        each = several.select(key, F.explode(T.words("text")).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
        parts = parts.union(each.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")))
    return parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _statistics(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    corpus = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(corpus).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    terms = raw.crossJoin(raw.agg((EPSILON * F.avg("raw")).alias("floor"))).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    return terms, corpus


def build(chunks: DataFrame) -> Bm25Index:
    """From chunks(chunk_id, ordinal, text). Each text is tokenised once."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    texts = chunks.select("chunk_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias("text"))
    counted = texts.mapInArrow(arrow.lean(lambda batches: _counted(_tokens(batches))), f"chunk_id {kind}, ordinal bigint, dl int, terms array<string>, tfs array<int>")
    return Bm25Index(counted, *_statistics(counted))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times) from queries(query_id, query)."""
    return queries.select("query_id", F.explode(T.words("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


class _Best:
    """The k best chunks of each of n lists so far, as flat arrays in order of list, score and place."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.list, self.score, self.ordinal, self.chunk = (np.zeros(0, dtype=t) for t in (np.int64, np.float64, np.int64, object))

    def add(self, scores: np.ndarray, ordinal: np.ndarray, chunk: np.ndarray) -> None:
        """scores of (chunks, lists); compared to nine digits, so that the order of summing cannot matter."""
        last = np.searchsorted(self.list, np.arange(self.n), side="right") - 1
        full = np.bincount(self.list, minlength=self.n) >= self.k
        floor = np.full(self.n, -np.inf)
        floor[full] = self.score[last[full]] - 2e-9
        i, j = np.nonzero(scores >= floor)
        parts = ((self.list, j), (self.score, scores[i, j]), (self.ordinal, ordinal[i]), (self.chunk, chunk[i]))
        self.list, self.score, self.ordinal, self.chunk = (np.concatenate(p) for p in parts)
        order = np.lexsort((np.argsort(np.argsort(self.chunk, kind="stable"), kind="stable"), self.ordinal, -np.round(self.score, 9), self.list))
        order = order[np.arange(len(order)) - np.searchsorted(self.list[order], self.list[order]) < self.k]
        self.list, self.score, self.ordinal, self.chunk = (x[order] for x in (self.list, self.score, self.ordinal, self.chunk))


def _pass(index: Bm25Index, queries: DataFrame, k: int, grid: list[tuple]) -> DataFrame:
    """(query, config, chunk_id, ordinal, score): each task's k best for every query and configuration; query counts from 0."""
    asked = queries.select("query_id").distinct().orderBy("query_id").collect()  # at most QUERIES
    number = {r.query_id: i for i, r in enumerate(asked)}
    rows = query_terms(queries).join(index.terms.select("term", "idf"), "term").collect()
    at = index.corpus.first()
    avgdl, n = float(at.avgdl or 1.0) or 1.0, len(asked)
    vocabulary = sorted({r.term for r in rows})
    place = {t: i for i, t in enumerate(vocabulary)}
    hits = sorted((place[r.term], number[r.query_id], r.times * r.idf) for r in rows)
    q_term, q_query, q_weight = (np.array([h[i] for h in hits], dtype=t) for i, t in enumerate((np.int64, np.int64, np.float64)))
    first = np.searchsorted(q_term, np.arange(len(vocabulary) + 1))
    kind = index.chunks.schema["chunk_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best = pa.array(vocabulary, pa.string()), [_Best(n, k) for _ in grid]
        chunk_type = None
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in arrow.pieces(arrow.lengths(whole.column("terms")), TOKENS)):
            chunk_type = batch.schema.field("chunk_id").type
            chunk, ordinal, dl = np.array(batch.column("chunk_id").to_pylist(), dtype=object), batch.column("ordinal").to_numpy(), batch.column("dl").to_numpy()
            terms, tf = batch.column("terms"), batch.column("tfs").flatten().to_numpy()
            row = np.repeat(np.arange(len(dl)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            term = pc.fill_null(pc.index_in(terms.flatten(), known), -1).to_numpy()
            row, tf, term = row[term >= 0], tf[term >= 0], term[term >= 0]
            each = first[term + 1] - first[term]  # queries that ask for the term
            upto = np.concatenate([[0], np.cumsum(np.bincount(row, weights=each, minlength=len(dl)) + n)])
            a = 0
            while a < len(dl):  # as many chunks at a time as give at most HITS pairs
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + HITS, side="right")) - 1)
                mine = slice(*np.searchsorted(row, [a, b]))
                r, t, f, e = row[mine] - a, term[mine], tf[mine].astype(np.float64), each[mine]
                own = np.repeat(np.arange(len(r)), e)
                pair = first[t][own] + np.arange(len(own)) - np.repeat(np.cumsum(e) - e, e)
                cell = r[own] * n + q_query[pair]
                for (_, k1, b_), held in zip(grid, best):
                    part = f * (k1 + 1) / (f + k1 * (1 - b_ + b_ * dl[a:b][r] / avgdl))
                    held.add(np.bincount(cell, weights=part[own] * q_weight[pair], minlength=(b - a) * n).reshape(b - a, n), ordinal[a:b], chunk[a:b])
                a = b
        for (c, _, _), held in zip(grid, best):
            if len(held.list):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held.list, pa.int32()), pa.array(np.full(len(held.list), c), pa.int32()), pa.array(held.chunk.tolist(), chunk_type), pa.array(held.ordinal), pa.array(held.score)], names=["query", "config_id", "chunk_id", "ordinal", "score"]
                )

    found = index.chunks.mapInArrow(arrow.lean(score), f"query int, config_id int, chunk_id {kind}, ordinal bigint, score double")
    names = queries.sparkSession.createDataFrame([(i, r.query_id) for r, i in zip(asked, range(n))], f"query int, query_id {queries.schema['query_id'].dataType.simpleString()}")
    return found.join(F.broadcast(names), "query")


def search(index: Bm25Index, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, grid: DataFrame | None = None) -> DataFrame:
    """(query_id, [config_id,] chunk_id, ordinal, score, rank): k chunks a query, or all if there are fewer.

    With grid(config_id, k1, b), a short table, all configurations are scored from one pass over the matching postings.
    """
    if k < 1:
        raise ValueError("top_k must be above zero")
    keys = ["query_id"] if grid is None else ["query_id", "config_id"]
    configs = [(0, float(k1), float(b))] if grid is None else [(r.config_id, r.k1, r.b) for r in grid.select("config_id", "k1", "b").collect()]
    queries = queries.select("query_id", "query")
    passes = max(1, -(-queries.count() // QUERIES))
    parts = [queries] if passes == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(2 * passes)) == i) for i in range(2 * passes)]  # of about half the size, so that none is much over
    found = reduce(DataFrame.unionByName, [_pass(index, p, k, configs) for p in parts])
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "ordinal", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*keys, "chunk_id", "ordinal", "score", "rank")
