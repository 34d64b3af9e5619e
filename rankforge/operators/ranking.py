"""Fusion of ranked lists, reranking and query expansion. Rankings: (query_id, chunk_id, ordinal, score, rank)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions import text as T
from rankforge.operators.dense import search

POOL = 3  # a hybrid takes this many times top_k from each side


def reciprocal_rank_fusion(lists: list[DataFrame], k: int, rrf_k: int = 60) -> DataFrame:
    """The sum of 1 / (rrf_k + rank) over the lists; ties go to the earlier list, then the better rank in it."""
    tagged = [d.select("query_id", "chunk_id", "rank", F.lit(i).alias("list")) for i, d in enumerate(lists)]
    every = reduce(DataFrame.unionByName, tagged)
    fused = every.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first.list", "first.rank", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("first")


def lexical_overlap(query: str | Column, text: str | Column) -> Column:
    """The share of the query's distinct words that the text holds; 0 without any."""
    q = F.array_distinct(T.words(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.words(text))) / F.size(q)).otherwise(0.0)


def cross_encoder(model_name: str) -> Callable[[str, str], Column]:
    """Scores by a cross-encoder, loaded once a worker. Needs sentence-transformers and the weights."""

    def score(query: str, text: str) -> Column:
        @F.pandas_udf("double")
        def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            from sentence_transformers import CrossEncoder

            model = CrossEncoder(model_name)
            for q, t in batches:
                yield pd.Series(model.predict(list(zip(q, t)))).astype(float)

        return predict(F.col(query), F.col(text))

    return score


# by name: rankings and k to one ranking; the scores of a reranker from its configuration section
FUSIONS: dict[str, Callable[[list[DataFrame], int, dict], DataFrame]] = {"reciprocal_rank_fusion": lambda lists, k, c: reciprocal_rank_fusion(lists, k, c["rrf_k"])}
RERANKERS: dict[str, Callable[[dict], Callable[[str, str], Column]]] = {"lexical": lambda c: lexical_overlap, "cross_encoder": lambda c: cross_encoder(c["model_name"])}


def rerank(results: DataFrame, queries: DataFrame, chunks: DataFrame, top_n: int, score: Callable[[str, str], Column] = lexical_overlap) -> DataFrame:
    """Scores and ranks by the original query; ties keep the earlier rank; cut to top_n. Texts join only the ranked chunks."""
    joined = results.drop("score").join(queries.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    scored = joined.withColumn("score", score("query", "text")).drop("query", "text").withColumnRenamed("rank", "before")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "before")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).drop("before")


def vocabulary(chunks: DataFrame, size: int = 512, shortest: int = 3) -> DataFrame:
    """(term, n, place): the most frequent words of at least `shortest` letters; ties by first occurrence in the chunks' order."""
    at = chunks.select("ordinal", F.posexplode(T.words("text")).alias("i", "term")).where(F.length("term") >= shortest)
    counted = at.groupBy("term").agg(F.count("*").alias("n"), F.min(F.struct("ordinal", "i")).alias("first"))
    top = counted.orderBy(F.desc("n"), "first").limit(size)
    return top.select("term", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first")).alias("place"))


def expand(queries: DataFrame, terms: DataFrame, term_vectors: DataFrame, query_vectors: DataFrame, most: int = 3, threshold: float = 0.35) -> DataFrame:
    """queries with enhanced_query and expansion_terms: the nearest vocabulary terms that the query lacks.

    terms(term, place), term_vectors(term, vector), query_vectors(query_id, vector).
    """
    n = terms.count()
    if not n:
        return queries.withColumns({"enhanced_query": F.col("query"), "expansion_terms": F.array().cast("array<string>")})
    near = search(term_vectors, query_vectors, n, key="term").where(F.round("score", 9) >= threshold)
    own = queries.select("query_id", F.explode(T.words("query")).alias("term")).distinct()
    fresh = near.join(own, ["query_id", "term"], "left_anti").join(terms.select("term", "place"), "term")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "place")
    chosen = fresh.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", "term"))).alias("c"))
    added = F.coalesce(F.col("c.term"), F.array().cast("array<string>"))
    return queries.join(chosen, "query_id", "left").withColumns({"expansion_terms": added, "enhanced_query": F.concat_ws(" ", "query", added)}).drop("c")
