"""Relevance of rankings to labels, retrieval metrics, latency percentiles, label alignment and splits."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions import text as T

IDENTIFIERS = ("chunk_id", "document_id", "text", "title", "source")


def qrels(examples: DataFrame) -> DataFrame:
    """(query_id, place, label) from examples(query_id, query, positive_documents)."""
    return examples.select("query_id", F.posexplode("positive_documents").alias("place", "label"))


def identifiers(chunks: DataFrame) -> DataFrame:
    """(chunk_id, label): every string by which a label may name a chunk; a missing title or source is the empty string."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in chunks.columns else F.lit("") for c in IDENTIFIERS]
    return chunks.select("chunk_id", F.explode(F.array_distinct(F.array(*names))).alias("label"))


def containing(passages: DataFrame, chunks: DataFrame, postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the chunks(chunk_id, text) that hold the text of a passage(query_id, query) as it stands.

    A chunk that holds a passage holds its inner words as words of its own (the first and last may be parts of longer ones), so each passage
    meets only the chunks with its rarest inner word, by an equi-join with postings(term, chunk_id) and terms(term, df). Passages
    without an inner word are few and short, and are looked for everywhere.
    """
    words = T.words("query")
    inner = passages.select("query_id", F.explode(F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))).alias("term"))
    rarest = inner.join(terms.select("term", "df"), "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    candidates = rarest.join(postings.select("term", "chunk_id"), "term").select("query_id", "chunk_id")
    found = candidates.join(passages, "query_id").join(chunks, "chunk_id").where(F.contains("text", "query")).select("query_id", "chunk_id")
    short = passages.where(F.size(words) < 3)
    return found if short.isEmpty() else found.union(short.join(chunks, F.contains("text", "query")).select("query_id", "chunk_id"))


def relevance(results: DataFrame, labels: DataFrame, names: DataFrame) -> DataFrame:
    """results with matched_label and relevant: a chunk matches its first positive label, and only a label's first match counts.

    The choice among five identifiers is an equi-join on exploded names, never a disjunction.
    """
    named = results.select("query_id", "chunk_id", "rank").join(names, "chunk_id").join(labels, ["query_id", "label"])
    matched = named.groupBy("query_id", "chunk_id", "rank").agg(F.min_by("label", "place").alias("matched_label"))
    first = F.row_number().over(Window.partitionBy("query_id", "matched_label").orderBy("rank"))
    flags = matched.withColumn("relevant", first == 1)
    return results.join(flags, ["query_id", "chunk_id", "rank"], "left").fillna(False, ["relevant"])


def ideal_dcg(total: Column, k: int) -> Column:
    n = F.least(total, F.lit(k)).cast("int")
    return F.when(n < 1, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)))


def query_metrics(flags: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """(query_id, precision_at_k, recall_at_k, reciprocal_rank, ndcg_at_k) of every query in totals(query_id, total)."""
    if k < 1:
        raise ValueError("k must be above zero")
    hit = F.col("relevant") & (F.col("rank") <= k)
    sums = flags.groupBy("query_id").agg(F.count_if(hit).alias("hits"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    best = ideal_dcg(F.col("total"), k)
    return totals.join(sums, "query_id", "left").select(
        "query_id",
        (F.coalesce("hits", F.lit(0)) / k).alias("precision_at_k"),
        F.when(F.col("total") > 0, F.coalesce("hits", F.lit(0)) / F.col("total")).otherwise(0.0).alias("recall_at_k"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(best > 0, F.coalesce("dcg", F.lit(0.0)) / best).otherwise(0.0).alias("ndcg_at_k"),
    )


def aggregate_metrics(metrics: DataFrame) -> DataFrame:
    """Means over the queries, zeros without any."""
    names = {"precision_at_k": "precision_at_k", "recall_at_k": "recall_at_k", "reciprocal_rank": "mean_reciprocal_rank", "ndcg_at_k": "ndcg_at_k"}
    return metrics.agg(*[F.coalesce(F.avg(a), F.lit(0.0)).alias(b) for a, b in names.items()])


def latency_metrics(samples: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Mean and exact 50th, 95th and 99th percentiles (linear interpolation) of a latency column; zeros without samples."""
    p = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = samples.groupBy(*(by or [])).agg(F.avg(column).alias("m"), p.alias("p"))
    values = [F.col("m"), *[F.element_at("p", i) for i in (1, 2, 3)]]
    return out.select(*(by or []), *[F.coalesce(v, F.lit(0.0)).alias(n) for v, n in zip(values, ("average_latency_ms", "p50_latency_ms", "p95_latency_ms", "p99_latency_ms"))])


def check_alignment(labels: DataFrame, names: DataFrame) -> None:
    """ValueError if no label names any chunk."""
    if labels.join(names, "label", "left_semi").limit(1).count():
        return
    some = [r.label for r in names.select("label").where("label <> ''").distinct().orderBy("label").limit(5).collect()]
    wanted = [r.label for r in labels.select("label").distinct().orderBy("label").limit(5).collect()]
    raise ValueError(f"no label of the dataset names a chunk of the corpus; labels such as {wanted}, chunks such as {some}")


def alignment(labels: DataFrame, names: DataFrame) -> DataFrame:
    """One row: distinct labels and how many of them name a chunk."""
    distinct = labels.select("label").distinct()
    known = distinct.join(names.select("label").distinct().withColumn("known", F.lit(1)), "label", "left")
    return known.agg(F.count("*").alias("labels"), F.count("known").alias("matched"))


def split_indices(n: int, ratio: float = 0.2, seed: int = 42) -> set[int]:
    """The positions of the test examples: the first of a seeded shuffle, at least one."""
    if not 0 < ratio < 1:
        raise ValueError("the test ratio must lie between 0 and 1")
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return set(order[: max(1, int(n * ratio)) if n > 1 else 1])


def train_test_split(examples: DataFrame, ratio: float = 0.2, seed: int = 42, order: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """Both parts of a labelled dataset, which is small by nature; a single example is the test part."""
    keys = [r[0] for r in examples.select(order).orderBy(order).collect()]
    chosen = split_indices(len(keys), ratio, seed) & set(range(len(keys)))
    test = examples.sparkSession.createDataFrame([(keys[i],) for i in sorted(chosen)], examples.select(order).schema)
    return examples.join(test, order, "left_anti"), examples.join(test, order, "left_semi")
