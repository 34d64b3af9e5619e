"""Scores, leaderboards, recommendations, trade-offs and comparisons over a flat table of experiments.

Metrics are nullable; an experiment without quality or latency is not ranked. Ties: the newer experiment, then its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUALITY = ("mean_reciprocal_rank", "ndcg_at_k", "recall_at_k", "precision_at_k")
WEIGHTS = {"quality_weight": 0.65, "latency_weight": 0.2, "embedding_cost_weight": 0.075, "index_build_weight": 0.075}
METRICS = {
    "mrr": ("mean_reciprocal_rank", False), "recall": ("recall_at_k", False), "precision": ("precision_at_k", False), "ndcg": ("ndcg_at_k", False),
    "average_latency": ("average_latency_ms", True), "p95": ("p95_latency_ms", True), "p99": ("p99_latency_ms", True),
    "embedding_time": ("embedding_time_ms", True), "index_build_time": ("index_build_time_ms", True), "overall_score": ("overall_score", False),
}
COMPONENTS = {"retriever": "Retriever", "query_enhancement": "Query enhancement", "reranker": "Reranker", "chunking_strategy": "Chunking"}
ROW = ("experiment_id", "retriever", "embedding_model", *sorted(QUALITY), "average_latency_ms", "p95_latency_ms", "p99_latency_ms", "embedding_time_ms", "index_build_time_ms", "overall_score")


def rankable(experiments: DataFrame) -> DataFrame:
    return experiments.where("mean_reciprocal_rank is not null and average_latency_ms is not null")


def scored(experiments: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Rankable experiments with overall_score: weighted mean quality, and costs as shares of their range (0 where all are equal)."""
    ok = rankable(experiments)
    costs = {"latency_weight": "average_latency_ms", "embedding_cost_weight": "embedding_time_ms", "index_build_weight": "index_build_time_ms"}
    ends = ok.agg(*[f(c).alias(f"{n}_{c}") for c in costs.values() for n, f in (("lo", F.min), ("hi", F.max))])
    score = weights["quality_weight"] * sum((F.col(c) for c in QUALITY[1:]), F.col(QUALITY[0])) / 4
    for w, c in costs.items():
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        score = score + weights[w] * (1 - F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0))
    return ok.crossJoin(ends).withColumn("overall_score", score).select(*[c for c in experiments.columns if c != "overall_score"], "overall_score")


def _order(metric: str) -> list[Column]:
    if metric not in METRICS:
        raise ValueError(f"cannot sort by {metric!r}; choose from {', '.join(METRICS)}")
    column, ascending = METRICS[metric]
    value = F.round(column, 12)
    return [value.asc() if ascending else value.desc(), F.desc("timestamp"), F.col("experiment_id")]


def leaderboard(experiments: DataFrame, sort_by: str = "overall_score") -> DataFrame:
    """Scored experiments with their rank by a metric; costs ascend, all else descends.

    One global order: experiments are runs, a table of thousands and not of the corpus's size.
    """
    w = Window.orderBy(*_order(sort_by))
    return experiments.withColumn("rank", F.row_number().over(w)).select(*ROW, "rank")


def recommendation(experiments: DataFrame) -> DataFrame:
    """One row: the best scored experiment, the next two, and why."""
    first = experiments.withColumn("place", F.row_number().over(Window.orderBy(*_order("overall_score")))).where("place <= 3")
    name = F.concat(F.col("chunking_strategy"), F.lit(" chunking"), *[x for c in ("embedding_model", "retriever", "query_enhancement", "reranker") for x in (F.lit(" + "), F.col(c))])
    best = first.where("place = 1").select("experiment_id", name.alias("recommended_pipeline"), "overall_score", F.lit(REASON).alias("reason"), F.array(*[F.concat(F.lit(f"{label}: "), F.col(c)) for label, c in EXPLAINED]).alias("explainability"))
    rest = first.where("place > 1").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "experiment_id"))), lambda x: x["experiment_id"]).alias("alternative_configurations"))
    return best.crossJoin(rest)


REASON = "Best balance of " + ", ".join(("quality", "latency", "embedding cost", "index build time")) + "."
EXPLAINED = (("Retriever", "retriever"), ("Embedding model", "embedding_model"), ("Chunking strategy", "chunking_strategy"), ("Query enhancement", "query_enhancement"), ("Reranker", "reranker"))


def best_runs(experiments: DataFrame, by: str) -> DataFrame:
    """(by, runs, best, worst, mean, best_id) of scored experiments: of a sweep, a grid or a search by what varies in it. Ties: the newer, then the later id."""
    order = F.struct(F.round("overall_score", 12), "timestamp", "experiment_id")
    return experiments.groupBy(by).agg(F.count("*").alias("runs"), F.max("overall_score").alias("best"), F.min("overall_score").alias("worst"), F.avg("overall_score").alias("mean"), F.max_by("experiment_id", order).alias("best_id"))


def component_averages(experiments: DataFrame) -> DataFrame:
    """(component, value, recall, latency) for the four components that vary."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(label).alias("component"), F.col(c).alias("value")) for i, (c, label) in enumerate(COMPONENTS.items())]))
    long = rankable(experiments).select(values.alias("v"), "recall_at_k", "p95_latency_ms", "timestamp")
    grouped = long.groupBy("v.place", "v.component", "v.value").agg(F.avg("recall_at_k").alias("recall"), F.avg("p95_latency_ms").alias("latency"), F.max("timestamp").alias("seen"))
    return grouped.withColumn("n", F.count("*").over(Window.partitionBy("component"))).where("n > 1").drop("n")


def tradeoffs(experiments: DataFrame) -> DataFrame:
    """(component, best_quality, quality, best_latency, latency, place): leaders of each component; they trade off where they differ."""
    a = component_averages(experiments).withColumns({"recall": F.round("recall", 9), "latency": F.round("latency", 9)})
    best = a.groupBy("place", "component").agg(F.max_by(F.struct("value", "recall"), F.struct("recall", "seen", "value")).alias("q"), F.min_by(F.struct("value", "latency"), F.struct("latency", "value")).alias("l"))
    return best.select("place", "component", F.col("q.value").alias("best_quality"), F.col("q.recall").alias("quality"), F.col("l.value").alias("best_latency"), F.col("l.latency").alias("latency"))


def observations(experiments: DataFrame) -> list[dict[str, str]]:
    """The trade-offs as titles and sentences."""
    out = []
    for r in tradeoffs(experiments).orderBy("place").collect():  # four rows at most
        out.append({"title": f"{r.component} quality leader", "description": f"{r.best_quality} has the highest mean Recall@K, {r.quality:.3f}."})
        if r.best_quality != r.best_latency:
            out.append({"title": f"{r.component} latency trade-off", "description": f"{r.best_quality} leads Recall@K with {r.quality:.3f}; {r.best_latency} has the lowest mean P95 latency, {r.latency:.2f} ms."})
    return out


def summary(experiment: dict, recommended_id: str) -> str:
    if experiment.get("mean_reciprocal_rank") is None or experiment.get("average_latency_ms") is None:
        return "Its metrics are incomplete, so there is no summary."
    figures = f"MRR {experiment['mean_reciprocal_rank']:.3f}, NDCG@K {experiment['ndcg_at_k']:.3f}, mean latency {experiment['average_latency_ms']:.2f} ms"
    verdict = "the recommended choice" if experiment["experiment_id"] == recommended_id else "an alternative"
    return f"{experiment['retriever']} retrieval with {experiment['embedding_model']}: {figures}. It is {verdict}."


def compare(experiments: DataFrame, ids: list[str]) -> DataFrame:
    """The named experiments in the order of the request, missing metrics as 0; an unknown id raises KeyError."""
    asked = experiments.sparkSession.createDataFrame(list(enumerate(ids)), "place int, experiment_id string")
    joined = asked.join(experiments.withColumn("known", F.lit(True)), "experiment_id", "left")
    if missing := [r[0] for r in joined.where("known is null").select("experiment_id").collect()]:
        raise KeyError(f"no experiment {', '.join(missing)}")
    numbers = [c for c, kind in experiments.dtypes if kind == "double"]
    return joined.drop("known").fillna(0.0, numbers).orderBy("place").drop("place")
