"""Benchmark runs: one, sweeps, grids, ablations and searches, each recorded as an experiment."""

from __future__ import annotations

import itertools
import json
import random
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.config import Config
from rankforge.functions.text import notes as joined
from rankforge.operators import chunking, dense, evaluation
from rankforge.plans import tpe
from rankforge.plans.retrieval import Retriever
from rankforge.sources import storage, stores

RECHUNKED = {f"chunking.{k}" for k in ("strategy", "chunk_size", "overlap", "semantic_similarity_threshold", "semantic_min_sentences", "semantic_encoder_model")}

SEARCHED = ("retrieval.top_k", "retrieval.fusion", "index.bm25.k1", "index.bm25.b", "reranking", "benchmark", "reporting")  # settings that no index depends on


def _built_from(config: Config) -> str:
    """The settings of a configuration that its index may depend on."""
    values = json.loads(json.dumps(config.values, default=str))
    for path in SEARCHED:
        *above, last = path.split(".")
        section = values
        for name in above:
            section = section.get(name, {})
        section.pop(last, None)
    return json.dumps(values, sort_keys=True)


def noop(df: DataFrame) -> None:
    """Run a plan without keeping its rows."""
    df.write.format("noop").mode("overwrite").save()


def timed(f: Callable[[], Any]) -> tuple[Any, float]:
    start = time.perf_counter()
    return f(), (time.perf_counter() - start) * 1000


def check_space(space: dict[str, Any], trials: int, objective: str) -> None:
    if trials <= 0:
        raise ValueError("the number of trials must be above zero")
    if objective != "ndcg":
        raise ValueError("the objective must be ndcg")
    if not space:
        raise ValueError("the search space is empty")
    for path, spec in space.items():
        tpe.checked(path, spec)
        if path == "retrieval.retriever":
            raise ValueError("retrieval.retriever is fixed by the configuration; search each retriever separately")
        if path.startswith("query_enhancement."):
            raise ValueError("query enhancement settings are variants to benchmark, not parameters to search")


def combinations(parameters: dict[str, list]) -> list[dict[str, Any]]:
    """Every choice of one value for each parameter."""
    return [dict(zip(parameters, values)) for values in itertools.product(*parameters.values())]


def best_of(results: list[dict[str, Any]]) -> dict[str, Any] | None:
    """The best run of a sweep, a grid or a search by nDCG; among equals the later."""
    done = [r for r in results if r.get("ndcg_at_k") is not None]
    return max(enumerate(done), key=lambda r: (r[1]["ndcg_at_k"], r[0]))[1] if done else None


class Runner:
    """Runs configurations over a corpus and a labelled dataset.

    mode="batch" answers all queries in one plan and records batch_ms_per_query; mode="serve" asks them one by one and
    records their latency percentiles. A throughput is never recorded as a latency percentile.

    Runs of one sweep, grid, ablation or search, or of one `with` block, whose configurations differ in SEARCHED only have one index,
    built by the first of them; its times are recorded with each. The corpus must not change meanwhile.
    """

    def __init__(self, spark: SparkSession, directory: str, mode: str = "serve"):
        self.spark, self.store, self.mode = spark, stores.ExperimentStore(spark, directory), mode
        self._depth, self._key, self._built, self._times = 0, None, None, {}

    def __enter__(self) -> Runner:
        self._depth += 1
        return self

    def __exit__(self, *error: Any) -> None:
        self._depth -= 1
        if not self._depth:
            self._release()

    def _release(self) -> None:
        if self._built:
            self._built.unpersist()
        self._key, self._built, self._times = None, None, {}

    def _retriever(self, config: Config, corpus: str, chunks: DataFrame, rechunked: bool) -> tuple[Retriever, dict[str, float]]:
        """A retriever over the chunks, and the milliseconds of its embedding and its index."""
        retriever, key = Retriever(self.spark, config), (str(corpus), rechunked, _built_from(config))
        if self._built and self._key == key and retriever.shares:
            return retriever.share(self._built), self._times
        self._release()
        self._built, vectors, times = retriever, None, {"embedding_time_ms": 0.0}
        if retriever.embeds:
            vectors = retriever.embed(chunks.select("chunk_id", "text"), "chunk_id").cache()
            times["embedding_time_ms"] = timed(lambda: noop(vectors))[1]
        _, times["index_build_time_ms"] = timed(lambda: self._materialise(retriever.build(chunks, vectors)))
        self._key, self._times = key, times  # not before it is complete
        return retriever, times

    @staticmethod
    def _rechunked(mode: str, overrides: dict[str, Any]) -> bool:
        return mode in ("sweep", "grid_search", "optuna") and bool(RECHUNKED & set(overrides))

    def _chunks(self, config: Config, corpus: str, mode: str, overrides: dict[str, Any]) -> DataFrame:
        if self._rechunked(mode, overrides):
            return chunking.chunk_documents(stores.load_preprocessed(self.spark, corpus), config)
        return stores.load_corpus(self.spark, corpus)[1]

    def _record(self, config: Config, corpus: str, dataset: str, mode: str, notes: str | None) -> dict[str, Any]:
        c, q = config, "+".join(config.methods) or "none"
        return {
            "experiment_id": "exp-" + uuid.uuid4().hex[:12], "timestamp": datetime.now(timezone.utc).isoformat(), "mode": mode, "status": "running", "configuration": json.dumps(c.values),
            "corpus_path": str(corpus), "dataset_path": str(dataset), "chunking_strategy": c["chunking.strategy"], "chunk_size": c["chunking.chunk_size"], "embedding_model": c["embedding.model_name"],
            "effective_backend": dense.backend(c["embedding.backend"]) if c["retrieval.retriever"] != "bm25" else "none", "retriever": c["retrieval.retriever"], "query_enhancement": q,
            "reranker": c["reranking.model_name"] if c["reranking.enabled"] else "none", "top_k": c["retrieval.top_k"], "selected_device": c.resolved_device, "notes": joined(c["benchmark.notes"], notes),
        }

    def run(self, config: Config, corpus: str, dataset: str, mode: str = "single", notes: str | None = None, overrides: dict[str, Any] | None = None) -> dict[str, Any]:
        """The finished record, with per-query results under `query_results`; a failure is recorded and raised again."""
        examples = stores.load_examples(self.spark, dataset)
        record = self._record(config, corpus, dataset, mode, notes)
        self.store.save(record)
        self.__enter__()
        try:
            chunks = self._chunks(config, corpus, mode, overrides or {})
            labels, names = evaluation.qrels(examples), evaluation.identifiers(chunks)
            evaluation.check_alignment(labels, names)
            retriever, times = self._retriever(config, corpus, chunks, self._rechunked(mode, overrides or {}))
            record |= times
            if config["reranking.enabled"]:
                record["effective_reranker"] = retriever.effective_reranker()
            results = self._answer(retriever, examples.select("query_id", "query"), record)
            k = config["retrieval.top_k"]
            totals = examples.select("query_id", F.size("positive_documents").alias("total"))
            flags = evaluation.relevance(results, labels, names).cache()
            each = evaluation.query_metrics(flags, totals, k).cache()
            record |= evaluation.aggregate_metrics(each).first().asDict() | {"status": "completed"}
            self.store.save(record)
            found = flags.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved"))
            rows = examples.select("query_id", "query", "positive_documents").join(each, "query_id").join(found, "query_id", "left").orderBy("query_id").collect()
            out = record | {"sample_count": len(rows), "query_results": [r.asDict() for r in rows]}
            storage.write_text(self.spark, f"{config['benchmark.results_directory']}/{record['experiment_id']}_benchmark.json", json.dumps(out, indent=2, default=str))
            return out
        except Exception:
            self.store.save(record | {"status": "failed"})
            raise
        finally:
            self.__exit__()

    @staticmethod
    def _materialise(retriever: Retriever) -> None:
        for df in retriever.tables():
            noop(df)

    def _answer(self, retriever: Retriever, queries: DataFrame, record: dict[str, Any]) -> DataFrame:
        schema = "query_id int, chunk_id string, score double, rank int, retriever string, reranked boolean"
        rows, times = [], []
        if self.mode == "batch":
            rows, total = timed(lambda: retriever.retrieve(queries).collect())  # top_k rows a labelled query
            record["batch_ms_per_query"] = total / max(1, queries.count())
            return self.spark.createDataFrame(rows, schema)
        for q in queries.orderBy("query_id").collect():
            one = self.spark.createDataFrame([q], queries.schema)
            found, ms = timed(lambda: retriever.retrieve(one).collect())
            rows += found
            times.append(float(ms))
        samples = self.spark.createDataFrame([(t,) for t in times or [0.0]], "ms double")
        record |= evaluation.latency_metrics(samples, "ms").first().asDict()
        return self.spark.createDataFrame(rows, schema)

    def _varied(self, config: Config, overrides: dict[str, Any], corpus: str, dataset: str, mode: str, notes: str | None) -> dict[str, Any]:
        return self.run(config.with_overrides(overrides), corpus, dataset, mode, notes, overrides)

    def sweep(self, config: Config, corpus: str, dataset: str, parameters: dict[str, list], notes: str | None = None) -> list[dict]:
        """One parameter at a time, the others as configured."""
        with self:
            return [self._varied(config, {p: v}, corpus, dataset, "sweep", joined(notes, f"sweep:{p}={v}")) for p, values in parameters.items() for v in values]

    def grid(self, config: Config, corpus: str, dataset: str, parameters: dict[str, list], notes: str | None = None) -> list[dict]:
        """Every combination."""
        with self:
            return [self._varied(config, o, corpus, dataset, "grid_search", joined(notes, "grid:" + ", ".join(f"{k}={v}" for k, v in o.items()))) for o in combinations(parameters)]

    def ablation(self, config: Config, corpus: str, dataset: str, variants: dict[str, dict], notes: str | None = None) -> list[dict]:
        """The configuration as it is, then each variant; chunks are never cut anew."""
        with self:
            return [self._varied(config, o, corpus, dataset, "ablation", joined(notes, f"ablation:{name}")) for name, o in [("baseline", {}), *variants.items()]]

    def search(self, config: Config, corpus: str, dataset: str, space: dict[str, Any], trials: int, objective: str = "ndcg", notes: str | None = None, seed: int | None = None) -> tuple[list[dict], dict, float]:
        """A tree of Parzen estimators proposes each trial from those before it; among equals the later trial is best."""
        check_space(space, trials, objective)
        results: list[dict] = []

        def trial(n: int, overrides: dict[str, Any]) -> float:
            results.append(self._varied(config, overrides, corpus, dataset, "optuna", joined(notes, f"search:trial={n},overrides={overrides}")) | {"search_overrides": overrides})
            return results[-1]["ndcg_at_k"]

        with self:
            for n in range(trials):
                seen = [(r["search_overrides"], r["ndcg_at_k"]) for r in results]
                trial(n, tpe.propose(random.Random(f"{seed}-{n}") if seed is not None else random.Random(), space, seen))
        best = best_of(results)
        return results, best, best["ndcg_at_k"]
