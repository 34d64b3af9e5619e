"""Corpora, vectors, labelled datasets and experiments on storage: Parquet tables, with the JSON forms for exchange."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.sources import storage

CHUNK = "chunk_id string, document_id string, text string, position int, token_count int, title string, source string"
EXAMPLES = "query_id int, query string, positive_documents array<string>, negative_documents array<string>, metadata string"
NUMBERS = ("precision_at_k", "recall_at_k", "mean_reciprocal_rank", "ndcg_at_k", "average_latency_ms", "p50_latency_ms", "p95_latency_ms", "p99_latency_ms", "batch_ms_per_query", "embedding_time_ms", "index_build_time_ms", "overall_score")
STRINGS = ("experiment_id", "mode", "status", "configuration", "corpus_path", "dataset_path", "chunking_strategy", "embedding_model", "effective_backend", "retriever", "query_enhancement", "reranker", "effective_reranker", "selected_device", "notes")
EXPERIMENT = ", ".join([*[f"{c} string" for c in STRINGS], "timestamp timestamp", "chunk_size int", "top_k int", *[f"{c} double" for c in NUMBERS]])


def save_corpus(path: str, documents: DataFrame, chunks: DataFrame, meta: dict[str, Any]) -> None:
    """Parquet tables documents/ and chunks/, by domain where there is one, and a line of meta.json."""
    for name, df in (("documents", documents), ("chunks", chunks)):
        writer = df.write.mode("overwrite")
        (writer.partitionBy("domain") if "domain" in df.columns else writer).parquet(f"{path}/{name}")
    stamp = {"generated_at": datetime.now(timezone.utc).isoformat(), **meta}
    documents.sparkSession.createDataFrame([(json.dumps(stamp),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of a Parquet corpus, or of one JSON file with `documents` and `chunks` lists."""
    if not str(path).endswith(".json"):
        return spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/chunks")
    if not storage.exists(spark, path):
        raise FileNotFoundError(path)
    whole = spark.read.option("multiLine", True).json(str(path))
    inner = whole.select(F.explode("chunks").alias("c"))
    fields = inner.schema["c"].dataType.fieldNames()
    meta = inner.schema["c"].dataType["metadata"].dataType.fieldNames() if "metadata" in fields else []
    named = [F.col(f"c.{f}") if f in fields else (F.col(f"c.metadata.{f}") if f in meta else F.lit(None).cast("string")).alias(f) for f in ("chunk_id", "document_id", "text", "position", "token_count", "title", "source")]
    docs = whole.select(F.explode("documents").alias("d")).select("d.*").withColumnRenamed("id", "document_id") if "documents" in whole.columns else spark.createDataFrame([], "document_id string, text string")
    return docs, inner.select(*named)


def load_preprocessed(spark: SparkSession, corpus: str) -> DataFrame:
    """The documents to be chunked anew: those preprocessed beside the corpus, as a table or a JSON list, or else the corpus's own."""
    beside = str(corpus).rstrip("/").rpartition("/")[0] or "."
    if storage.exists(spark, f"{beside}/preprocessed_documents"):
        return spark.read.parquet(f"{beside}/preprocessed_documents")
    if storage.exists(spark, f"{beside}/preprocessed_documents.json"):
        found = spark.read.option("multiLine", True).json(f"{beside}/preprocessed_documents.json")
        if "text" not in found.columns:
            raise ValueError(f"{beside}/preprocessed_documents.json must hold a list of documents")
        return found.withColumnRenamed("id", "document_id") if "id" in found.columns else found
    return load_corpus(spark, corpus)[0]


def export_json(df: DataFrame, path: str) -> None:
    """One JSON list in a file, for tables of documents to be exchanged."""
    storage.write_json_list(df, path)


def with_ordinal(chunks: DataFrame) -> DataFrame:
    """A number that follows (source, document, position): the order that decides ties."""
    keys = [F.coalesce(F.col("source"), F.lit("")), F.col("document_id"), F.col("position")]
    ordered = chunks.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.withColumn("ordinal", F.monotonically_increasing_id())


def unique_ids(chunks: DataFrame) -> DataFrame:
    """chunks themselves; ValueError if an id occurs twice."""
    twice = chunks.groupBy("chunk_id").count().where("count > 1").select("chunk_id").limit(5).collect()
    if twice:
        raise ValueError(f"chunk ids occur more than once: {', '.join(str(r[0]) for r in twice)}")
    return chunks


def save_vectors(vectors: DataFrame, path: str, model: str) -> None:
    vectors.withColumn("model_name", F.lit(model)).write.mode("overwrite").partitionBy("model_name").parquet(path)


def load_vectors(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return out if model is None else out.where(F.col("model_name") == model)


def parse_examples(content: Any) -> list[tuple]:
    """Rows of EXAMPLES from a list of examples, a mapping with `examples`, or one example."""
    if isinstance(content, dict):
        content = content["examples"] if "examples" in content else [content] if "query" in content else None
    if not isinstance(content, list):
        raise ValueError("a dataset is a list of examples, a mapping with examples, or one example")
    rows = []
    for i, e in enumerate(content):
        if not isinstance(e, dict) or not str(e.get("query") or "").strip():
            raise ValueError(f"example {i} has no query")
        positives = [str(p) for p in e.get("positive_documents") or []]
        if not positives:
            raise ValueError(f"example {i} has no positive documents")
        rows.append((i, str(e["query"]).strip(), positives, [str(n) for n in e.get("negative_documents") or []], json.dumps(e.get("metadata") or {})))
    return rows


def _yaml(text: str) -> Any:
    import yaml

    return yaml.safe_load(text)


def _json_lines(text: str) -> Any:
    return [json.loads(line) for line in text.splitlines() if line.strip()]


DATASETS: dict[str, Callable[[str], Any]] = {".yaml": _yaml, ".yml": _yaml, ".json": json.loads, ".jsonl": _json_lines}  # by extension: what parse_examples takes from the text of a file


def load_examples(spark: SparkSession, path: str) -> DataFrame:
    """A labelled dataset in a format that DATASETS knows."""
    suffix = "." + str(path).rpartition(".")[2].lower()
    if suffix not in DATASETS:
        raise ValueError(f"no dataset loader for {path}")
    return spark.createDataFrame(parse_examples(DATASETS[suffix](storage.read_text(spark, path))), EXAMPLES)


def load_parameters(spark: SparkSession, path: str) -> dict[str, Any]:
    """A mapping of dotted paths to lists or specifications, bare or under `parameters` or `search_space`."""
    import yaml

    found = yaml.safe_load(storage.read_text(spark, path))
    for name in ("parameters", "search_space"):
        if isinstance(found, dict) and isinstance(found.get(name), dict):
            found = found[name]
    if not isinstance(found, dict) or not found:
        raise ValueError(f"{path} must hold a mapping of settings to values")
    return found


class ExperimentStore:
    """Append-only JSON lines of experiment versions; readers see the latest version of each."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, str(directory).rstrip("/")

    def save(self, record: dict[str, Any]) -> None:
        """A new version in a file of its own: two writers never touch each other's."""
        version = time.time_ns()
        storage.write_text(self.spark, f"{self.directory}/{record['experiment_id']}.{version}-{uuid.uuid4().hex[:8]}.json", json.dumps(record | {"version": version}, default=str))

    def all(self) -> DataFrame:
        """The latest versions, newest first."""
        if not storage.names(self.spark, self.directory, ".json"):
            return self.spark.createDataFrame([], EXPERIMENT)
        rows = self.spark.read.schema(EXPERIMENT + ", version bigint").option("pathGlobFilter", "*.json").json(self.directory)
        last = rows.groupBy("experiment_id").agg(F.max_by(F.struct(*rows.columns), "version").alias("r")).select("r.*").drop("version")
        return last.orderBy(F.desc("timestamp"), "experiment_id")

    def get(self, experiment_id: str) -> dict[str, Any]:
        row = self.all().where(F.col("experiment_id") == experiment_id).first()
        if row is None:
            raise FileNotFoundError(f"no experiment {experiment_id}")
        return row.asDict()

    def export_index(self, path: str) -> None:
        export_json(self.all(), path)
