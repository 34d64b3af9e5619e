"""Ingestion to chunks, and a retriever over chunks that answers batches of queries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.config import Config
from rankforge.operators import bm25, chunking, dense, ranking
from rankforge.operators.preprocess import preprocess
from rankforge.sources import files, stores


class DocumentPipeline:
    """Files to documents to clean documents to chunks; every step is lazy."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config

    def ingest(self, path: str) -> DataFrame:
        return files.ingest_path(self.spark, path, self.config["ingestion.recursive"], self.config["ingestion.input_directory"], self.config["ingestion.supported_extensions"])

    def preprocess(self, documents: DataFrame) -> DataFrame:
        return preprocess(documents, self.config)

    def chunk(self, documents: DataFrame) -> DataFrame:
        return chunking.chunk_documents(documents, self.config)

    def process(self, path: str, output: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Clean documents and chunks of a path, stored as a corpus where an output is named."""
        documents = self.preprocess(self.ingest(path))
        chunks = self.chunk(documents)
        if output:
            stats = chunking.corpus_statistics(documents, chunks).first().asDict()
            stores.save_corpus(output, documents, chunks, {"device": self.config.resolved_device, "statistics": stats, "config": self.config.values})
            documents, chunks = stores.load_corpus(self.spark, output)
        return documents, chunks


class LexicalIndex:
    """BM25 over chunks."""

    def __init__(self, config: Config):
        self.config, self.index = config, None

    def build(self, chunks: DataFrame, embed: Callable[[DataFrame, str], DataFrame], vectors: DataFrame | None) -> None:
        self.index = bm25.build(chunks).cache()

    def share(self, built: LexicalIndex) -> None:
        self.index = built.index

    def save(self, path: str) -> None:
        self.index.save(f"{path}/bm25")

    def load(self, spark: SparkSession, path: str) -> None:
        self.index = bm25.Bm25Index.load(spark, f"{path}/bm25")

    def search(self, queries: DataFrame, k: int, embed: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        c = self.config["index.bm25"]
        return bm25.search(self.index, queries, k, c["k1"], c["b"])

    def tables(self) -> list[DataFrame]:
        return [getattr(self.index, t) for t in bm25.Bm25Index.TABLES] if self.index else []

    def settings(self) -> dict:
        return dict(self.config["index.bm25"])


class DenseIndex:
    """Vectors of chunks, searched exactly by inner product."""

    def __init__(self, config: Config):
        self.config, self.vectors = config, None

    def build(self, chunks: DataFrame, embed: Callable[[DataFrame, str], DataFrame], vectors: DataFrame | None) -> None:
        self.vectors = (vectors if vectors is not None else embed(chunks.select("chunk_id", "text"), "chunk_id")).cache()

    def share(self, built: DenseIndex) -> None:
        self.vectors = built.vectors

    def save(self, path: str) -> None:
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")

    def load(self, spark: SparkSession, path: str) -> None:
        self.vectors = spark.read.parquet(f"{path}/vectors")

    def search(self, queries: DataFrame, k: int, embed: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        return dense.search(self.vectors, embed(queries.select("query_id", F.col("query").alias("text")), "query_id"), k)

    def tables(self) -> list[DataFrame]:
        return [self.vectors] if self.vectors is not None else []

    def settings(self) -> dict:
        return {"metric": self.config["index.dense.metric"], "backend": dense.backend(self.config["embedding.backend"])}


class Expansion:
    """A query enhancer: the nearest terms of the corpus's vocabulary are added to the query."""

    def __init__(self, config: Config):
        self.config, self.terms = config["query_enhancement.expansion"], None

    def fit(self, chunks: DataFrame) -> None:
        self.terms = ranking.vocabulary(chunks, self.config["vocabulary_size"]).cache()

    def share(self, built: Expansion) -> None:
        self.terms = built.terms

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")

    def load(self, spark: SparkSession, path: str) -> None:
        self.terms = spark.read.parquet(f"{path}/terms")

    def enhance(self, queries: DataFrame, embed: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        """queries(query_id, query) with enhanced_query and expansion_terms."""
        term_vectors = embed(self.terms.select("term", F.col("term").alias("text")), "term")
        query_vectors = embed(queries.select("query_id", F.col("query").alias("text")), "query_id")
        return ranking.expand(queries, self.terms, term_vectors, query_vectors, self.config["max_expansion_terms"], self.config["similarity_threshold"])

    def tables(self) -> list[DataFrame]:
        return [self.terms] if self.terms is not None else []


# by name; what is added here can be named in a configuration. A retriever is a list of indexes, fused where there are several
INDEXES: dict[str, type] = {"bm25": LexicalIndex, "dense": DenseIndex}
RETRIEVERS: dict[str, tuple[str, ...]] = {"bm25": ("bm25",), "dense": ("dense",), "hybrid": ("bm25", "dense")}
ENHANCERS: dict[str, type] = {"expansion": Expansion}


class Retriever:
    """Indexes over chunks and the configured plan: enhance, retrieve, fuse, rerank by the original query."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config, self.chunks = spark, config, None
        self.indexes = {name: INDEXES[name](config) for name in RETRIEVERS[self.kind]}
        self.enhancers = {name: ENHANCERS[name](config) for name in config.methods}

    @property
    def kind(self) -> str:
        return self.config["retrieval.retriever"]

    @property
    def is_built(self) -> bool:
        return self.chunks is not None

    @property
    def embeds(self) -> bool:
        """Whether chunks have vectors."""
        return "dense" in self.indexes

    def configuration(self) -> dict:
        c = self.config
        out = {"retriever": self.kind, "top_k": c["retrieval.top_k"]}
        for index in self.indexes.values():
            out |= index.settings()
        return out | ({"rrf_k": c["retrieval.fusion.rrf_k"]} if len(self.indexes) > 1 else {})

    def embed(self, texts: DataFrame, key: str) -> DataFrame:
        return dense.embed(texts, key, self.config["embedding"])

    def build(self, chunks: DataFrame, vectors: DataFrame | None = None) -> Retriever:
        """Index a table of chunks; ids must be unique. The vocabulary of the expansion is part of the index."""
        chunks = stores.unique_ids(chunks)
        self.chunks = (chunks if "ordinal" in chunks.columns else stores.with_ordinal(chunks)).cache()
        for index in self.indexes.values():
            index.build(self.chunks, self.embed, vectors)
        for enhancer in self.enhancers.values():
            enhancer.fit(self.chunks)
        return self

    @property
    def shares(self) -> bool:
        """Whether all parts can take over what another retriever has built."""
        return all(hasattr(part, "share") for part in (*self.indexes.values(), *self.enhancers.values()))

    def share(self, built: Retriever) -> Retriever:
        """Take over what a retriever of the same parts and chunks has built; searches follow this one's configuration."""
        self.chunks = built.chunks
        for mine, theirs in ((self.indexes, built.indexes), (self.enhancers, built.enhancers)):
            for name, part in mine.items():
                part.share(theirs[name])
        return self

    def save(self, path: str) -> None:
        if not self.is_built:
            raise RuntimeError("build or load an index first")
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        for part in (*self.indexes.values(), *self.enhancers.values()):
            part.save(path)

    def load(self, path: str) -> Retriever:
        self.chunks = self.spark.read.parquet(f"{path}/chunks")
        for part in (*self.indexes.values(), *self.enhancers.values()):
            part.load(self.spark, path)
        return self

    def tables(self) -> list[DataFrame]:
        """All that the index keeps, but the chunks."""
        return [t for part in (*self.indexes.values(), *self.enhancers.values()) for t in part.tables()]

    def unpersist(self) -> None:
        for df in (*([self.chunks] if self.is_built else []), *self.tables()):
            df.unpersist()

    def enhance(self, queries: DataFrame) -> DataFrame:
        """queries(query_id, query) with enhanced_query and the methods in effect."""
        out = queries.withColumns({"enhanced_query": F.col("query"), "method": F.lit("+".join(self.config.methods) or None).cast("string")})
        for enhancer in self.enhancers.values():
            more = enhancer.enhance(out.select("query_id", F.col("enhanced_query").alias("query")), self.embed)
            out = out.drop("enhanced_query", "expansion_terms").join(more.select("query_id", "enhanced_query", "expansion_terms"), "query_id")
        return out

    def ranked(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, score, rank) of queries that are enhanced already."""
        pool = k if len(self.indexes) == 1 else ranking.POOL * k
        lists = [index.search(asked, pool, self.embed) for index in self.indexes.values()]
        fuse = ranking.FUSIONS[self.config["retrieval.fusion.strategy"]]
        out = lists[0] if len(lists) == 1 else fuse(lists, k, self.config["retrieval.fusion"])
        return out.select("query_id", "chunk_id", "score", "rank")

    def reranked(self, results: DataFrame, queries: DataFrame) -> DataFrame:
        return ranking.rerank(results, queries, self.chunks, self.config["reranking.top_n"], self.reranker())

    def retrieve(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank, retriever, reranked) for a table of queries; one query is a table of one row."""
        if not self.is_built:
            raise RuntimeError("build or load an index first")
        if top_k is not None and top_k <= 0:
            raise ValueError("top_k must be above zero")
        out = self.ranked(self.enhance(queries).select("query_id", F.col("enhanced_query").alias("query")), top_k or self.config["retrieval.top_k"])
        again = self.config["reranking.enabled"]
        if again:
            out = self.reranked(out, queries)
        return out.select("query_id", "chunk_id", "score", "rank", F.lit(self.kind).alias("retriever"), F.lit(again).alias("reranked"))

    def reranker(self) -> Callable:
        used = "lexical" if self.effective_reranker() == "lexical" else self.config["reranking.backend"]
        return ranking.RERANKERS["cross_encoder" if used == "auto" else used](self.config["reranking"])

    def effective_reranker(self) -> str:
        wanted = self.config["reranking.backend"]
        if wanted in ("auto", "cross_encoder") and dense.backend("auto") != "hashing":
            return self.config["reranking.model_name"]
        return "lexical" if wanted in ("auto", "cross_encoder") else wanted

    def responses(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """One row a query with its ranked chunks nested; texts join only what was ranked."""
        return self._nested(queries, self.retrieve(queries, top_k))

    def _nested(self, queries: DataFrame, results: DataFrame) -> DataFrame:
        ranked = results.join(self.chunks, "chunk_id")
        held = [c for c in ("chunk_id", "document_id", "title", "source", "text") if c in ranked.columns]
        nested = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", *held))).alias("results"))
        return queries.join(nested, "query_id", "left")

    def answer(self, query: str, top_k: int | None = None) -> dict:
        """One query's response with the milliseconds of its steps, each of which is run by itself."""
        if not self.is_built:
            raise RuntimeError("build or load an index first")
        if top_k is not None and top_k <= 0:
            raise ValueError("top_k must be above zero")
        start = time.perf_counter()
        took, again = {}, self.config["reranking.enabled"]

        def run(name: str, df: DataFrame) -> DataFrame:
            began = time.perf_counter()
            rows = df.collect()  # one query's
            took[name] = (time.perf_counter() - began) * 1000
            return self.spark.createDataFrame(rows, df.schema)

        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        enhanced = run("enhancement_latency_ms", self.enhance(asked)) if self.enhancers else self.enhance(asked)
        text = enhanced.first().enhanced_query
        out = run("retrieval_latency_ms", self.ranked(enhanced.select("query_id", F.col("enhanced_query").alias("query")), top_k or self.config["retrieval.top_k"]))
        if again:
            out = run("reranking_latency_ms", self.reranked(out, asked))
        row = self._nested(asked, out).first()
        times = {f"{n}_latency_ms": took.get(f"{n}_latency_ms", 0.0) for n in ("enhancement", "retrieval", "reranking")}
        return {
            "query": query, "enhanced_query": text if self.enhancers else None, "query_enhancement_method": "+".join(self.config.methods) or None, "retriever": self.kind, "reranked": again,
            "results": [r.asDict() for r in row.results or []], **times, "total_latency_ms": (time.perf_counter() - start) * 1000,
        }
