"""Registered queries over the driver's tables and their DuckDB equivalents.

documents serve as documents and as chunks (doc_id is the order), benchmark as queries, embeddings as vectors with label as relevance
class, events as latency samples and, by type and day, as experiments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.config import Config
from rankforge.functions import text as T
from rankforge.operators import analysis, bm25, chunking, dense, evaluation, ranking

K, K1, B, RRF_K, TOP_N = 10, 1.5, 0.75, 60, 5
GRID = [(0, 0.8, 0.3), (1, 1.2, 0.75), (2, 1.5, 0.75), (3, 2.2, 0.95)]
SIZE, OVERLAP = 120, 20

_registry: dict[str, Callable] = {}
_oracle: dict[str, str] = {}


def register(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        _registry[f.__name__] = f
        if sql:
            _oracle[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("ordinal"), "text")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# -- SQL fragments. RE2 knows the same property classes; LINES drops the empty line after a final break, as lines() does.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKEN = rf"[\pL\pN_]+|[^\pL\pN_{WS[1:-1]}]"
WORD = r"[\pL\p{Nl}\p{No}]+"
BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _lines(x: str) -> str:
    parts = f"string_split_regex({x}, '{BREAK}')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[1:-2] ELSE {parts} END)"


def _words(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{WORD}'), lambda w: lower(w))"


def _clean(x: str) -> str:
    for pattern, new in ((r"[ \t]+", " "), (rf"{WS}+([.,;:!?])", r"\1"), (rf"{WS}*@{WS}*", "@"), (rf"{WS}*\.{WS}*", "."), (rf"https?{WS}*:{WS}*/{WS}*/", "https://"), (rf"{WS}*/{WS}*", "/"), (rf"(\p{{Nd}}){WS}*-{WS}*(\p{{Nd}})", r"\1-\2")):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return _strip(f"array_to_string(list_transform({_lines(x)}, lambda l: {_strip('l')}), chr(10))")


BM25_SQL = f"""
bags AS MATERIALIZED (SELECT doc_id, {_words("text")} AS words FROM documents),
len AS (SELECT doc_id, len(words) AS dl FROM bags),
corpus AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
post AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM bags) GROUP BY term, doc_id),
found AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term),
weights AS MATERIALIZED (SELECT term, df, ln((SELECT n FROM corpus) - df + 0.5e0) - ln(df + 0.5e0) AS w FROM found),
terms AS MATERIALIZED (SELECT term, df, CASE WHEN w < 0 THEN 0.25e0 * (SELECT avg(w) FROM weights) ELSE w END AS idf FROM weights),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_words("text")}) AS term FROM benchmark) GROUP BY query_id, term)"""
_PART = "times * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))"


def _ranked(k1: object, b: object, k: int, name: str) -> str:
    part = _PART.format(k1=f"{k1}e0", b=f"{b}e0")
    return f"""
{name}_s AS (SELECT query_id, doc_id, sum({part}) AS score FROM qt JOIN terms USING (term) JOIN post USING (term) JOIN len USING (doc_id), corpus GROUP BY query_id, doc_id),
{name}_a AS (SELECT q.item_id AS query_id, d.doc_id, coalesce(score, 0.0e0) AS score FROM benchmark q CROSS JOIN documents d LEFT JOIN {name}_s s ON s.query_id = q.item_id AND s.doc_id = d.doc_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {name}_a) WHERE rank <= {k})"""


def _index(spark: SparkSession, sf_dir: str) -> bm25.Bm25Index:
    """Kept by Spark, in memory or on disk, as its statistics and every search read it."""
    return bm25.build(chunks(spark, sf_dir)).cache()


def _bm25(spark: SparkSession, sf_dir: str, k: int = K, k1: float = K1, b: float = B) -> DataFrame:
    return bm25.search(_index(spark, sf_dir), benchmark(spark, sf_dir), k, k1, b)


# -- text

@register(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_words('text')}) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.term_counts(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")


@register(f"SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}'))::INTEGER AS n_tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.token_count("text").alias("n_tokens"))


@register(f"SELECT count(*) AS document_count, round(avg(len(regexp_extract_all(text, '{TOKEN}'))), 2) AS average_tokens, sum(len(regexp_extract_all(text, '{TOKEN}')))::BIGINT AS tokens FROM documents")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = documents(spark, sf_dir).select(T.token_count("text").cast("bigint").alias("n"))
    return n.agg(F.count("*").alias("document_count"), F.round(F.avg("n"), 2).alias("average_tokens"), F.sum("n").alias("tokens"))


@register(f"SELECT doc_id, sha256({_clean('text')}) AS cleaned FROM documents")
def clean_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.sha2(T.cleanup_whitespace("text"), 256).alias("cleaned"))


@register(
    f"SELECT doc_id, sha256(array_to_string(list_filter({_lines('text')}, lambda l: NOT regexp_matches(l, '(?i)^{WS}*(?:page{WS}+)?\\p{{Nd}}+(?:{WS}+of{WS}+\\p{{Nd}}+)?{WS}*$')), chr(10))) AS cleaned FROM documents"
)
def page_numbers_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.sha2(T.remove_page_numbers("text"), 256).alias("cleaned"))


@register(f"SELECT doc_id, sha256({_strip(chr(114) + 'egexp_replace(text, ' + repr(chr(92) + 'n{3,}') .replace(chr(92) * 2, chr(92)) + ', chr(10) || chr(10), ' + repr('g') + ')')}) AS cleaned FROM documents")
def blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.sha2(T.remove_empty_lines("text"), 256).alias("cleaned"))


@register("SELECT doc_id, substr(sha256(source || '::' || text), 1, 16) AS document_id FROM documents")
def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.document_id("source", "text").alias("document_id"))


@register(f"SELECT doc_id, substr({_strip('replace(replace(text, chr(10), chr(32)), chr(32) || chr(32), chr(32))')}, 1, 160) AS preview FROM documents")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.preview("text").alias("preview"))


# -- chunks

def _config(strategy: str) -> Config:
    return Config({"chunking": {"strategy": strategy, "chunk_size": SIZE, "overlap": OVERLAP}})


def _chunked(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "text")
    return chunking.chunk_documents(docs, _config(strategy))


@register(f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS tokens FROM documents),
s AS (SELECT doc_id, tokens, unnest(range(0, len(tokens), {SIZE - OVERLAP})) AS start FROM t),
f AS (SELECT *, min(CASE WHEN start > 0 AND len(tokens) - start < {max(15, SIZE // 3)} THEN start END) OVER (PARTITION BY doc_id) AS short FROM s),
k AS (SELECT *, max(start) OVER (PARTITION BY doc_id) AS last FROM f WHERE short IS NULL OR start < short),
c AS (SELECT doc_id, start, CASE WHEN short IS NOT NULL AND start = last THEN list_concat(tokens[start + 1:start + {SIZE}], tokens[short + 1:short + {SIZE}]) ELSE tokens[start + 1:start + {SIZE}] END AS own FROM k)
SELECT doc_id || ':' || (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1) AS chunk_id, len(own)::INTEGER AS token_count, sha256(array_to_string(own, ' ')) AS text_hash FROM c""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir, "fixed").select("chunk_id", "token_count", F.sha2("text", 256).alias("text_hash"))


@register(f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') AS ss FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS sentence FROM s),
w AS (SELECT doc_id, i, lower(t) AS term, count(*) AS n FROM (SELECT doc_id, i, unnest(regexp_extract_all(sentence, '{TOKEN}')) AS t FROM e) WHERE regexp_full_match(t, '[\\pL\\pN]+') GROUP BY ALL),
norms AS (SELECT doc_id, i, sqrt(sum(n * n)) AS norm FROM w GROUP BY doc_id, i),
dots AS (SELECT a.doc_id, a.i, sum(a.n * b.n) AS dot FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND a.term = b.term GROUP BY a.doc_id, a.i)
SELECT a.doc_id, a.i::INTEGER AS sentence, round(coalesce(dot / (x.norm * y.norm), 0.0), 6) AS similarity
FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.i = a.i + 1 LEFT JOIN dots d ON d.doc_id = a.doc_id AND d.i = a.i
LEFT JOIN norms x ON x.doc_id = a.doc_id AND x.i = a.i LEFT JOIN norms y ON y.doc_id = a.doc_id AND y.i = a.i + 1""")
def sentence_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the word counts of neighbouring sentences, where the text lies; nothing is shuffled."""
    near = documents(spark, sf_dir).select("doc_id", T.sentences("text").alias("s")).select("doc_id", chunking.similarities(F.col("s")).alias("near"))
    return near.select("doc_id", F.posexplode("near").alias("i", "x")).select("doc_id", (F.col("i") + 1).alias("sentence"), F.round("x", 6).alias("similarity"))


# -- lexical retrieval

@register(f"WITH {BM25_SQL} SELECT term, df, round(idf, 9) AS idf FROM terms")
def bm25_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.build(chunks(spark, sf_dir)).terms.select("term", "df", F.round("idf", 9).alias("idf"))


@register(f"WITH {BM25_SQL}, {_ranked(K1, B, K, 'r')} SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM r")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@register(
    f"WITH {BM25_SQL}, " + ", ".join(_ranked(k1, b, K, f"g{i}") for i, k1, b in GRID) + " "
    + " UNION ALL ".join(f"SELECT {i} AS config_id, query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM g{i}" for i, _, _ in GRID)
)
def bm25_param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame(GRID, "config_id int, k1 double, b double")
    out = bm25.search(_index(spark, sf_dir), benchmark(spark, sf_dir), K, grid=grid)
    return out.select("config_id", "query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


FUSED_SQL = f"""{BM25_SQL}, {_ranked(K1, B, 3 * K, 'a')}, {_ranked(0.8, 0.3, 3 * K, 'b')},
u AS (SELECT query_id, doc_id, 1.0e0 / ({RRF_K} + rank) AS s, 0 AS list, rank FROM a UNION ALL SELECT query_id, doc_id, 1.0e0 / ({RRF_K} + rank), 1, rank FROM b),
g AS (SELECT query_id, doc_id, sum(s) AS score, min(list * 1000000 + rank) AS first FROM u GROUP BY query_id, doc_id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, doc_id) AS rank FROM g) WHERE rank <= {K})"""


@register(f"WITH {FUSED_SQL} SELECT query_id, doc_id, round(score, 9) AS score, rank::INTEGER AS rank FROM fused")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lexical lists of unlike parameters, since SQL has no hashed embeddings; the fusion is the hybrid's own."""
    index, asked = _index(spark, sf_dir), benchmark(spark, sf_dir)
    lists = [bm25.search(index, asked, ranking.POOL * K, k1, b) for k1, b in ((K1, B), (0.8, 0.3))]
    return ranking.reciprocal_rank_fusion(lists, K, RRF_K).select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 9).alias("score"), "rank")


@register(f"""WITH {BM25_SQL}, {_ranked(K1, B, K, 'r')},
x AS (SELECT r.query_id, r.doc_id, r.rank AS before, list_distinct({_words('q.text')}) AS qw, list_distinct({_words('d.text')}) AS dw FROM r JOIN benchmark q ON q.item_id = r.query_id JOIN documents d USING (doc_id)),
s AS (SELECT query_id, doc_id, before, CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, dw))::DOUBLE / len(qw) ELSE 0.0 END AS score FROM x)
SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, before) AS rank FROM s) WHERE rank <= {TOP_N}""")
def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.rerank(_bm25(spark, sf_dir), benchmark(spark, sf_dir), chunks(spark, sf_dir), TOP_N)
    return out.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


# -- dense retrieval

def _vectors(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(key), dense.l2_normalize("embedding").alias("vector"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = lambda key: table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(key), F.col("embedding").alias("vector"))
    return dense.search(vectors("chunk_id"), vectors("query_id"), K, exclude_self=True, normalize=True)


DENSE_SQL = f"""v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / CASE WHEN list_dot_product(e, e) = 0 THEN 1 ELSE sqrt(list_dot_product(e, e)) END) AS e FROM v),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, a.label = b.label AS relevant, list_dot_product(a.e, b.e) AS score FROM u a, u b WHERE a.vec_id <> b.vec_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM p) WHERE rank <= {K})"""
_IDCG = "list_sum(list_transform(range(1, least({n}, {k}) + 1), lambda i: 1 / log2(i + 1)))"


@register(f"WITH {DENSE_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM top")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _rounded(metrics: DataFrame) -> DataFrame:
    return metrics.select(*[F.round(c, 9).alias(c) for c in metrics.columns])


@register(f"""WITH {DENSE_SQL},
n AS (SELECT label, count(*) - 1 AS total FROM v GROUP BY label),
m AS (SELECT v.vec_id, total, count(*) FILTER (relevant) AS hits, min(rank) FILTER (relevant) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (relevant), 0) AS dcg FROM v JOIN n USING (label) LEFT JOIN top ON query_id = vec_id GROUP BY v.vec_id, total)
SELECT round(avg(hits / {K}.0e0), 9) AS precision_at_k, round(avg(CASE WHEN total > 0 THEN hits / total::DOUBLE ELSE 0 END), 9) AS recall_at_k, round(avg(coalesce(1 / first::DOUBLE, 0)), 9) AS mean_reciprocal_rank,
round(avg(CASE WHEN total > 0 THEN dcg / {_IDCG.format(n="total", k=K)} ELSE 0 END), 9) AS ndcg_at_k FROM m""")
def dense_knn_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    totals = label.join(label.groupBy("label").agg((F.count("*") - 1).alias("total")), "label").select(F.col("vec_id").alias("query_id"), "total", F.col("label").alias("ql"))
    flags = _dense(spark, sf_dir).join(totals.select("query_id", "ql"), "query_id").join(label.withColumnRenamed("vec_id", "chunk_id"), "chunk_id").withColumn("relevant", F.col("ql") == F.col("label"))
    return _rounded(evaluation.aggregate_metrics(evaluation.query_metrics(flags, totals, K)))


@register("SELECT sha256('model::' || text) AS key FROM documents WHERE text NOT IN (SELECT text FROM benchmark UNION ALL SELECT d.text FROM documents d JOIN labels l USING (doc_id)) GROUP BY text")
def embedding_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache that holds the labelled documents and the benchmark passages would have to encode."""
    held = documents(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("text").union(table(spark, sf_dir, "benchmark").select("text"))
    keyed = lambda d: d.select(T.cache_key("model", "text").alias("key"), "text")
    return dense.misses(keyed(documents(spark, sf_dir)), keyed(held)).select("key")


# -- evaluation: a document is relevant to a benchmark passage if it holds the passage

def _labels(spark: SparkSession, sf_dir: str, index: bm25.Bm25Index) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    pairs = evaluation.containing(benchmark(spark, sf_dir), docs, index.postings, index.terms).cache()
    return pairs.select("query_id", F.col("chunk_id").cast("string").alias("label"), F.col("chunk_id").alias("place"))


LABEL_SQL = "labelled AS (SELECT b.item_id AS query_id, d.doc_id, d.doc_id::VARCHAR AS label FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _flags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ranked chunks with their relevance, and the labels."""
    index = _index(spark, sf_dir)
    labels = _labels(spark, sf_dir, index)
    named = evaluation.identifiers(documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text", "source"))
    return evaluation.relevance(bm25.search(index, benchmark(spark, sf_dir), K, K1, B), labels, named), labels


@register(f"WITH {BM25_SQL}, {_ranked(K1, B, K, 'r')}, {LABEL_SQL} SELECT r.query_id, r.doc_id, r.rank::INTEGER AS rank, l.label IS NOT NULL AS relevant FROM r LEFT JOIN labelled l ON l.query_id = r.query_id AND l.doc_id = r.doc_id")
def first_hit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir)[0].select("query_id", F.col("chunk_id").alias("doc_id"), "rank", "relevant")


@register(f"""WITH {BM25_SQL}, {_ranked(K1, B, K, 'r')}, {LABEL_SQL},
n AS (SELECT query_id, count(*) AS total FROM labelled GROUP BY query_id),
h AS (SELECT r.query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM r JOIN labelled l ON l.query_id = r.query_id AND l.doc_id = r.doc_id GROUP BY r.query_id)
SELECT round(avg(coalesce(hits, 0) / {K}.0e0), 9) AS precision_at_k, round(avg(coalesce(hits, 0) / total::DOUBLE), 9) AS recall_at_k, round(avg(coalesce(1 / first::DOUBLE, 0)), 9) AS mean_reciprocal_rank,
round(avg(coalesce(dcg, 0) / {_IDCG.format(n="total", k=K)}), 9) AS ndcg_at_k FROM n LEFT JOIN h USING (query_id)""")
def precision_recall_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags, labels = _flags(spark, sf_dir)
    totals = labels.groupBy("query_id").agg(F.count("*").alias("total"))
    return _rounded(evaluation.aggregate_metrics(evaluation.query_metrics(flags, totals, K)))


@register("SELECT count(*) AS labels, count(*) FILTER (t IS NOT NULL) AS matched FROM (SELECT DISTINCT text AS label FROM benchmark UNION SELECT doc_id::VARCHAR FROM labels) LEFT JOIN (SELECT text AS t FROM documents UNION SELECT doc_id::VARCHAR FROM documents UNION SELECT source FROM documents) ON t = label")
def qrels_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "benchmark").select(F.col("text").alias("label")).union(table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string")))
    names = evaluation.identifiers(documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text", "source"))
    return evaluation.alignment(labels, names)


@register("SELECT event_type, round(avg(value), 6) AS average_latency_ms, round(quantile_cont(value, 0.5), 6) AS p50_latency_ms, round(quantile_cont(value, 0.95), 6) AS p95_latency_ms, round(quantile_cont(value, 0.99), 6) AS p99_latency_ms FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.latency_metrics(table(spark, sf_dir, "events"), "value", ["event_type"])
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


# -- experiments: one a day and event type

EXPERIMENT_SQL = """ev AS (SELECT *, event_type || '-' || strftime(ts, '%Y%m%d') AS experiment_id FROM events),
ends AS (SELECT max(abs(value)) AS top FROM events),
ex AS (SELECT experiment_id, any_value(event_type) AS retriever, max(ts) AS timestamp, strftime(any_value(ts), '%w') AS chunking_strategy,
 CASE WHEN count(*) > 12 THEN 'expansion' ELSE 'none' END AS query_enhancement, CASE WHEN count(DISTINCT user_id) = count(*) THEN 'lexical' ELSE 'none' END AS reranker, 'hashing' AS embedding_model,
 avg(abs(value)) / any_value(top) AS precision_at_k, max(abs(value)) / any_value(top) AS recall_at_k, min(abs(value)) / any_value(top) AS mean_reciprocal_rank, avg(abs(value)) / any_value(top) / 2 AS ndcg_at_k,
 avg(abs(value)) AS average_latency_ms, quantile_cont(abs(value), 0.95) AS p95_latency_ms, quantile_cont(abs(value), 0.99) AS p99_latency_ms,
 count(*)::DOUBLE AS embedding_time_ms, count(DISTINCT user_id)::DOUBLE AS index_build_time_ms FROM ev, ends GROUP BY experiment_id)"""
SCORE_SQL = """lim AS (SELECT min(average_latency_ms) AS la, max(average_latency_ms) AS ha, min(embedding_time_ms) AS le, max(embedding_time_ms) AS he, min(index_build_time_ms) AS li, max(index_build_time_ms) AS hi FROM ex),
sc AS (SELECT ex.*, 0.65e0 * (mean_reciprocal_rank + ndcg_at_k + recall_at_k + precision_at_k) / 4 + 0.2e0 * (1 - CASE WHEN ha > la THEN (average_latency_ms - la) / (ha - la) ELSE 0 END)
 + 0.075e0 * (1 - CASE WHEN he > le THEN (embedding_time_ms - le) / (he - le) ELSE 0 END) + 0.075e0 * (1 - CASE WHEN hi > li THEN (index_build_time_ms - li) / (hi - li) ELSE 0 END) AS overall_score FROM ex, lim)"""


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.abs("value")
    ev = table(spark, sf_dir, "events").withColumn("experiment_id", F.concat_ws("-", "event_type", F.date_format("ts", "yyyyMMdd")))
    users = F.count_distinct("user_id")
    g = ev.crossJoin(table(spark, sf_dir, "events").agg(F.max(v).alias("top"))).groupBy("experiment_id").agg(
        F.first("event_type").alias("retriever"), F.max("ts").alias("timestamp"), (F.dayofweek(F.first("ts")) - 1).cast("string").alias("chunking_strategy"),
        F.count("*").cast("double").alias("embedding_time_ms"), users.cast("double").alias("index_build_time_ms"), F.avg(v).alias("mean"), F.max(v).alias("most"), F.min(v).alias("least"), F.first("top").alias("top"),
        F.percentile(v, F.array(F.lit(0.95), F.lit(0.99))).alias("p"),
    )
    share = lambda c: F.col(c) / F.col("top")
    return g.select(
        "experiment_id", "retriever", "timestamp", "chunking_strategy", F.when(F.col("embedding_time_ms") > 12, "expansion").otherwise("none").alias("query_enhancement"),
        F.when(F.col("index_build_time_ms") == F.col("embedding_time_ms"), "lexical").otherwise("none").alias("reranker"), F.lit("hashing").alias("embedding_model"),
        share("mean").alias("precision_at_k"), share("most").alias("recall_at_k"), share("least").alias("mean_reciprocal_rank"), (F.col("mean") / F.col("top") / 2).alias("ndcg_at_k"),
        F.col("mean").alias("average_latency_ms"), F.element_at("p", 1).alias("p95_latency_ms"), F.element_at("p", 2).alias("p99_latency_ms"), "embedding_time_ms", "index_build_time_ms",
    )


@register(f"WITH {EXPERIMENT_SQL}, {SCORE_SQL} SELECT experiment_id, round(overall_score, 9) AS overall_score FROM sc")
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.scored(experiments(spark, sf_dir)).select("experiment_id", F.round("overall_score", 9).alias("overall_score"))


@register(
    f"WITH {EXPERIMENT_SQL}, {SCORE_SQL} " + " UNION ALL ".join(
        f"SELECT '{m}' AS sort_by, experiment_id, row_number() OVER (ORDER BY round({c}, 12) {'ASC' if up else 'DESC'}, timestamp DESC, experiment_id)::INTEGER AS rank FROM sc" for m, (c, up) in analysis.METRICS.items()
    )
)
def leaderboard_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = analysis.scored(experiments(spark, sf_dir)).cache()
    boards = [analysis.leaderboard(scored, m).select(F.lit(m).alias("sort_by"), "experiment_id", "rank") for m in analysis.METRICS]
    out = boards[0]
    for b in boards[1:]:
        out = out.union(b)
    return out


@register(f"""WITH {EXPERIMENT_SQL}, {SCORE_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY round(overall_score, 12) DESC, timestamp DESC, experiment_id) AS place FROM sc)
SELECT max(experiment_id) FILTER (place = 1) AS experiment_id, string_agg(experiment_id, ',' ORDER BY place) FILTER (place IN (2, 3)) AS alternatives, round(max(overall_score) FILTER (place = 1), 9) AS overall_score,
max(chunking_strategy || ' chunking + ' || embedding_model || ' + ' || retriever || ' + ' || query_enhancement || ' + ' || reranker) FILTER (place = 1) AS pipeline FROM o""")
def recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = analysis.recommendation(analysis.scored(experiments(spark, sf_dir)))
    return r.select("experiment_id", F.array_join("alternative_configurations", ",").alias("alternatives"), F.round("overall_score", 9).alias("overall_score"), F.col("recommended_pipeline").alias("pipeline"))


@register(f"""WITH {EXPERIMENT_SQL}, long AS ({' UNION ALL '.join(f"SELECT '{label}' AS component, {c} AS value, recall_at_k, p95_latency_ms, timestamp FROM ex" for c, label in analysis.COMPONENTS.items())}),
g AS (SELECT component, value, round(avg(recall_at_k), 9) AS recall, round(avg(p95_latency_ms), 9) AS latency, max(timestamp) AS seen FROM long GROUP BY component, value),
n AS (SELECT *, count(*) OVER (PARTITION BY component) AS c, row_number() OVER (PARTITION BY component ORDER BY recall DESC, seen DESC, value DESC) AS q, row_number() OVER (PARTITION BY component ORDER BY latency, value) AS l FROM g)
SELECT component, max(value) FILTER (q = 1) AS best_quality, round(max(recall) FILTER (q = 1), 6) AS quality, max(value) FILTER (l = 1) AS best_latency, round(max(latency) FILTER (l = 1), 6) AS latency FROM n WHERE c > 1 GROUP BY component""")
def tradeoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = analysis.tradeoffs(experiments(spark, sf_dir))
    return t.select("component", "best_quality", F.round("quality", 6).alias("quality"), "best_latency", F.round("latency", 6).alias("latency"))


def queries() -> dict[str, Callable]:
    from rankforge import operator_queries  # noqa: F401, registers its own

    return dict(_registry)


def oracle_sql() -> dict[str, str]:
    from rankforge import operator_queries  # noqa: F401, registers its own

    return dict(_oracle)
