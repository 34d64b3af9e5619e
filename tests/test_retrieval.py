"""Retrieval, ranking and evaluation on the handbook and against plain Python."""

import math
from collections import Counter
from hashlib import blake2b

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.config import Config
from rankforge.operators import bm25, dense, evaluation, ranking
from rankforge.plans.retrieval import Retriever
from rankforge.sources import stores

TEXTS = ["Maternity leave policy offers sixteen weeks of paid leave.", "Remote work policy allows hybrid schedules.", "Travel reimbursement covers flights and hotels."]


@pytest.fixture(scope="module")
def handbook(spark):
    rows = [(f"doc-handbook:{i}", "doc-handbook", t, i, len(t.split()), "employee_handbook", "memory", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, stores.CHUNK + ", ordinal bigint").cache()


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def okapi(texts, query, k1=1.5, b=0.75):
    docs = [Counter(w.strip(".").lower() for w in t.split()) for t in texts]
    n, avgdl = len(docs), sum(sum(d.values()) for d in docs) / len(docs)
    df = Counter(w for d in docs for w in d)
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if v < 0 else v for w, v in raw.items()}
    return [sum(idf.get(w, 0) * d[w] * (k1 + 1) / (d[w] + k1 * (1 - b + b * sum(d.values()) / avgdl)) for w in query.lower().split()) for d in docs]


def test_bm25_numbers(spark, handbook):
    index = bm25.build(handbook)
    policy = index.terms.where("term = 'policy'").first()
    assert policy.df == 2 and policy.idf > 0  # the raw value is negative and is replaced
    for q in ("maternity leave policy", "leave leave work", "nothing known", "policy"):
        got = bm25.search(index, ask(spark, q), 3).orderBy("rank").collect()
        want = sorted(enumerate(okapi(TEXTS, q)), key=lambda s: -round(s[1], 9))
        assert [r.ordinal for r in got] == [i for i, _ in want]
        assert np.allclose([r.score for r in got], [s for _, s in want])


def test_bm25_padding_and_single_chunk(spark, handbook):
    got = bm25.search(bm25.build(handbook), ask(spark, "unknown words", "travel"), 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.ordinal, r.score > 0) for r in got] == [(0, 0, False), (0, 1, False), (1, 2, True), (1, 0, False)]
    one = bm25.search(bm25.build(handbook.where("ordinal = 0")), ask(spark, "leave"), 5).collect()
    assert len(one) == 1 and one[0].score < 0  # the floor is negative too
    with pytest.raises(ValueError):
        bm25.search(bm25.build(handbook), ask(spark, "x"), 0)


def test_bm25_grid_and_tables(spark, handbook, tmp_path):
    index = bm25.build(handbook).save(str(tmp_path / "index"))
    grid = spark.createDataFrame([(0, 0.8, 0.2), (1, 2.0, 0.9)], "config_id int, k1 double, b double")
    got = bm25.search(index, ask(spark, "leave policy"), 3, grid=grid)
    for i, k1, b in ((0, 0.8, 0.2), (1, 2.0, 0.9)):
        one = bm25.search(index, ask(spark, "leave policy"), 3, k1, b).orderBy("rank").collect()
        assert [(r.chunk_id, round(r.score, 9)) for r in got.where(f"config_id = {i}").orderBy("rank").collect()] == [(r.chunk_id, round(r.score, 9)) for r in one]


def test_hashing_embedding(spark, handbook):
    got = {r.chunk_id: r.vector for r in dense.hashing_embedding(handbook, "chunk_id", 32).collect()}
    for i, t in enumerate(TEXTS):
        v = np.zeros(32)
        for w in t.lower().replace(".", "").split():
            d = blake2b(w.encode(), digest_size=8).digest()
            v[int.from_bytes(d[:4], "little") % 32] += 1 if d[4] % 2 == 0 else -1
        assert np.allclose(got[f"doc-handbook:{i}"], v / (np.linalg.norm(v) or 1))
    empty = dense.hashing_embedding(spark.createDataFrame([(1, "")], "id int, text string"), "id", 8).first()
    assert empty.vector == [0.0] * 8


def test_dense_search_with_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (70, 4)).astype(float)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id int, vector array<double>")
    queries = vectors.withColumnRenamed("chunk_id", "query_id")
    for rows in (8, 1024):
        got = dense.search(vectors, queries, 7, rows=rows).orderBy("query_id", "rank").collect()
        s = x @ x.T
        want = [(q, int(i)) for q in range(70) for i in np.lexsort((np.arange(70), -s[q]))[:7]]
        assert [(r.query_id, r.chunk_id) for r in got] == want
    assert dense.search(vectors, queries.limit(1), 500).count() == 70


def test_fusion(spark):
    schema = "query_id int, chunk_id string, rank int"
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], schema)
    b = spark.createDataFrame([(0, "x", 1), (0, "z", 2)], schema)
    got = ranking.reciprocal_rank_fusion([a, b], 3).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 9)) for r in got] == [("x", round(2 / 61, 9)), ("y", round(1 / 62, 9)), ("z", round(1 / 62, 9))]


def test_rerank(spark, handbook):
    results = spark.createDataFrame([(0, f"doc-handbook:{i}", 1.0, i + 1) for i in range(3)], "query_id int, chunk_id string, score double, rank int")
    got = ranking.rerank(results, ask(spark, "travel flights policy"), handbook, 2).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got] == [("doc-handbook:2", round(2 / 3, 6)), ("doc-handbook:0", round(1 / 3, 6))]
    blank = ranking.rerank(results, ask(spark, "42"), handbook, 3).orderBy("rank").collect()
    assert [r.score for r in blank] == [0.0] * 3 and [r.chunk_id for r in blank] == [f"doc-handbook:{i}" for i in range(3)]


def test_expansion(spark, handbook):
    words = ranking.vocabulary(handbook, 5)
    assert [r.term for r in words.orderBy("place").collect()] == ["leave", "policy", "maternity", "offers", "sixteen"]
    terms = spark.createDataFrame([("leave", 1), ("holiday", 2), ("tax", 3)], "term string, place int")
    vectors = spark.createDataFrame([("leave", [1.0, 0.0]), ("holiday", [0.8, 0.6]), ("tax", [0.0, 1.0])], "term string, vector array<double>")
    asked = ask(spark, "leave days").withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    got = ranking.expand(ask(spark, "leave days"), terms, vectors, asked.select("query_id", "vector")).first()
    assert got.enhanced_query == "leave days holiday" and got.expansion_terms == ["holiday"]


def test_metrics(spark):
    flags = spark.createDataFrame([(0, 1, True), (0, 2, False), (0, 3, True)], "query_id int, rank int, relevant boolean")
    totals = spark.createDataFrame([(0, 2), (1, 1), (2, 0)], "query_id int, total int")
    got = {r.query_id: r for r in evaluation.query_metrics(flags, totals, 2).collect()}
    assert (got[0].precision_at_k, got[0].recall_at_k, got[0].reciprocal_rank) == (0.5, 0.5, 1.0) and abs(got[0].ndcg_at_k - 0.6131) < 1e-4
    assert got[1][1:] == (0.0, 0.0, 0.0, 0.0) and got[2][1:] == (0.0, 0.0, 0.0, 0.0)
    mean = evaluation.aggregate_metrics(evaluation.query_metrics(flags, totals, 2)).first()
    assert abs(mean.precision_at_k - 0.5 / 3) < 1e-12
    p = evaluation.latency_metrics(spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 10.0)], "ms double"), "ms").first()
    assert np.allclose(p, (4.25, 3.0, 9.1, 9.82))
    assert evaluation.latency_metrics(spark.createDataFrame([], "ms double"), "ms").first()[:] == (0.0, 0.0, 0.0, 0.0)


def test_relevance_first_hit_only(spark, handbook):
    names = evaluation.identifiers(handbook)
    results = spark.createDataFrame([(0, f"doc-handbook:{i}", i + 1) for i in range(3)], "query_id int, chunk_id string, rank int")
    labels = spark.createDataFrame([(0, 0, "memory"), (0, 1, "doc-handbook:2")], "query_id int, place int, label string")
    got = evaluation.relevance(results, labels, names).orderBy("rank").collect()
    assert [r.relevant for r in got] == [True, False, False]  # every chunk matches `memory` first
    with pytest.raises(ValueError):
        evaluation.check_alignment(spark.createDataFrame([(0, 0, "unknown_doc:99")], "query_id int, place int, label string"), names)


def test_split(spark):
    examples = ask(spark, "a", "b")
    train, test = evaluation.train_test_split(examples, 0.5, 7)
    assert train.count() == test.count() == 1
    train, test = evaluation.train_test_split(ask(spark, "a"))
    assert train.count() == 0 and test.count() == 1
    with pytest.raises(ValueError):
        evaluation.split_indices(3, 1.0)


def test_embedding_cache(spark, tmp_path):
    seen = []

    def encode(texts, key):
        seen.append(texts.count())
        return dense.hashing_embedding(texts, key, 8)

    cache = dense.EmbeddingCache(spark, str(tmp_path), "some/model", 8)
    texts = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alpha")], "id int, text string")
    first = {r.id: r.vector for r in cache.embed(texts, "id", encode).collect()}
    cache.embed(texts.union(spark.createDataFrame([(4, "gamma")], texts.schema)), "id", encode).collect()
    assert seen == [2, 1] and first[1] == first[3] and len(first) == 3


@pytest.mark.parametrize("kind", ["bm25", "dense", "hybrid"])
def test_retriever(spark, handbook, tmp_path, kind):
    c = Config({"retrieval": {"retriever": kind, "top_k": 2}, "embedding": {"backend": "hashing"}, "reranking": {"enabled": kind == "hybrid", "backend": "lexical"}, "query_enhancement": {"enabled": True, "method": "expansion"}})
    r = Retriever(spark, c)
    with pytest.raises(RuntimeError):
        r.retrieve(ask(spark, "x"))
    r.build(handbook)
    asked = ask(spark, "What is the maternity leave policy?", "Which policy mentions hybrid schedules?")
    got = r.retrieve(asked).where("rank = 1").orderBy("query_id").collect()
    assert [g.chunk_id for g in got] == ["doc-handbook:0", "doc-handbook:1"] and got[0].retriever == kind
    r.save(str(tmp_path / "index"))
    again = Retriever(spark, c).load(str(tmp_path / "index"))
    assert [x.results[0].chunk_id for x in again.responses(asked).orderBy("query_id").collect()] == ["doc-handbook:0", "doc-handbook:1"]
    with pytest.raises(ValueError):
        r.retrieve(asked, 0)
    with pytest.raises(ValueError):
        Retriever(spark, c).build(handbook.union(handbook))
    assert r.configuration()["retriever"] == kind
