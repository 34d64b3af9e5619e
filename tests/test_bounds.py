"""Work that stays where the rows lie, and pieces of batches that bound a worker's memory."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rankforge import queries
from rankforge.config import Config
from rankforge.functions import arrow
from rankforge.functions import text as T
from rankforge.functions.pages import remove_page_edges
from rankforge.operators import bm25, chunking, dense


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces():
    assert list(arrow.pieces(np.array([5, 5, 5, 40, 0, 1]), 10)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(arrow.pieces(np.zeros(5, int), 10, 2)) == [(0, 2), (2, 4), (4, 5)] and not list(arrow.pieces(np.zeros(0, int), 10))


def test_embeddings_of_chunks_shuffle_nothing(spark):
    texts = spark.createDataFrame([(i, f"word{i % 7} and more") for i in range(3000)] + [(9999, None)], "id int, text string")
    vectors = dense.embed(texts, "id", Config({"embedding": {"backend": "hashing", "cache_directory": None}})["embedding"])
    assert "Exchange" not in plan(vectors)
    assert vectors.count() == 3001 and sum(vectors.where("id = 9999").first().vector) == 0


def test_embeddings_add_up_the_rows_of_a_key(spark):
    texts = spark.createDataFrame([(1, "aa bb"), (2, "cc"), (1, "bb dd"), (None, "aa"), (None, "bb")], "id int, text string")
    whole = spark.createDataFrame([(1, "aa bb bb dd"), (2, "cc"), (None, "aa bb")], "id int, text string")
    got, want = ({r.id: r.vector for r in dense.hashing_embedding(d, "id", 16).collect()} for d in (texts, whole))
    assert got == want


def test_few_queries_shuffle_only_their_best(spark):
    vectors = spark.range(3000).select(F.col("id").alias("chunk_id"), F.array(F.sin("id"), F.cos("id")).alias("vector")).repartition(4).cache()
    found = dense.search(vectors, vectors.limit(5).select(F.col("chunk_id").alias("query_id"), "vector"), 3)
    assert "CartesianProduct" not in plan(found) and "NestedLoop" not in plan(found)
    assert found.count() == 15


def test_many_queries_in_cells(spark):
    v = spark.range(700).select(F.concat(F.lit("k"), "id").alias("chunk_id"), F.array(*[F.round(F.sin(F.col("id") * (i + 1)), 1).cast("double") for i in range(3)]).alias("vector")).cache()
    got = dense.search(v, v.select(F.col("chunk_id").alias("query_id"), "vector"), 4, exclude_self=True, rows=90)
    rows = v.collect()
    x, keys = np.array([r.vector for r in rows]), [r.chunk_id for r in rows]
    s = np.round(np.round(x @ x.T, 12), 9)
    want = {(keys[i], keys[j], n + 1) for i in range(700) for n, j in enumerate(sorted((j for j in range(700) if j != i), key=lambda j: (-s[i, j], keys[j]))[:4])}
    assert {(r.query_id, r.chunk_id, r.rank) for r in got.collect()} == want


def test_products_that_are_not_numbers_are_left_out():
    best = dense._Nearest(pa.array([1]), np.array([[1.0, 0.0]]), 2)
    best.add(pa.array([1, 2, 3, 4]), np.array([[np.nan, 0], [0.5, 0], [0.25, 0], [0.75, 0]]))
    assert best.cut()[2].tolist() == [4, 2]


def test_chunks_are_counted_in_pieces():
    tokens = pa.array([["a", "b", "a"]] * 3000 + [None, []], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3002)), pa.array(np.arange(3002)), tokens], names=["chunk_id", "ordinal", "tokens"])
    got = list(bm25._counted(iter([batch])))
    assert max(b.num_rows for b in got) <= arrow.ROWS and sum(b.num_rows for b in got) == 3002
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["chunk_id"] for r in rows] == list(range(3002)) and all(sorted(zip(r["terms"], r["tfs"])) == [("a", 2), ("b", 1)] for r in rows[:3000]) and not rows[3000]["terms"] and not rows[3001]["terms"]


def test_similarities_shuffle_nothing(spark, sf_dir):
    assert "Exchange" not in plan(queries.sentence_similarity(spark, sf_dir))


def test_similarities_in_pieces():
    bags = pa.array([[["a", "b"], ["a"], [], ["c"]], None, [], [["x"]], [["a", "b"], ["b", "a"]]] * 700, pa.list_(pa.list_(pa.string())))
    assert len(list(arrow.pieces(arrow.lengths(bags), chunking.TOKENS))) > 1
    got = chunking.neighbour_cosines.func(bags).to_pylist()
    assert len(got) == 3500 and all(np.allclose(a, b) for a, b in zip(got, [[0.5**0.5, 0, 0], [], [], [], [1]] * 700))


def test_texts_that_need_no_python_are_null_to_it(spark):
    rows = spark.createDataFrame([("plain",), ("ﬁ",), (None,), ("",)], "text string").repartition(1)
    for f, mark in ((T.normalize_unicode, "_nfkc"), (lambda t: remove_page_edges(F.col(t)), "edges")):
        nodes = [line for line in plan(rows.select(f("text").alias("t"))).splitlines() if "ArrowEvalPython" in line]
        assert nodes and all(f"{mark}(_groupingexpression" in n or f"{mark}(CASE WHEN" in n for n in nodes)
    assert [r.t for r in rows.select(T.normalize_unicode("text").alias("t")).collect()] == ["plain", "fi", None, ""]


def test_texts_mapped_in_pieces():
    texts = pa.array(["x" * (arrow.BYTES // 2 + 1), None, "é", "", "y" * (arrow.BYTES + 1)])
    assert arrow.mapped(texts, str.upper).to_pylist() == [t and t.upper() for t in texts.to_pylist()]
    assert arrow.mapped(texts.slice(1, 2), str.upper).to_pylist() == [None, "É"] and not len(arrow.mapped(texts.slice(0, 0), str.upper))


def test_products_in_single_precision_first():
    """The best are those of double precision, whatever single precision makes of near ties, large and infinite numbers."""
    rng = np.random.default_rng(5)
    d = rng.normal(size=(3000, 16))
    d[100:160] = d[7] * (1 + np.arange(60)[:, None] * 1e-10)  # closer than single precision can tell
    d[200:230] = d[9]
    for scale in (1.0, 1e6, 1e20):
        q, x = d[:50] * scale, d * scale
        best = dense._Nearest(pa.array(np.arange(50)), q, 40)
        assert (best.short is None) if scale > 1e15 else best.short.dtype == np.float32
        for a in range(0, 3000, 700):
            best.add(pa.array(np.arange(a, min(a + 700, 3000))), x[a : a + 700], 16)
        r, s, k = best.cut()
        exact = np.round(np.round(q @ x.T, 12), 9)
        assert len(r) == 50 * 40
        for i in range(50):
            if scale == 1.0:
                assert k[r == i].tolist() == sorted(range(3000), key=lambda j: (-exact[i, j], j))[:40]
            assert np.allclose(np.sort(s[r == i]), np.sort(exact[i])[-40:], rtol=1e-12)
    best = dense._Nearest(pa.array([1]), np.array([[1.0, 0.0]]), 1)
    best.add(pa.array(["a", "b"]), np.array([[np.inf, 0.5], [2.0, 0]]))
    assert best.cut()[0].tolist() == [0]


def test_equal_vectors_do_not_pile_up(monkeypatch):
    most, cut = [0], dense._Nearest.cut
    monkeypatch.setattr(dense._Nearest, "cut", lambda self: most.append(self.pending) or cut(self))
    best = dense._Nearest(pa.array(np.arange(2000)), np.ones((2000, 2)), 3)
    for keys in (np.arange(4096)[::-1] + 10, np.arange(4096)):
        best.add(pa.array(keys), np.ones((4096, 2)))
    r, s, k = best.cut()
    assert max(most) < 1 << 21
    assert k.tolist() == [0, 1, 2] * 2000 and (s == 2).all()


def test_vectors_are_normalised_where_products_are_taken(spark):
    v = spark.range(300).select(F.col("id").alias("chunk_id"), F.when(F.col("id") > 0, F.array(*[F.sin(F.col("id") * (i + 1)).cast("float") for i in range(3)])).alias("vector"))
    v = v.union(spark.sql("SELECT 300L, array(0f, 0f, 0f)")).cache()
    unit = v.select("chunk_id", dense.l2_normalize("vector").alias("vector"))
    for rows in (None, 64):
        got, want = (dense.search(d, d.withColumnRenamed("chunk_id", "query_id"), 4, exclude_self=True, rows=rows, **x) for d, x in ((v, {"normalize": True}), (unit, {})))
        assert "aggregate(" not in plan(got)
        assert [(r.query_id, r.chunk_id, round(r.score, 9)) for r in got.orderBy("query_id", "rank").collect()] == [(r.query_id, r.chunk_id, round(r.score, 9)) for r in want.orderBy("query_id", "rank").collect()]
