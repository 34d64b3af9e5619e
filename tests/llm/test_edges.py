"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankforge.llm import dac, knn, langid, licenses, mixing, neardup, packing, quality, secrets, sharding
from rankforge.llm.tokens import VOCABULARY, tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k1 bigint, k2 string, words string, bucket int, rid int, key string, n_tokens string, shard_id string, __row string, __k1 int, n int"
EN = "the state of the art in the theory of games and the practice of it is to be read with care by all that work on it as it was at the time "
FR = "le chat de la maison est sur le toit et il ne veut pas descendre avec les autres qui sont dans la rue pour une nuit "
LONG = "".join(f"{EN.split()[i % 20]}x{i % 7001} " for i in range(200_000))
SECRET = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'


def rows():
    base = [
        (1, EN * 3, "en", "a", 1), (2, EN * 3, "en", "a", None), (2, EN * 3, "en", "a", None), (3, FR * 3, "fr", "b", 3), (4, None, "en", "a", 0), (5, "", "en", "b", 0), (6, " \n\t ", None, None, None),
        (7, LONG, "en", "b", None), (None, FR * 4 + "fin", "fr", None, 5), (None, None, None, None, None), (9, "...!!! ???", "fr", "a", 10), (10, f"{EN} {SECRET} et\n{FR}\nReleased under the MIT License.", None, "b", None),
        (11, "Of.", "en", "a", 3), (-12, "日本語 текст", None, "", 9),
    ]
    return [r + (7, "x", "y", 1, 2, "k", "t", "s", "r", 3, 4) for r in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3, "n_chars").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_licenses(docs, none):
    assert [(r.doc_id, r.first_line, r.last_line, r.license) for r in licenses.scan(docs).collect() if r.license == "mit"] == [(10, 3, 3, "mit")]
    twice = docs.where("doc_id = 10").union(docs.where("doc_id = 10"))
    assert len([r for r in licenses.scan(twice).collect() if r.license == "mit"]) == 2
    tie = {"one": "Released under the MIT License.", "two": "License MIT, released under the"}
    assert sorted(r.license for r in licenses.scan(docs.where("doc_id = 10"), tie).collect()) == ["one", "two"]
    assert not licenses.scan(none).collect()


def test_language(docs, none):
    model = langid.fit(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows())
    assert sorted(str(r.doc_id) for r in got if r.distance is None) == sorted(["4", "5", "6", "None", "9"])  # without a word
    assert not any(r.accepted for r in got if r.distance is None)
    assert {r.language for r in got if r.doc_id in (1, 2)} == {"en"} and {r.language for r in got if r.doc_id == 3} == {"fr"}
    assert not langid.identify(none).collect() and not langid.accepted(none).collect()
    unlabelled = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(unlabelled) == len(rows()) and not any(r.accepted for r in unlabelled)


def test_codes(docs, none):
    got = dac.tokenized(docs).collect()
    assert len(got) == len(rows())
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (4, 5)} == {4: 0, 5: 0}
    bpe = tokenizer(VOCABULARY)
    long = next(r for r in got if r.doc_id == 7)
    assert bpe.decode(dac.Codes(bytes(long.codes)).all().tolist()) == LONG
    assert not dac.tokenized(none).collect()


def test_near_duplicates(docs, none):
    pairs = {(r.doc_id, r.duplicate_of) for r in neardup.duplicate_pairs(docs).collect()}
    assert pairs == {(2, 1), (None, 3)}  # the null id is last in its group
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 7, None, 9, 10, 11, -12])
    again = neardup.deduplicated(docs.where("doc_id = 2")).collect()
    assert [r.doc_id for r in again] == [2]  # a repeated row is a copy of itself
    assert not neardup.duplicate_pairs(none).collect() and not neardup.deduplicated(none).collect()


def test_packing(docs, none):
    got = packing.pack(docs, capacity=64).collect()
    assert sorted(str(r.doc_id) for r in got if r.bin_id is None) == sorted(["4", "5", "None"])
    held = Counter()
    for r in got:
        if r.bin_id is not None:
            held[r.bin_id] += r.n_tokens
    assert max(held.values()) <= 64
    assert len([r for r in got if r.doc_id == 2]) == 2 * len([r for r in got if r.doc_id == 1])  # both of the repeated rows
    assert not packing.pack(none).collect()


def test_topk(spark):
    schema = "vec_id bigint, embedding array<float>, row string, cell string, v int, id int"
    data = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (None, [0.0, 1.0]), (6, [None, 1.0]), (7, [])]
    vectors = spark.createDataFrame([d + ("r", "c", 1, 2) for d in data], schema)
    got = sorted((str(r.vec_id), r["rank"], str(r.neighbor_id), round(r.distance, 6)) for r in knn.knn_join(vectors, k=3).collect())
    assert [g for g in got if g[0] == "1"] == [("1", 1, "2", 1.0), ("1", 2, "2", 1.0), ("1", 3, "None", 1.0)]
    assert [g for g in got if g[0] == "None"] == [("None", 1, "2", 0.0), ("None", 2, "2", 0.0), ("None", 3, "1", 1.0)]
    assert {g[0] for g in got} == {"1", "2", "None"}
    assert not knn.knn_join(spark.createDataFrame([], schema)).collect()
    assert not knn.knn_join(vectors.where("vec_id = 1")).collect()


def test_secrets(docs, none):
    assert [(r.doc_id, r.rule, r.occurrence, r.secret_chars) for r in secrets.scan(docs).collect()] == [(10, "assigned_secret", 1, len(SECRET))]
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    got = {r.doc_id: r for r in clean.collect()}
    assert SECRET not in got[10].text and "[secret]" in got[10].text and got[10].n_chars == len(got[10].text)
    assert got[7].text == LONG and got[1].n_chars == 1 and got[4].text is None
    for kind, want in (("string", str(len(got[10].text))), ("double", float(len(got[10].text))), ("boolean", None)):
        assert secrets.redact(docs.withColumn("n_chars", F.lit(None).cast(kind))).where("doc_id = 10").first().n_chars == want
    twice = docs.where("doc_id = 10").union(docs.where("doc_id = 10")).union(docs.where("doc_id = 10").withColumn("doc_id", F.lit(None).cast("bigint")))
    assert sorted(str(r.doc_id) for r in secrets.scan(twice).collect()) == ["10", "10", "None"]
    assert not secrets.scan(none).collect() and not secrets.redact(none).collect()


def test_sharding(docs, none):
    out = sharding.sharded(docs, target=4000)
    assert out.columns == [c for c in docs.columns if c != "shard_id"] + ["shard_id"]
    got = out.collect()
    assert Counter(str(r.doc_id) for r in got) == Counter(str(r[0]) for r in rows())
    assert len({r.shard_id for r in got if r.doc_id == 2}) == 1
    assert not sharding.sharded(none).collect()
    named = docs.withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id")).drop("source")
    got = sharding.sharded(named, target=4000).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] if r[0] is None else f"doc-{r[0]}" for r in rows())
    assert [r.shard_id for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id))] == sorted(r.shard_id for r in got)


def test_quality(docs, none):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(quality.judge(docs).collect()) == len(rows())
    assert got[4].keep and got[4].char_distance is None and got[11].keep and got[1].word_distance is not None
    assert got[2].word_distance == got[1].word_distance  # ties and repeated rows
    assert quality.judge(docs.withColumn("keep", F.lit("x"))).columns == quality.judge(docs).columns
    assert not quality.judge(none).collect()


def test_mixing(docs, none):
    got = mixing.mix(docs, weights={"a": 1.0, "b": 1.0, "none": 1.0}, budget=400).collect()
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.n_tokens
    assert set(tokens) <= {"a", "b"} and max(tokens.values()) <= 200
    same = docs.where("doc_id = 2").union(docs.where("doc_id = 2")).cache()  # four equal rows, and a budget for one or three
    one = int(mixing.mix(same.limit(1), budget=10**9).first().n_tokens)
    for n in (1, 3):
        assert mixing.mix(same, budget=n * one + 1).count() == mixing.mixed(same, budget=n * one + 1).count() == n
    other = same.limit(1).union(same.limit(1).withColumn("source", F.lit("y")))  # rows equal in id and text, of which one source has a weight
    assert [r.source for r in mixing.mixed(other, weights={"a": 1.0}, budget=one).collect()] == ["a"]
    whole = mixing.mix(docs, budget=10**9).collect()
    assert Counter(r.doc_id for r in whole)[2] == 2  # repeated rows are chosen as separate documents
    assert not {4, 5} & {r.doc_id for r in whole}
    kept = mixing.mixed(docs, budget=10**9)
    assert kept.columns == docs.columns and Counter(str(r.doc_id) for r in kept.collect()) == Counter(str(r.doc_id) for r in whole)
    assert not mixing.mix(none).collect() and not mixing.mixed(none).collect()


def test_texts_beyond_a_piece(spark):
    """A text of several pieces gives what its words give, and beside it a short one as well."""
    long = "".join(f"{EN.split()[i % 20]}x{i % 7001}{' ,;'[i % 3]}" for i in range(700_000)) + " " + SECRET
    rows = [(1, long, "en", "a"), (2, long.replace(",", "  "), "en", "a"), (3, EN * 4, "en", "a"), (4, "y" * 3_000_000 + " of the " + "z" * 3_000_000, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert [(r.doc_id, r.duplicate_of) for r in neardup.duplicate_pairs(docs).collect()] == [(2, 1)]
    got = {r.doc_id: r.n_words for r in quality.judge(docs).collect()}
    assert got == {i: len(re.findall("[0-9a-z]+", t.lower())) for i, t, *_ in rows}
    assert sorted((r.doc_id, r.rule) for r in secrets.scan(docs).collect()) == [(1, "assigned_secret"), (2, "assigned_secret")]
    assert sum(r.n_tokens for r in packing.pack(docs).collect() if r.doc_id == 4) == len(tokenizer(VOCABULARY).encode_ordinary(rows[3][1]))


def test_many_rows_in_one_batch(spark):
    """More rows than a part may hold keep their signatures and meet their copies."""
    docs = spark.range(70_000).selectExpr("id as doc_id", "concat('word', id % 35000, ' and more') as text").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")
    try:
        assert neardup.duplicate_pairs(docs).count() == 35_000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_stages(spark, docs, none, tmp_path):
    for first in (docs, none):
        at = first
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, str(tmp_path))
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == first.columns, name
            path = f"{tmp_path}/{name}-{first is docs}"
            out.write.parquet(path)
            at = spark.read.parquet(path)
        json.dumps([r.asDict() for r in at.collect()])
