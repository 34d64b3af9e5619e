"""Words, term counts and cleaning by Arrow's expressions."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from rankforge.functions import arrow
from rankforge.functions import text as T
from rankforge.operators import bm25


def test_words_of_pieces():
    texts = ["Straße, ΟΔΥΣΣΕΥΣ x1_y", None, "", "12 _", "the The THEẞ", "İa"]
    sizes, code, words = arrow.words(pa.array(texts))
    want = [[w.lower() for w in re.findall(r"(?:[^\W\d_]|(?<=i)̇)+", t or "")] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and [words[c].as_py() for c in code] == sum(want, [])


def test_terms_shuffle_only_their_counts(spark):
    rows = [(1, "aa Bb bb"), (2, "aa"), (2, "aa cc"), (3, None), (None, "aa dd"), (None, "dd"), (4, "")]
    docs = spark.createDataFrame(rows, "id bigint, text string")
    got = {r.term: (r.tf, r.df) for r in bm25.term_counts(docs, "id").collect()}
    assert got == {"aa": (4, 2), "bb": (2, 1), "cc": (1, 1), "dd": (2, 0)}  # as count(DISTINCT id), which counts no null
    once = bm25.term_counts(spark.range(50).select("id", F.lit("aa bb").alias("text")), "id")
    exchanges = [x for x in once._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert len(exchanges) == 1 and "term" in exchanges[0] and "id#" not in exchanges[0]


def test_cleaning_in_arrow(spark):
    rows = [("a \t b\t c", "a b c"), (" a\r\n\r\n  b \x85 c ", "a\n\nb\nc"), ("a . b", "a.b"), ("x @　y , z", "x@y, z"), ("1 - 2 - 3", "1-2 - 3"), ("http : / / a / b", "https://a/b"), ("\n \n", ""), (None, None)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    cleaned = docs.select("i", T.cleanup_whitespace("t").alias("c"))
    assert {r.i: r.c for r in cleaned.collect()} == {i: c for i, (_, c) in enumerate(rows)}
    assert "ArrowEvalPython" in cleaned._jdf.queryExecution().executedPlan().toString()
    broken = spark.range(1).select(F.unhex(F.lit("41FF2E2042")).cast("string").alias("t"))
    assert broken.select(T.cleanup_whitespace("t").alias("c")).first().c == "A�.B"
