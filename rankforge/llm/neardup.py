"""Near duplicates by BagMinHash: weighted-Jaccard signatures, banding, exact multiset verification, components.

Two documents are near duplicates if the multisets of their word triples have a weighted Jaccard similarity of at
least `threshold`; groups are the connected components of the verified pairs that share a band.

Steps: (1) one Arrow pass gives each document two fingerprints of its words and its band keys; (2) documents with
equal words collapse to one representative, so that thousands of copies cost one; (3) representatives that share a
band form buckets; each member is compared with the bucket's least member (a star, linear in the bucket); (4) members
that the star leaves outside their center's component are compared with the bucket's members of other components as well, unless the
triangle inequality of the Jaccard distance already excludes a pair; (5) components give the groups. No bucket or
partner is capped, and a bucket is never gathered in one row: its members are rows of a table that is joined by bucket. Verification is a set intersection inside the JVM: the n-th occurrence of a triple is one element,
so that the intersection of the sets is the multiset overlap.

Cases: null and empty texts, and texts without any word, belong to no group. Texts of one or two words are one
shingle. Rows that repeat doc_id and text are copies of each other. Of a group the least doc_id stays (null last;
ties by a hash of the row). An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.bagminhash import band_keys, counted, shingles, signatures
from rankforge.llm.components import components
from rankforge.llm.shared import lean, narrow, pick, row_key, written
from rankforge.llm.textbytes import U, each_part, lowered, mix, rows_of

THRESHOLD, SHINGLE, BANDS, REGISTERS = 0.4, 3, 50, 4


def _sign(batches: Iterator[pa.RecordBatch], size: int, bands: int, per_band: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = lowered(batch.column("text"))
        for a, b, data, offsets in each_part(text):
            rows, hashes, whole = shingles(data, offsets, size)
            held = np.bincount(rows, minlength=b - a)
            sig = signatures(b - a, *counted(rows, hashes), bands * per_band)
            some = np.isfinite(sig[:, 0])
            keys = band_keys(sig, bands)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).slice(a, b - a) for c in ("doc_id", "k1", "k2")],
                    pa.array([w.tobytes() if s else None for w, s in zip(whole, some)], type=pa.binary()),
                    rows_of([k if s else k[:0] for k, s in zip(keys, some)], pa.int64()),
                    pa.array(held, pa.int64()),
                ],
                names=["doc_id", "k1", "k2", "words", "bands", "size"],
            )


def _elements(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The n-th occurrence of a shingle as one 64-bit element."""
    for batch in batches:
        text = lowered(batch.column("text"))
        for a, b, data, offsets in each_part(text):
            rows, hashes, _ = shingles(data, offsets, size)
            rows, hashes, weights = counted(rows, hashes)
            own = np.repeat(np.arange(len(rows)), weights)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(weights) - weights, weights)
            each = mix(hashes[own] + nth.astype(np.uint64) * U(0xD1342543DE82EF95)).view(np.int64)
            cut = np.searchsorted(rows[own], np.arange(1, b - a))
            yield pa.RecordBatch.from_arrays([batch.column("rid").slice(a, b - a), rows_of(np.split(each, cut), pa.int64())], names=["rid", "elements"])


def _similar(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """pairs(a, b) with their exact weighted Jaccard similarity. b comes first: it has few partners, while the rows of a frequent a are then large enough to be seen and split."""
    left = elements.select(F.col("rid").alias("a"), F.col("elements").alias("x"))
    right = elements.select(F.col("rid").alias("b"), F.col("elements").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("similarity"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, per_band: int = REGISTERS) -> DataFrame:
    """(doc_id, k1, k2, kept_id, kept_k1, kept_k2) of every document in a group, the kept one included; a written table."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = pick(docs, doc_id="doc_id", text="text").select("doc_id", "text", *row_key())
    signed = written(
        rows.mapInArrow(lean(lambda it: _sign(it, shingle, bands, per_band)), f"doc_id {kind}, k1 bigint, k2 int, words binary, bands array<bigint>, size bigint").where("words is not null"),
        "signed",
    )
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "k1", "k2")
    reps = written(
        signed.groupBy("words").agg(F.min(order).alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("size").alias("size")).withColumn("rid", F.monotonically_increasing_id()),
        "representatives",
    )
    members = _members(reps)
    needed = written(members.select("rid").distinct().join(reps.select("rid", "least.k1", "least.k2"), "rid"), "needed")
    texts = rows.drop("doc_id").join(narrow(needed), ["k1", "k2"]).dropDuplicates(["rid"]).select("rid", "text")
    elements = written(texts.mapInArrow(lean(lambda it: _elements(it, shingle)), "rid bigint, elements array<bigint>"), "elements")

    stars = members.where("rid <> center").select(F.col("center").alias("a"), F.col("rid").alias("b")).distinct()
    stars = written(_similar(stars, elements), "stars")
    found = stars.where(F.col("similarity") >= threshold).select("a", "b")
    groups = written(components(found), "groups")
    across = _across(members, stars, groups, threshold)
    more = written(_similar(across, elements), "across").where(F.col("similarity") >= threshold).select("a", "b")
    if not more.isEmpty():
        groups = written(components(found.union(more)), "groups")

    member = reps.join(groups.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    kept = member.groupBy("root").agg(F.min("least").alias("kept"), F.sum("copies").alias("rows")).where("rows > 1")
    member = member.select("words", "root").join(kept, "root").select("words", "kept")
    return written(
        signed.select("doc_id", "k1", "k2", "words").join(member, "words").select(
            "doc_id", "k1", "k2", F.col("kept.doc_id").alias("kept_id"), F.col("kept.k1").alias("kept_k1"), F.col("kept.k2").alias("kept_k2")
        ),
        "found",
    )


def _members(reps: DataFrame) -> DataFrame:
    """(band, center, rid, size): the buckets of more than one representative, each with its least one. Buckets of equal members count once."""
    banded = reps.select("rid", "size", F.explode("bands").alias("band"))
    held = banded.groupBy("band").agg(F.min("rid").alias("center"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("rid")).alias("all")).where("n > 1")
    once = written(held.groupBy("center", "n", "all").agg(F.min("band").alias("band")).select("band", "center"), "buckets")
    return written(banded.join(narrow(once), "band"), "members")


def _across(members: DataFrame, stars: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of bucket members in different components that the star's distances do not exclude: one is outside the center's component."""
    distance = stars.select(F.col("a").alias("center"), F.col("b").alias("rid"), (1 - F.col("similarity")).alias("distance"))
    root = groups.select(F.col("node").alias("rid"), "root")
    member = members.where("rid <> center").join(distance, ["center", "rid"]).join(root, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    main = groups.select(F.col("node").alias("center"), F.col("root").alias("main"))
    member = written(member.join(main, "center", "left").withColumn("main", F.coalesce("main", "center")), "placed")
    outside = member.where("root <> main").select("band", F.col("rid").alias("o"), F.col("root").alias("o_root"), F.col("distance").alias("o_distance"), F.col("size").alias("o_size"))
    near = member.join(outside, "band").where(
        # multisets whose sizes differ too much cannot overlap enough either
        f"o_root <> root and abs(o_distance - distance) <= {1 - threshold} + 1e-9 and least(size, o_size) + 1e-9 >= {threshold} * greatest(size, o_size)"
    )
    return near.select(F.least("o", "rid").alias("a"), F.greatest("o", "rid").alias("b")).distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti")


def duplicate_pairs(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, duplicate_of): every document that goes, with the one of its group that stays.

    A row that repeats doc_id and text of the one that stays is no document of its own and is not listed.
    """
    found = near_duplicates(docs, **options).where("k1 <> kept_k1 or k2 <> kept_k2")
    return found.select("doc_id", F.col("kept_id").alias("duplicate_of"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, with one row of each group; documents in no group all stay."""
    found = near_duplicates(docs, **options)
    # what goes, and what stays once though its row repeats; all other rows are read once and never shuffled
    named = found.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.first(F.expr("k1 = kept_k1 and k2 = kept_k2")).alias("kept"), F.count("*").alias("n"))
    special = written(named.where("not kept or n > 1"), "special")
    k1, k2 = row_key()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), k1.alias("__k1"), k2.alias("__k2"))
    stay = keyed.join(narrow(special.select("__k1", "__k2")), ["__k1", "__k2"], "left_anti").select("__row")
    again = special.where("kept").select("__k1", "__k2")
    if not again.isEmpty():
        stay = stay.union(keyed.join(narrow(again), ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]).select("__row"))
    return stay.select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
