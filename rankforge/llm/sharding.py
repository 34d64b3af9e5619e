"""Sharding by sampled splitters: range partitions of (source, doc_id) with about equal bytes.

(1) A seeded sample draws each record with probability proportional to its bytes; (2) the sample's quantiles are the splitters of at
most `splitters` coarse ranges; (3) the bytes of every range are counted exactly, and ranges over `slack` times the
target are subdivided into segments where their running sum of bytes passes a multiple of the target, each range in its own
task; (4) every record goes to the segment of its key, and each shard is one partition, so that a file is one shard.

The driver holds the bounded sample (PER_SPLITTER keys a splitter) and two numbers for each coarse range; segments stay a table, which is broadcast
behind a check of its size. Keys are bytes that sort like (source, doc_id, row hash), nulls first; the row hash lets records that share both be divided.
Rows that repeat doc_id, source and text have one key: if together they exceed the slack, they take several shards in turn.

Cases: null sources and ids sort first, and a table without a source column has null sources. Ids of whole-number types sort by number, all others as
strings. Null texts have no bytes and go where their key falls. A single record larger than the target is a shard of its own size. An empty table gives an
empty result. All columns are returned, with shard_id (an input column of that name is replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from rankforge.llm.shared import BROADCAST_ROWS, seeded, written

TARGET_BYTES, SPLITTERS, PER_SPLITTER, SLACK, SEED = 32 << 20, 1 << 15, 16, 1.2, 43


def _or_null(value: Column, form: Column) -> Column:
    return F.when(value.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), form))


def _string(value: Column) -> Column:
    """The bytes of a string with a zero at the end; zeros inside are escaped, so that no key is the beginning of another."""
    return F.concat(F.encode(F.replace(value, F.lit("\x00"), F.lit("\x00\xff")), "UTF-8"), F.unhex(F.lit("00")))


def sort_key(docs: DataFrame) -> Column:
    """Binary that sorts like (source, doc_id, row hash), nulls first."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    ident = F.col("doc_id")
    if isinstance(docs.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType)):
        # the sign bit is flipped so that negative ids sort before the others
        form = F.unhex(F.lpad(F.hex(ident.cast("bigint").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    else:
        form = _string(ident.cast("string"))
    return F.concat(_or_null(source, _string(source)), _or_null(ident, form), F.unhex(F.lpad(F.hex(F.xxhash64(ident, source, F.col("text"))), 16, "0")))


def range_of(key: Column, splitters: list[bytes]) -> Column:
    """The number of splitters that are not after the key."""
    sorted_keys = np.array(splitters, dtype="S")

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(sorted_keys, np.array(keys.to_pylist(), dtype="S"), side="right").astype(np.int32))

    return place(key) if splitters else F.lit(0)


def coarse_splitters(slim: DataFrame, target: int, most: int, seed: int) -> list[bytes]:
    """Quantiles of a size-weighted sample of slim(key, bytes): the first keys of all coarse ranges but the first."""
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    ranges = min(most, -(-total // target))
    if ranges < 2:
        return []
    draws = ranges * PER_SPLITTER
    u = (F.pmod(seeded(seed, "key"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    drawn = sorted((bytes(r.key), max(r.bytes, total / draws)) for r in slim.where(u < F.least(F.lit(1.0), F.col("bytes") * (draws / total))).collect())
    if not drawn:
        return []
    held = np.cumsum([w for _, w in drawn])
    return sorted({drawn[i][0] for i in np.searchsorted(held, held[-1] * np.arange(1, ranges) / ranges)})


def _segments(placed: DataFrame, target: int, slack: float) -> DataFrame:
    """(range, segments): of each overfull range its segments in order, each with its first key, its first shard within the range and its shards."""
    full = placed.groupBy("range").agg(F.sum("bytes").alias("held")).where(F.col("held") > slack * target)
    keys = placed.join(F.broadcast(full), "range").groupBy("range", "key").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), F.first("held").alias("held"))
    up = Window.partitionBy("range").orderBy("key")
    alone = (F.col("rows") > 1) & (F.col("bytes") > slack * target)
    part = F.floor((F.sum("bytes").over(up) - F.col("bytes")) * F.ceil(F.col("held") / target) / F.col("held"))
    # a repeated row beyond the slack stands alone: what is before, itself and what is after it are three segments
    marked = keys.withColumns({"part": part, "wide": F.when(alone, F.ceil(F.col("bytes") / target)).otherwise(1)}).withColumn("wides", F.count_if(F.col("wide") > 1).over(up))
    cut = marked.groupBy("range", "part", "wides", F.col("wide") > 1).agg(F.min("key").alias("key"), F.max("wide").cast("int").alias("shards"))
    placed_cut = cut.withColumn("first", (F.sum("shards").over(up) - F.col("shards")).cast("int"))
    return placed_cut.groupBy("range").agg(F.array_sort(F.collect_list(F.struct("key", "first", "shards"))).alias("segments"), F.sum("shards").cast("int").alias("shards"))


def sharded(docs: DataFrame, target: int = TARGET_BYTES, splitters: int = SPLITTERS, slack: float = SLACK, seed: int = SEED) -> DataFrame:
    """docs with shard_id, each shard one partition in the order of the keys."""
    key = sort_key(docs)
    slim = written(docs.select(key.alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes")), "keys")
    coarse = coarse_splitters(slim, target, splitters, seed)
    placed = written(slim.withColumn("range", range_of(F.col("key"), coarse)), "ranges")
    layout = written(_segments(placed, target, slack), "segments")
    shards = np.ones(len(coarse) + 1, dtype=np.int64)
    for r in layout.select("range", "shards").collect():  # at most one row a coarse range
        shards[r.range] = r.shards
    base = np.cumsum(shards) - shards
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard_id"]
    out = docs.select(F.struct(*columns).alias("row"), key.alias("key")).withColumn("range", range_of(F.col("key"), coarse))
    if len(coarse):
        first = docs.sparkSession.createDataFrame(list(enumerate(base.tolist())), "range int, base int")
        out = out.join(F.broadcast(first), "range")
    else:
        out = out.withColumn("base", F.lit(0))
    inside = F.lit(0)
    if shards.max() > 1:
        cuts = layout.select("range", "segments")
        out = out.join(F.broadcast(cuts) if shards.sum() <= BROADCAST_ROWS else cuts, "range", "left")
        own = F.element_at(F.filter("segments", lambda s: s["key"] <= F.col("key")), -1)
        turn = F.pmod(F.monotonically_increasing_id(), F.greatest(own["shards"], F.lit(1)))
        inside = F.when(F.col("segments").isNull(), 0).otherwise(own["first"] + F.when(own["shards"] > 1, turn).otherwise(0))
    return out.select("row.*", (F.col("base") + inside).cast("int").alias("shard_id")).repartitionById(int(shards.sum()), F.col("shard_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
