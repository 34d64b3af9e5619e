"""Shared storage for cut lineages, row keys, and input clean-up used by every operator here."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1 << 20  # of keys and a few numbers: some 60 MB in memory
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only a local master without that setting gets a temporary folder; a cluster without it is an error,
    since other machines could not read what one of them writes.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="rankforge-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives executors, keeps column pruning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rankforge-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def clean() -> None:
    """Delete what written() stored; results that still read it must have been saved before."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended, and its shared folder with it
            pass


def release() -> None:
    """Give freed memory back to the system, which allocators would keep for the life of a Python worker."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function that releases its memory when a task ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def narrow(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, to be broadcast in a join if it has at most `rows` rows; a larger one meets its partner by a shuffle."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named inputs under private names, so that no other column of df can clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def row_key() -> list[Column]:
    """96 bits that depend on a row's doc_id and text alone: the same on every read, whatever task reads it."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2")]


def seeded(seed: int, *columns: str) -> Column:
    """A 64-bit hash of the columns that depends on the seed."""
    return F.xxhash64(F.lit(int(seed)), *[F.col(c) for c in columns])
