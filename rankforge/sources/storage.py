"""Small files and folders on whatever storage the paths name, through the file systems that Spark itself uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isFile()


def resolved(spark: SparkSession, path: str) -> str:
    """The path as the file system names it, without the scheme of local files."""
    fs, at = _at(spark, path)
    return str(fs.makeQualified(at).toString()).removeprefix("file:")


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, at = _at(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(str(path))
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    return read_bytes(spark, path).decode("utf-8")


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """The file, its folders included; one of that name is replaced."""
    write_parts(spark, path, [content])


def write_parts(spark: SparkSession, path: str, parts) -> None:
    fs, at = _at(spark, path)
    stream = fs.create(at, True)
    try:
        for part in parts:
            stream.write(bytearray(part))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))


def write_json_list(df: DataFrame, path: str) -> None:
    """One JSON list, streamed from the partitions one after another, so that the driver holds no table."""

    def parts():
        before = "[\n"
        for row in df.toJSON().toLocalIterator():
            yield f"{before}{row}".encode()
            before = ",\n"
        yield b"[]\n" if before == "[\n" else b"\n]\n"

    write_parts(df.sparkSession, path, parts())


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the non-empty folders directly in a path."""
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return []
    inner = [s.getPath() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(p.getName() for p in inner if fs.listFiles(p, True).hasNext())


def names(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """The names of the files directly in a path."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isFile() and s.getPath().getName().endswith(suffix)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, or a temporary one of a local session without that setting."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="rankforge-"))
        shared = spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
