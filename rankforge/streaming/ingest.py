"""Streaming ingestion: new text files become chunks in a table; index tables are rebuilt from it when wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankforge.config import Config
from rankforge.functions import text as T
from rankforge.operators.chunking import chunk_documents
from rankforge.operators.preprocess import preprocess


def documents(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the .txt and .md files that arrive in a folder, one row each."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.{[tT][xX][tT],[mM][dD]}").load(path)
    plain = lambda c: F.url_decode(F.replace(F.col(c), F.lit("+"), F.lit("%2B")))
    local, name = F.regexp_replace(plain("_metadata.file_path"), "^file:/*", "/"), plain("_metadata.file_name")
    return files.select(T.document_id(name, F.col("value")).alias("document_id"), F.regexp_replace(name, r"\.[^.]+$", "").alias("title"), F.col("value").alias("text"), local.alias("source"))


def chunks(stream: DataFrame, config: Config) -> DataFrame:
    return chunk_documents(preprocess(stream, config).drop("preprocessing_steps"), config)


def start(spark: SparkSession, path: str, output: str, checkpoint: str, config: Config, available_now: bool = False) -> StreamingQuery:
    """Append the chunks of arriving files to a Parquet table, exactly once a file."""
    writer = chunks(documents(spark, path), config).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start(output)
