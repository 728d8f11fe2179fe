"""Streams: landed documents become chunk rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T

DOCUMENTS = "doc_id long, text string"


def landed(spark: SparkSession, folder: str, schema: str = DOCUMENTS, files_a_batch: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream; ``landed_at`` is when a row's file was written."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return rows.withColumn("landed_at", F.col("_metadata.file_modification_time"))


def chunk_stream(docs: DataFrame, most: int = 256, overlap: int = 32, remember: str = "7 days") -> DataFrame:
    """Fixed-window chunks; documents that arrive again within ``remember`` are dropped by id.

    Older ids leave the state, which so stays as large as what lands in that time.
    """
    once = docs.withWatermark("landed_at", remember).dropDuplicatesWithinWatermark(["doc_id"])
    return once.select("doc_id", F.posexplode(T.windows(T.words(F.col("text")), most, overlap)).alias("position", "text"))


def append(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived and stops: exactly once, by the file sink's log."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
