"""Structured Streaming over event files, and the batch twins of its queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType, ts: str = "ts", late: str = "1 hour", files: int | None = None) -> DataFrame:
    """A stream of Parquet files with a watermark; times without zone are UTC."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def once_an_hour(events: DataFrame, key: list[Column], ts: str = "ts") -> DataFrame:
    """The first event of each key and hour; in a stream, state goes with the watermark."""
    marked = events.withColumn("event_hash", F.sha2(F.concat_ws("|", *[k.cast("string") for k in key], F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd'T'HH")).cast("binary"), 256))
    return marked.dropDuplicatesWithinWatermark(["event_hash"]) if events.isStreaming else marked.dropDuplicates(["event_hash"])


def tumbling(events: DataFrame, size: str, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    grouped = events.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, ts: str = "ts") -> DataFrame:
    grouped = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("session_start"), "n")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes a stream as Parquet with exactly-once files; ends when all that is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def upsert_batches(stream: DataFrame, write, checkpoint: str):
    """Hands each micro-batch and its number to ``write``, which must bear repeated numbers."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
