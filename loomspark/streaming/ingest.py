"""Incremental ingestion of session logs, and counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def log_stream(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """New lines of `<root>/<directory>/<session>.jsonl` as session_id, ts, type, tokens; lines that do not parse are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).text(root)
    v = F.try_parse_json("value")
    parsed = lines.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.jsonl$", 1).alias("session_id"), v.alias("v")).filter("v is not null")
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    return parsed.select("session_id", get("$.timestamp", "string").try_cast("timestamp").alias("ts"), get("$.type", "string").alias("type"), F.coalesce(get("$.message.usage.output_tokens", "long"), F.lit(0)).alias("tokens"))


def token_windows(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Messages and output tokens per window of event time; a window closes when it is late."""
    timed = stream.filter("ts is not null").withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "type").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).select(F.col("window.start").alias("start"), "type", "n", "tokens")


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append all that is new to a Parquet folder and stop; a restart goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
