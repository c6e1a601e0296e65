"""Incremental ingestion as Structured Streaming: bounded dedup and hourly facts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.adapter import TOKENS


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """First record per (client, dedup_key) within the watermark; records without key all stay."""
    marked = stream.withWatermark("ts", delay)
    key = F.coalesce("dedup_key", F.concat(F.lit("\u0000"), F.col("input_seq").cast("string")))
    return marked.withColumn("_key", key).dropDuplicatesWithinWatermark(["client", "_key"]).drop("_key")


def hourly(stream: DataFrame) -> DataFrame:
    """Sums per hour and client over a stream with a watermark on ts."""
    return stream.groupBy(F.window("ts", "1 hour"), "client").agg(*[F.sum(c).alias(c) for c in TOKENS], F.count(F.lit(1)).alias("records")).select(F.col("window.start").alias("local_hour"), "client", *TOKENS, "records")
