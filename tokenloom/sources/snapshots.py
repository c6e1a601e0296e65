"""Snapshots of an answer: a folder of Parquet per generation and a line that says when it was whole.

The line is written after the data, so a run that dies leaves the generation before it in force."""
from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Changes when the columns of snapshots do; others' snapshots count as missing.
VERSION = 1
FRESH_MS = 300_000
_LINE = "version int, source string, data string, saved_ms bigint"


@dataclass(frozen=True)
class Found:
    """status is fresh, stale, missing, or failure where the line's data can't be opened."""

    status: str
    data: DataFrame | None = None
    saved_ms: int | None = None


def save(df: DataFrame, path: str, source: str, now_ms: int) -> None:
    """Stores df as the answer for a source fingerprint."""
    data = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{data}")
    df.sparkSession.createDataFrame([(VERSION, source, data, now_ms)], _LINE).coalesce(1).write.mode("append").json(f"{path}/lines")


def load(spark: SparkSession, path: str, source: str, now_ms: int, fresh_ms: int = FRESH_MS) -> Found:
    """The newest snapshot for a source; it is stale once fresh_ms have gone by, or if it is from the future."""
    try:
        lines = spark.read.schema(_LINE).json(f"{path}/lines")
        last = lines.where((F.col("version") == VERSION) & (F.col("source") == source)).agg(F.max_by(F.struct("data", "saved_ms"), "saved_ms").alias("l")).first()["l"]
    except AnalysisException:  # no folder yet
        return Found("missing")
    if last is None:
        return Found("missing")
    try:
        data = spark.read.parquet(f"{path}/{last['data']}")
    except AnalysisException:
        return Found("failure", None, last["saved_ms"])
    return Found("fresh" if 0 <= now_ms - last["saved_ms"] < fresh_ms else "stale", data, last["saved_ms"])
