"""The canonical usage view over the events table, for the oracle-checked queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The canonical measures, in the order in which totals add them.
TOKENS = ["tok_input", "tok_output", "tok_cache_read", "tok_cache_write", "tok_reasoning"]
UNKNOWN_WORKSPACE = "Unknown workspace"
#: Public groupings and their columns.
GROUPINGS = {
    "model": ["model_id"],
    "client,model": ["client", "model_id"],
    "client,provider,model": ["client", "provider_id", "model_id"],
    "workspace,model": ["workspace_key", "model_id"],
    "machine,model": ["machine", "model_id"],
}


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usage record per event; cost in millionths of a dollar, so that its sums are exact."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    user, event = F.col("user_id"), F.col("event_id")
    made = events.select(
        event.alias("input_seq"), F.col("event_type").alias("client"), "ts",
        F.concat(F.lit("p"), (event % 3).cast("string")).alias("provider_id"),
        F.concat(F.lit("m"), (user % 7).cast("string")).alias("model_id"),
        F.concat(F.lit("u"), user.cast("string"), F.lit("-"), F.col("ts").cast("date").cast("string")).alias("session_id"),
        F.when(user % 10 != 0, F.concat(F.lit("ws/"), (user % 10).cast("string"))).alias("workspace_key"),
        F.when(user % 2 == 0, "local").otherwise("remote").alias("machine"),
        F.when(event % 4 != 0, F.concat(F.lit("a"), (event % 4).cast("string"))).alias("agent"),
        F.floor(F.col("value") * 100).cast("bigint").alias("tok_input"),
        (event % 512).alias("tok_output"), (event % 1024).alias("tok_cache_read"), (event % 128).alias("tok_cache_write"), (event % 64).alias("tok_reasoning"),
        (1 + event % 3).cast("int").alias("message_count"), (event % 2 == 0).alias("is_turn_start"),
        F.when(event % 5 != 0, F.floor(event / 2).cast("string")).alias("dedup_key"),
    )
    return made.withColumns({
        "tokens": sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0])),
        "cost_micros": F.col("tok_input") * 3 + (F.col("tok_output") + F.col("tok_reasoning")) * 15 + F.col("tok_cache_read"),
        "local_date": F.col("ts").cast("date"),
        "local_hour": F.date_trunc("hour", "ts").cast("timestamp_ntz"),
    })


USAGE_SQL = """
usage AS (SELECT *, tok_input + tok_output + tok_cache_read + tok_cache_write + tok_reasoning AS tokens,
    tok_input * 3 + (tok_output + tok_reasoning) * 15 + tok_cache_read AS cost_micros,
    CAST(ts AS DATE) AS local_date, date_trunc('hour', ts) AS local_hour
  FROM (SELECT event_id AS input_seq, event_type AS client, ts, 'p' || CAST(event_id % 3 AS VARCHAR) AS provider_id,
    'm' || CAST(user_id % 7 AS VARCHAR) AS model_id, 'u' || CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
    CASE WHEN user_id % 10 <> 0 THEN 'ws/' || CAST(user_id % 10 AS VARCHAR) END AS workspace_key,
    CASE WHEN user_id % 2 = 0 THEN 'local' ELSE 'remote' END AS machine,
    CASE WHEN event_id % 4 <> 0 THEN 'a' || CAST(event_id % 4 AS VARCHAR) END AS agent,
    CAST(floor(value * 100) AS BIGINT) AS tok_input, event_id % 512 AS tok_output, event_id % 1024 AS tok_cache_read,
    event_id % 128 AS tok_cache_write, event_id % 64 AS tok_reasoning, CAST(1 + event_id % 3 AS INT) AS message_count,
    event_id % 2 = 0 AS is_turn_start, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id // 2 AS VARCHAR) END AS dedup_key
  FROM events))
"""
