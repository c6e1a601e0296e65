"""Clients that keep one JSON document per session, and one whose lines lean on lines before them.

A document is one row of a task, so the largest session file bounds memory.  A document that can't be decoded
gives no rows; an entry whose buckets don't add up (a counter that includes more than it holds) is left out,
as is one that counts nothing.  Models and times that are missing stay null, for the quality gate to name."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import decode_timestamp
from ..plans.adapter import TOKENS
from .readers import COLUMNS, _n

PARENT = "([^/]+)/[^/]+$"


@dataclass(frozen=True)
class Artifact:
    client: str
    glob: str
    schema: str
    entries: Callable[[DataFrame], DataFrame]
    keep: Callable[[], Column]
    fields: Callable[[], dict[str, Column]]


def _each(df: DataFrame, array: str) -> DataFrame:
    return df.select("input_path", "r", F.posexplode(array).alias("input_seq", "e"))


def _roocode_entries(df: DataFrame) -> DataFrame:
    told = F.from_json("e.text", "tokensIn bigint, tokensOut bigint, cacheReads bigint, cacheWrites bigint")
    return _each(df, "r").where("e.type = 'say' and e.say = 'api_req_started'").withColumn("u", told)


def _roocode() -> dict[str, Column]:
    read, write = _n("u.cacheReads"), _n("u.cacheWrites")
    return {
        "model_id": F.col("e.modelInfo.modelId"), "provider_id": F.col("e.modelInfo.providerId"), "session_id": F.regexp_extract("input_path", PARENT, 1), "timestamp_ms": decode_timestamp(F.col("e.ts")),
        "tok_input": _n("u.tokensIn") - read - write, "tok_output": _n("u.tokensOut"), "tok_cache_read": read, "tok_cache_write": write, "tok_reasoning": F.lit(0), "dedup_key": F.lit(None),
    }


def _mux_entries(df: DataFrame) -> DataFrame:
    return df.select("input_path", "r", F.posexplode("r.byModel").alias("input_seq", "key", "u"))


def _mux() -> dict[str, Column]:
    session, named = F.regexp_extract("input_path", PARENT, 1), F.col("key").contains(":")
    return {
        "model_id": F.trim(F.when(named, F.expr("substring(key, instr(key, ':') + 1)")).otherwise(F.col("key"))), "provider_id": F.when(named, F.trim(F.substring_index("key", ":", 1))), "session_id": session,
        "timestamp_ms": F.when(F.col("r.lastRequest.timestamp") > 0, F.col("r.lastRequest.timestamp")),
        "tok_input": _n("u.input.tokens"), "tok_output": _n("u.output.tokens"), "tok_cache_read": _n("u.cached.tokens"), "tok_cache_write": _n("u.cacheCreate.tokens"), "tok_reasoning": _n("u.reasoning.tokens"),
        "dedup_key": F.concat_ws(":", F.lit("mux"), session, "key"),
    }


def _cline() -> dict[str, Column]:
    m = "e.metrics."
    read, write = _n(m + "cacheReadTokens"), _n(m + "cacheWriteTokens")
    return {
        "model_id": F.col("e.modelInfo.id"), "provider_id": F.col("e.modelInfo.provider"), "session_id": F.col("r.sessionId"), "timestamp_ms": decode_timestamp(F.col("e.ts")),
        "tok_input": _n(m + "inputTokens") - read - write, "tok_output": _n(m + "outputTokens"), "tok_cache_read": read, "tok_cache_write": write, "tok_reasoning": F.lit(0), "dedup_key": F.lit(None),
    }


def _droid() -> dict[str, Column]:
    u = "r.tokenUsage."
    return {
        "model_id": F.col("r.model"), "provider_id": F.col("r.providerLock"), "session_id": F.regexp_extract("input_path", r"([^/]+)\.settings\.json$", 1), "timestamp_ms": decode_timestamp(F.col("r.providerLockTimestamp")),
        "tok_input": _n(u + "inputTokens"), "tok_output": _n(u + "outputTokens"), "tok_cache_read": _n(u + "cacheReadTokens"), "tok_cache_write": _n(u + "cacheCreationTokens"), "tok_reasoning": _n(u + "thinkingTokens"), "dedup_key": F.lit(None),
    }


def _gemini() -> dict[str, Column]:
    """The total tells whether input holds what was cached: it does if it is the sum without the cache."""
    n = {c: F.greatest(_n(f"e.tokens.{c}"), F.lit(0)) for c in ("input", "output", "cached", "thoughts", "tool")}
    inside = n["input"] + n["output"] + n["thoughts"] + n["tool"]
    overlaps = F.coalesce((n["cached"] > 0) & (F.greatest(F.col("e.tokens.total"), F.lit(0)) == inside), F.lit(False))
    return {
        "model_id": F.col("e.model"), "provider_id": F.lit("google"), "session_id": F.trim("r.sessionId"), "timestamp_ms": decode_timestamp(F.col("e.timestamp")),
        "tok_input": F.when(overlaps, n["input"] - F.least(n["cached"], n["input"])).otherwise(n["input"]) + n["tool"], "tok_output": n["output"], "tok_cache_read": n["cached"], "tok_cache_write": F.lit(0), "tok_reasoning": n["thoughts"], "dedup_key": F.lit(None),
    }


_BUCKET = "struct<tokens:bigint>"
ARTIFACTS = {a.client: a for a in (
    Artifact("roocode", "ui_messages.json", "array<struct<type:string, say:string, text:string, ts:string, modelInfo:struct<providerId:string, modelId:string>>>", _roocode_entries, lambda: F.col("u").isNotNull(), _roocode),
    Artifact("mux", "session-usage.json", f"struct<byModel:map<string, struct<input:{_BUCKET}, cached:{_BUCKET}, cacheCreate:{_BUCKET}, output:{_BUCKET}, reasoning:{_BUCKET}>>, lastRequest:struct<timestamp:bigint>>", _mux_entries, lambda: F.col("u").isNotNull(), _mux),
    Artifact("cline", "*.messages.json", "struct<version:int, sessionId:string, messages:array<struct<role:string, ts:string, metrics:struct<inputTokens:bigint, outputTokens:bigint, cacheReadTokens:bigint, cacheWriteTokens:bigint>, modelInfo:struct<id:string, provider:string>>>>", lambda df: _each(df.where("r.version = 1"), "r.messages"), lambda: (F.col("e.role") == "assistant") & F.col("e.metrics").isNotNull(), _cline),
    Artifact("droid", "*.settings.json", "struct<model:string, providerLock:string, providerLockTimestamp:string, tokenUsage:struct<inputTokens:bigint, outputTokens:bigint, cacheCreationTokens:bigint, cacheReadTokens:bigint, thinkingTokens:bigint>>", lambda df: df.withColumn("input_seq", F.lit(0)), lambda: F.col("r.tokenUsage").isNotNull(), _droid),
    Artifact("gemini", "*.json", "struct<sessionId:string, messages:array<struct<id:string, timestamp:string, model:string, tokens:struct<input:bigint, output:bigint, cached:bigint, thoughts:bigint, tool:bigint, total:bigint>>>>", lambda df: _each(df.where("input_path rlike '/tmp/[^/]+/chats/[^/]+$' and trim(r.sessionId) <> ''"), "r.messages"), lambda: F.col("e.tokens").isNotNull(), _gemini),
)}


def _canonical(df: DataFrame, client: str) -> DataFrame:
    counted = F.least(*TOKENS) >= 0
    typed = df.withColumns({c: F.col(c).cast("bigint") for c in (*TOKENS, "timestamp_ms", "input_seq")} | {c: F.col(c).cast("string") for c in ("model_id", "provider_id", "dedup_key")} | {"client": F.lit(client), "message_count": F.lit(1)})
    return typed.where(counted & (F.greatest(*TOKENS) > 0)).select(*COLUMNS)


def read_artifacts(spark: SparkSession, client: str, root: str) -> DataFrame:
    """Records of a client that keeps JSON documents under root; input_seq is an entry's place in its document."""
    source = ARTIFACTS[client]
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", source.glob).option("wholetext", True).text(root)
    rows = source.entries(text.select(F.col("_metadata.file_path").alias("input_path"), F.from_json("value", source.schema).alias("r")))
    return _canonical(rows.where(source.keep()).select("input_path", "input_seq", *[c.alias(k) for k, c in source.fields().items()]), client)


OPENCLAW = "type string, customType string, modelId string, provider string, data struct<provider:string, modelId:string>, message struct<role:string, timestamp:bigint, provider:string, model:string, usage:struct<input:bigint, output:bigint, cacheRead:bigint, cacheWrite:bigint>>"


def read_openclaw(spark: SparkSession, root: str) -> DataFrame:
    """A message without model takes the last one that its file named before, in a change of model, a snapshot
    or a message.  A damaged line or an unfit change forgets it.  Lines are ordered by their file's block, then
    within it, so a file of many blocks keeps its order."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl*").text(root).where(F.trim("value") != "")
    lines = text.select(F.col("_metadata.file_path").alias("input_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), F.from_json("value", OPENCLAW).alias("r"))

    def some(column: str | Column) -> Column:
        trimmed = F.trim(column)
        return F.when(trimmed != "", trimmed)

    snapshot = (F.col("r.type") == "custom") & (F.col("r.customType") == "model-snapshot")
    change = (F.col("r.type") == "model_change") | snapshot
    model, provider = (some(F.when(snapshot, F.col(f"r.data.{c}")).otherwise(F.col(f"r.{c}"))) for c in ("modelId", "provider"))
    fit = model.isNotNull() & provider.isNotNull()
    u = "r.message.usage."
    counts = [_n(u + c) for c in ("input", "output", "cacheRead", "cacheWrite")]
    message = (F.col("r.type") == "message") & (F.col("r.message.role") == "assistant") & F.col("r.message.usage").isNotNull() & (F.least(*counts) >= 0) & (F.greatest(*counts) > 0) & (F.col("r.message.timestamp") > 0)
    own_model, own_provider = some("r.message.model"), some("r.message.provider")
    lost = F.col("r.type").isNull()
    before = Window.partitionBy("input_path").orderBy("_block", "_line").rowsBetween(Window.unboundedPreceding, 0)

    def carried(told: Column, change_value: Column, own: Column) -> Column:
        value = F.when(lost, F.struct(F.lit(None).cast("string").alias("x"))).when(change, F.struct(F.when(fit, change_value).alias("x"))).when(message & told, F.struct(own.alias("x")))
        return F.last(value, ignorenulls=True).over(before)["x"]

    made = lines.withColumns({
        "_kept": message, "model_id": carried(own_model.isNotNull(), model, own_model), "provider_id": carried(own_model.isNotNull() | own_provider.isNotNull(), provider, own_provider),
        "input_seq": F.row_number().over(Window.partitionBy("input_path").orderBy("_block", "_line")) - 1,
    })
    fields = {"tok_input": counts[0], "tok_output": counts[1], "tok_cache_read": counts[2], "tok_cache_write": counts[3], "tok_reasoning": F.lit(0), "timestamp_ms": F.col("r.message.timestamp"), "session_id": F.regexp_extract("input_path", r"([^/]+?)\.jsonl[^/]*$", 1), "dedup_key": F.lit(None)}
    return _canonical(made.where("_kept").withColumns(fields), "openclaw")
