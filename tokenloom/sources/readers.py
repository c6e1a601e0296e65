"""Readers of transcripts and embedded databases into the canonical record.

A source names where its files are and how a decoded row's counters become disjoint buckets.  JSON lines are
read as text and decoded with a narrow schema, so that a damaged line is one rejected row; databases are
opened one file per task by Python's sqlite3, since no JDBC driver comes with Spark."""
from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import decode_timestamp
from ..plans.adapter import TOKENS

COLUMNS = ["client", "model_id", "provider_id", "session_id", "timestamp_ms", *TOKENS, "message_count", "dedup_key", "input_path", "input_seq"]
#: What some clients say of a record's session, turn and buckets; null for others.
SESSION = {"workspace_key": "string", "is_main_session": "boolean", "agent": "string", "is_turn_start": "boolean", "tok_write_1h": "bigint", "input_split": "boolean"}
#: Those of them that a database's rows may have after the dedup key.
EMBEDDED_SESSION = {"opencode": ["workspace_key", "is_main_session"], "warp": ["workspace_key"]}


@dataclass(frozen=True)
class Source:
    client: str
    glob: str
    schema: str
    keep: Callable[[], Column]
    fields: Callable[[], dict[str, Column]]


def _n(path: str) -> Column:
    return F.coalesce(F.col(path), F.lit(0)).cast("bigint")


def _claude() -> dict[str, Column]:
    u = "r.message.usage."
    return {"model_id": F.col("r.message.model"), "provider_id": F.col("r.providerId"), "session_id": F.col("r.sessionId"), "timestamp_ms": decode_timestamp(F.col("r.timestamp")), "tok_input": _n(u + "input_tokens"), "tok_output": _n(u + "output_tokens"), "tok_cache_read": _n(u + "cache_read_input_tokens"), "tok_cache_write": _n(u + "cache_creation_input_tokens"), "tok_reasoning": F.lit(0), "dedup_key": F.concat_ws(":", "r.message.id", "r.requestId")}


def _qwen() -> dict[str, Column]:
    u = "r.usageMetadata."
    prompt, out, think, cached, whole = (_n(u + c) for c in ("promptTokenCount", "candidatesTokenCount", "thoughtsTokenCount", "cachedContentTokenCount", "totalTokenCount"))
    said = F.col(u + "totalTokenCount").isNotNull()
    inside = said & ((whole == prompt + out) | ((whole == 0) & (out > 0)))  # thoughts are part of the candidates; an absent total says nothing
    r = F.when(inside, F.least(think, out)).otherwise(think)
    return {"model_id": F.col("r.model"), "provider_id": F.lit(None), "session_id": F.col("r.sessionId"), "timestamp_ms": decode_timestamp(F.col("r.timestamp")), "tok_input": F.when(cached <= prompt, prompt - cached).otherwise(prompt), "tok_output": F.when(inside, out - r).otherwise(out), "tok_cache_read": cached, "tok_cache_write": F.lit(0), "tok_reasoning": r, "dedup_key": F.lit(None)}


def _pi() -> dict[str, Column]:
    u = "r.message.usage."
    r = F.least(_n(u + "reasoning"), _n(u + "output"))
    return {"model_id": F.col("r.message.model"), "provider_id": F.col("r.message.provider"), "session_id": F.regexp_extract("input_path", r"([^/]+?)(?:\.[^./]*)?$", 1), "timestamp_ms": decode_timestamp(F.col("r.timestamp")), "tok_input": _n(u + "input"), "tok_output": _n(u + "output") - r, "tok_cache_read": _n(u + "cacheRead"), "tok_cache_write": _n(u + "cacheWrite"), "tok_reasoning": r, "dedup_key": F.lit(None)}


def _kimi() -> dict[str, Column]:
    u = "r.usage."
    return {"model_id": F.col("r.model"), "provider_id": F.lit(None), "session_id": F.regexp_extract("input_path", "([^/]+)/[^/]+$", 1), "timestamp_ms": decode_timestamp(F.col("r.time").cast("string")), "tok_input": _n(u + "inputOther"), "tok_output": _n(u + "output"), "tok_cache_read": _n(u + "inputCacheRead"), "tok_cache_write": _n(u + "inputCacheCreation"), "tok_reasoning": F.lit(0), "dedup_key": F.lit(None)}


SOURCES = {s.client: s for s in (
    Source("claude", "*.jsonl", "type string, sessionId string, timestamp string, requestId string, providerId string, message struct<id:string, model:string, usage:struct<input_tokens:bigint, output_tokens:bigint, cache_read_input_tokens:bigint, cache_creation_input_tokens:bigint>>", lambda: F.col("r.message.usage").isNotNull() & (F.col("r.message.model") != "<synthetic>"), _claude),
    Source("qwen", "*.jsonl", "type string, model string, timestamp string, sessionId string, usageMetadata struct<promptTokenCount:bigint, candidatesTokenCount:bigint, totalTokenCount:bigint, cachedContentTokenCount:bigint, thoughtsTokenCount:bigint>", lambda: (F.col("r.type") == "assistant") & F.col("r.usageMetadata").isNotNull(), _qwen),
    Source("pi", "*.jsonl", "type string, timestamp string, message struct<role:string, model:string, provider:string, usage:struct<input:bigint, output:bigint, cacheRead:bigint, cacheWrite:bigint, reasoning:bigint>>", lambda: (F.col("r.message.role") == "assistant") & F.col("r.message.usage").isNotNull(), _pi),
    Source("kimi", "wire.jsonl", "type string, time bigint, model string, usage struct<inputOther:bigint, output:bigint, inputCacheRead:bigint, inputCacheCreation:bigint>", lambda: F.col("r.type") == "usage.record", _kimi),
)}

#: Queries whose columns are the canonical ones, for sources kept in SQLite.
DATABASES = {
    "goose": """SELECT json_extract(model_config_json, '$.model_name') AS model_id, provider_name AS provider_id, CAST(id AS TEXT) AS session_id, CAST(strftime('%s', created_at) AS INTEGER) * 1000 AS timestamp_ms,
      coalesce(accumulated_input_tokens, input_tokens, 0) AS tok_input, coalesce(accumulated_output_tokens, output_tokens, 0) AS tok_output, 0 AS tok_cache_read, 0 AS tok_cache_write,
      max(0, coalesce(accumulated_total_tokens, total_tokens, 0) - coalesce(accumulated_input_tokens, input_tokens, 0) - coalesce(accumulated_output_tokens, output_tokens, 0)) AS tok_reasoning, NULL AS dedup_key FROM sessions ORDER BY id""",
    "kilo": """SELECT json_extract(data, '$.modelID') AS model_id, json_extract(data, '$.providerID') AS provider_id, session_id, json_extract(data, '$.time.created') AS timestamp_ms,
      coalesce(json_extract(data, '$.tokens.input'), 0) AS tok_input, coalesce(json_extract(data, '$.tokens.output'), 0) AS tok_output, coalesce(json_extract(data, '$.tokens.cache.read'), 0) AS tok_cache_read,
      coalesce(json_extract(data, '$.tokens.cache.write'), 0) AS tok_cache_write, coalesce(json_extract(data, '$.tokens.reasoning'), 0) AS tok_reasoning, CAST(id AS TEXT) AS dedup_key FROM message WHERE json_extract(data, '$.tokens') IS NOT NULL ORDER BY id""",
    "hermes": """SELECT m.model AS model_id, coalesce(m.billing_provider, s.billing_provider) AS provider_id, s.id AS session_id, CAST(s.started_at * 1000 AS INTEGER) AS timestamp_ms, m.input_tokens AS tok_input,
      m.output_tokens - min(m.reasoning_tokens, m.output_tokens) AS tok_output, m.cache_read_tokens AS tok_cache_read, m.cache_write_tokens AS tok_cache_write, min(m.reasoning_tokens, m.output_tokens) AS tok_reasoning, NULL AS dedup_key
      FROM session_model_usage m JOIN sessions s ON s.id = m.session_id
      UNION ALL SELECT s.model, s.billing_provider, s.id, CAST(s.started_at * 1000 AS INTEGER), s.input_tokens, s.output_tokens - min(s.reasoning_tokens, s.output_tokens), s.cache_read_tokens, s.cache_write_tokens,
      min(s.reasoning_tokens, s.output_tokens), NULL FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM session_model_usage m WHERE m.session_id = s.id)""",
}

#: Of a hermes database without usage by model.
HERMES_SESSIONS = DATABASES["hermes"].split("UNION ALL ")[1].split(" WHERE NOT EXISTS")[0]
#: Clients that keep a database, of those that read_databases() knows.
EMBEDDED = ("goose", "hermes", "kilo", "opencode", "warp", "zcode", "zed")


def read_lines(spark: SparkSession, client: str, root: str) -> DataFrame:
    """Records of a JSON-lines client under root; input_seq grows along a file's lines, and isn't dense."""
    source = SOURCES[client]
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", source.glob).text(root)
    rows = text.select(F.col("_metadata.file_path").alias("input_path"), F.monotonically_increasing_id().alias("input_seq"), F.from_json("value", source.schema).alias("r"))
    made = rows.where(source.keep()).select("input_path", "input_seq", *[c.alias(k) for k, c in source.fields().items()])
    typed = made.withColumns({"client": F.lit(client), "message_count": F.lit(1), "dedup_key": F.col("dedup_key").cast("string"), "provider_id": F.col("provider_id").cast("string")} | {c: F.col(c).cast("bigint") for c in TOKENS})
    return typed.select(*COLUMNS)


def read_databases(spark: SparkSession, client: str, root: str, glob: str = "*.db") -> DataFrame:
    """Records of a client's SQLite files under root, one file per row of a task, with those of
    SESSION's columns that the client has."""
    import pyarrow as pa

    from . import embedded, opencode

    sql = DATABASES.get(client)
    rows_of = {"opencode": opencode.records, "zcode": embedded.zcode, "zed": embedded.zed, "warp": embedded.warp, "hermes": lambda db: embedded.hermes(db, DATABASES["hermes"], HERMES_SESSIONS)}.get(client, lambda db: db.execute(sql).fetchall())
    more = EMBEDDED_SESSION.get(client, [])
    names = ["model_id", "provider_id", "session_id", "timestamp_ms", *TOKENS, "dedup_key", *more]
    types = {n: "string" for n in ("model_id", "provider_id", "session_id", "dedup_key")} | SESSION

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with tempfile.TemporaryDirectory() as folder:
                    name = os.path.join(folder, "copy.db")
                    with open(name, "wb") as f:
                        f.write(content)
                    with sqlite3.connect(name) as db:
                        rows = rows_of(db)
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                kinds = [{"string": (pa.string(), str), "boolean": (pa.bool_(), bool)}.get(types.get(n), (pa.int64(), int)) for n in names]
                data = [pa.array([None if v is None else cast(v) for v in c], k) for c, (k, cast) in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*data, pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64())], [*names, "input_path", "input_seq"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "content")
    kinds = ", ".join(f"{n} {types.get(n, 'bigint')}" for n in names)
    return files.mapInArrow(run, f"{kinds}, input_path string, input_seq bigint").withColumns({"client": F.lit(client), "message_count": F.lit(1)}).select(*COLUMNS, *more)


def read_all(spark: SparkSession, roots: dict[str, str], zone: str = "UTC") -> DataFrame:
    """All clients' records, in one frame with SESSION's columns, in order of client id.  Times that name no zone
    are of zone."""
    from .artifacts import ARTIFACTS, read_artifacts, read_openclaw  # which use this module
    from .claude import read_claude
    from .cumulative import read_codex
    from .sessions import read_commandcode, read_dsh, read_grok, read_junie
    from .threads import THREADS, read_threads

    def read(client: str, root: str) -> DataFrame:
        if client == "junie":
            return read_junie(spark, root, zone)
        if client in (lines := {"claude": read_claude, "commandcode": read_commandcode, "dsh": read_dsh, "grok": read_grok}):
            return lines[client](spark, root)
        if client in THREADS:
            return read_threads(spark, client, root)
        if client == "openclaw":
            return read_openclaw(spark, root)
        if client == "codex":
            return read_codex(spark, root)
        kind = read_lines if client in SOURCES else read_artifacts if client in ARTIFACTS else read_databases
        return kind(spark, client, root)

    made = [read(c, root) for c, root in sorted(roots.items())]
    made = [df.withColumns({n: F.lit(None).cast(t) for n, t in SESSION.items() if n not in df.columns}) for df in made]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out
