"""Transcripts that report running totals: the usage of each event is decoded from those before it.

What an event adds depends on the last total that counted and on models named later, which windows can't carry
through regressions; so a transcript's narrow events are decoded in order by one call.  A transcript is one
session's file: groups are bounded by it, not by the corpus."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import decode_timestamp
from ..plans.adapter import TOKENS
from .readers import COLUMNS

#: Of a usage report, in this order.
COUNTERS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens")
#: A total this near below the last one is an old report that came late, not a new start.
LATE_SHARE = 0.98

_USAGE = ", ".join(f"{c}:bigint" for c in COUNTERS)
_LINE = f"timestamp string, type string, payload struct<type:string, id:string, model:string, model_provider:string, info:struct<total_token_usage:struct<{_USAGE}>, last_token_usage:struct<{_USAGE}>>>"


def late(total: list[int], last: list[int] | None, before: list[int]) -> bool:
    """Whether a falling total is an older report: close below the one before, or within two increments of it."""
    now, then = sum(total), sum(before)
    return now < then and (now >= LATE_SHARE * then or (last is not None and now + 2 * sum(last) >= then))


def increments(reports: Iterable[tuple[list[int] | None, list[int] | None]]) -> Iterator[list[int] | None]:
    """What each report (total, last) adds, or None.

    A repeated total adds nothing and neither does a late one.  The reported increment counts if there is one,
    else the rise over the total before; after a new start, the total itself.  A total of zero isn't a start."""
    before: list[int] | None = None
    for total, last in reports:
        if total is None:
            yield last
            continue
        if before is not None and (total == before or late(total, last, before)):
            yield None
            continue
        rise = None if before is None else [a - b for a, b in zip(total, before, strict=True)]
        yield last if last is not None else total if rise is None or min(rise) < 0 else rise
        if any(total):
            before = total


def buckets(added: list[int]) -> tuple[int, ...] | None:
    """Disjoint buckets of an increment, whose input includes both caches; None if they hold more than it."""
    whole, read, write, output, reasoning = added
    fresh = whole - read - write
    return None if min(*added, fresh) < 0 or not any(added) else (fresh, output, read, write, reasoning)


def _decode(lines):
    """Rows of one transcript; a record before any model is named takes the next that is."""
    import pandas as pd

    lines = lines.sort_values(["block", "line"], kind="stable")
    names = [n for n in lines["session"] if isinstance(n, str)]
    model = provider = None
    held: list[dict] = []
    waiting: list[dict] = []

    def counters(values) -> list[int] | None:
        return None if values is None else [int(v or 0) for v in values]

    adds = increments((counters(t), counters(x)) for t, x, u in zip(lines["total"], lines["last"], lines["reports"], strict=True) if u)
    for i, row in enumerate(lines.itertuples(index=False)):
        if isinstance(row.provider, str):
            provider = row.provider
        if isinstance(row.model, str):
            model = row.model
            for w in waiting:
                w["model_id"] = model
            waiting = []
        made = row.reports and (added := next(adds)) is not None and buckets(added)
        if made:
            record = dict(zip(TOKENS, made, strict=True)) | {"model_id": model, "provider_id": provider, "timestamp_ms": row.timestamp_ms, "input_seq": i}
            held.append(record)
            if model is None:
                waiting.append(record)
    out = pd.DataFrame(held, columns=[*TOKENS, "model_id", "provider_id", "timestamp_ms", "input_seq"])
    path = lines["input_path"].iloc[0]
    out["session_id"], out["input_path"] = names[0] if names else path.rsplit("/", 1)[-1].removesuffix(".jsonl"), path
    return out.astype({c: "Int64" for c in (*TOKENS, "timestamp_ms", "input_seq")})


def read_codex(spark: SparkSession, root: str) -> DataFrame:
    """Records of transcripts of running totals under root; input_seq orders a file's records.
    Damaged lines and empty files give nothing; times that are missing stay null."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    read = text.select(F.col("_metadata.file_path").alias("input_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.from_json("value", _LINE).alias("r"))

    def counters(name: str):
        base = f"r.payload.info.{name}"
        return F.when(F.col(base).isNotNull(), F.array(*[F.coalesce(f"{base}.{c}", F.lit(0)) for c in COUNTERS]))

    total, last = counters("total_token_usage"), counters("last_token_usage")
    usage = (F.col("r.type") == "event_msg") & (F.col("r.payload.type") == "token_count") & (total.isNotNull() | last.isNotNull())
    meta = F.col("r.type") == "session_meta"
    events = read.select(
        "input_path", "block", "line", decode_timestamp(F.col("r.timestamp")).alias("timestamp_ms"), F.coalesce(usage, F.lit(False)).alias("reports"), total.alias("total"), last.alias("last"),
        F.when(meta, F.col("r.payload.id")).alias("session"), F.when(meta, F.col("r.payload.model_provider")).alias("provider"), F.when(F.col("r.type") == "turn_context", F.col("r.payload.model")).alias("model"),
    ).where("reports or session is not null or provider is not null or model is not null")
    schema = ", ".join(f"{c} bigint" for c in TOKENS) + ", model_id string, provider_id string, timestamp_ms bigint, input_seq bigint, session_id string, input_path string"
    made = events.groupBy("input_path").applyInPandas(_decode, schema)
    return made.withColumns({"client": F.lit("codex"), "message_count": F.lit(1), "dedup_key": F.lit(None).cast("string")}).select(*COLUMNS)
