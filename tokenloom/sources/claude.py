"""Transcripts of claude: copies of a message to be merged, calls of advisors, writes kept for an hour, sidechains."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import decode_timestamp
from ..functions.names import normalize_workspace
from ..plans.adapter import TOKENS
from .readers import COLUMNS
from .sessions import PLACE, ordered_lines

_USAGE = "input_tokens:bigint, output_tokens:bigint, cache_read_input_tokens:bigint, cache_creation_input_tokens:bigint, cache_creation:struct<ephemeral_1h_input_tokens:bigint>"
CLAUDE = f"""type string, sessionId string, timestamp string, requestId string, providerId string, cwd string, isSidechain boolean,
  message struct<id:string, model:string, providerId:string, usage:struct<{_USAGE}, iterations:array<struct<type:string, model:string, {_USAGE}>>>>"""


def read_claude(spark: SparkSession, root: str) -> DataFrame:
    """A record per copy of a message, and one per advisor's call in it, which isn't in the message's counters and
    counts no message.  Copies have one dedup key; quality.merge_copies() makes one record of them, input_split telling
    which copies count input without caches.  A sidechain's records, from its first line on, are of the session that
    line names, and not of a main session; nor are those behind a reference to a forked context."""
    lines = ordered_lines(spark, root, "*.jsonl").withColumn("r", F.from_json("value", CLAUDE)).drop("value")
    so_far = Window.partitionBy("input_path").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)
    side = F.col("r.isSidechain") & (F.trim("r.sessionId") != "")
    sign = F.when(F.col("r.type") == "fork-context-ref", F.struct(F.lit(None).cast("string").alias("session"))).when(side, F.struct(F.col("r.sessionId").alias("session")))
    lines = lines.withColumns({"input_seq": F.row_number().over(Window.partitionBy("input_path").orderBy(*PLACE)), "side": F.first(sign, ignorenulls=True).over(so_far)}).where("r.message.usage is not null")
    u = F.col("r.message.usage")
    names = [c.split(":")[0] for c in _USAGE.split(", ")]
    call = lambda i, model, x: F.struct(i.cast("int").alias("i"), model.alias("model"), *[x[c].alias(c) for c in names])
    advised = F.filter(F.transform(u["iterations"], lambda x, i: F.struct(x["type"].alias("type"), call(i, x["model"], x).alias("c"))), lambda x: (x["type"] == "advisor_message") & F.coalesce(F.trim(x["c"]["model"]) != "", F.lit(False)))
    calls = F.concat(F.array(call(F.lit(-1), F.col("r.message.model"), u)), F.coalesce(F.transform(advised, lambda x: x["c"]), F.array()))
    rows = lines.withColumn("c", F.explode(calls)).where("lower(trim(coalesce(c.model, ''))) <> '<synthetic>' and lower(trim(coalesce(r.message.model, ''))) <> '<synthetic>'")
    n = lambda c: F.coalesce(F.col(f"c.{c}"), F.lit(0))
    own = F.when(F.col("r.message.id").isNotNull(), F.concat_ws(":", F.when(F.col("r.requestId").isNull(), "message"), "r.message.id", "r.requestId"))
    advisor = F.col("c.i") >= 0
    rows = normalize_workspace(rows.withColumn("_cwd", F.col("r.cwd")), "_cwd").withColumns({
        "client": F.lit("claude"), "model_id": F.trim("c.model"), "provider_id": F.coalesce("r.message.providerId", "r.providerId"), "session_id": F.coalesce("side.session", "r.sessionId"), "timestamp_ms": decode_timestamp(F.col("r.timestamp")),
        "tok_input": n("input_tokens"), "tok_output": n("output_tokens"), "tok_cache_read": n("cache_read_input_tokens"), "tok_cache_write": n("cache_creation_input_tokens"), "tok_reasoning": F.lit(0).cast("bigint"),
        "tok_write_1h": F.coalesce("c.cache_creation.ephemeral_1h_input_tokens", F.lit(0)), "input_split": F.col("c.input_tokens").isNotNull() & (F.col("c.cache_read_input_tokens").isNotNull() | F.col("c.cache_creation_input_tokens").isNotNull()),
        "message_count": F.when(advisor, 0).otherwise(1), "dedup_key": F.when(advisor, F.concat(F.lit("claude-advisor:"), own, F.lit(":"), "c.i")).otherwise(own), "is_main_session": F.col("side").isNull(),
        "input_seq": F.col("input_seq").cast("bigint") * 4294967296 + F.col("c.i") + 1,
    })
    return rows.where(~advisor | (F.greatest(*TOKENS) > 0)).select(*COLUMNS, "workspace_key", "is_main_session", "tok_write_1h", "input_split")
