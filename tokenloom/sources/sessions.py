"""Clients whose JSON lines lean on the lines before them in their file: junie, commandcode, dsh and grok.

What a line inherits is carried by windows over a file's lines, so a session file is the unit of a task.  Records
have the columns of readers.COLUMNS and those of readers.SESSION that the client tells.  Lines that can't be decoded
give no record; records whose counters can't be right are left out, as are those that count nothing."""
from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import decode_timestamp
from ..functions.names import agent_name, normalize_workspace
from ..plans.adapter import TOKENS
from .readers import COLUMNS

FOLDER = "([^/]+)/[^/]+$"
PLACE = ["_block", "_line"]


def ordered_lines(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """input_path, _block, _line, value of each line that isn't blank; the middle two give a line's place in its file,
    also where the file is read in many splits."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root).where(F.trim("value") != "")
    return text.select(F.col("_metadata.file_path").alias("input_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), "value")


def zstd_lines(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """ordered_lines() of files in zstd, which Spark's readers open only under the name .zst: each is decompressed as a
    stream by one task.  A file cut short gives the lines before the cut."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True) as stream:
                    lines, n = io.TextIOWrapper(stream, "utf-8", errors="replace", newline="\n"), 0
                    while True:
                        group = []
                        try:
                            for line in lines:
                                group.append(line.rstrip("\r\n"))
                                if len(group) == 1000:
                                    break
                            ended = len(group) < 1000
                        except zstandard.ZstdError:
                            ended = True
                        kept = [(n + i, line) for i, line in enumerate(group) if line.strip()]
                        n += len(group)
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(kept), pa.string()), pa.array([0] * len(kept), pa.int64()), pa.array([i for i, _ in kept], pa.int64()), pa.array([v for _, v in kept], pa.string())], ["input_path", "_block", "_line", "value"])
                        if ended:
                            break

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "content")
    return files.mapInArrow(run, "input_path string, _block bigint, _line bigint, value string")


def _some(column: str | Column) -> Column:
    trimmed = F.trim(column)
    return F.when(trimmed != "", trimmed)


def _records(df: DataFrame, client: str, more: list[str]) -> DataFrame:
    typed = df.withColumns({c: F.col(c).cast("bigint") for c in (*TOKENS, "timestamp_ms", "input_seq")} | {c: F.col(c).cast("string") for c in ("model_id", "provider_id", "session_id", "dedup_key")} | {"client": F.lit(client), "message_count": F.lit(1)})
    return typed.select(*COLUMNS, *more)


def _count(value: Column) -> Column:
    """A whole number from a number or its text, fractions cut off; -1 for anything else, null if absent."""
    text = F.trim(value)
    number = text.try_cast("double")
    whole = F.coalesce(text.try_cast("bigint"), F.when((number >= 0) & (number < 2.0**63), number.try_cast("bigint")))
    return F.when(value.isNotNull(), F.coalesce(whole, F.lit(-1)))


#: Names under which junie's counters are found, the first present counts.
JUNIE_COUNTERS = {
    "tok_input": ["inputTokens", "input"], "tok_output": ["outputTokens", "output"], "tok_cache_read": ["cacheInputTokens", "cacheReadInputTokens", "cacheRead"],
    "tok_cache_write": ["cacheCreateTokens", "cacheCreationInputTokens", "cacheWrite"], "tok_reasoning": ["reasoningTokens", "reasoningOutputTokens", "thinkingTokens"],
}


def read_junie(spark: SparkSession, root: str, zone: str = "UTC") -> DataFrame:
    """A record per model of each response's metadata; of a response, the first record starts a turn if a prompt came
    since the response before.  Without a time of its own, a record has that in its session's name, in zone."""
    counters = sorted({c for names in JUNIE_COUNTERS.values() for c in names})
    usage = ", ".join(f"{c}:string" for c in ("model", "provider", *counters))
    schema = f"kind string, timestampMs string, event struct<agentEvent:struct<kind:string, agent:struct<name:string, id:string>, modelUsage:array<struct<{usage}>>>>"
    lines = ordered_lines(spark, root, "events.jsonl").where("value like '%LlmResponseMetadataEvent%' or value like '%UserPromptEvent%'")
    lines = lines.withColumns({"r": F.from_json("value", schema), "damaged": F.try_parse_json("value").isNull()}).drop("value")
    event = F.col("r.event.agentEvent")
    response = F.coalesce((event["kind"] == "LlmResponseMetadataEvent") & event["modelUsage"].isNotNull() & ~F.coalesce(F.trim("r.kind"), F.lit("")).isin("UserPromptEvent", "AgentStateUpdatedEvent", "AgentCurrentStatusUpdatedEvent", "AgentPatchCreatedEvent"), F.lit(False))
    asked = F.when(F.col("damaged") | response, False).when(F.trim("r.kind") == "UserPromptEvent", True)
    before = Window.partitionBy("input_path").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.partitionBy("input_path").orderBy(*PLACE))
    marked = lines.withColumns({"asked": F.coalesce(F.last(asked, ignorenulls=True).over(before), F.lit(False)), "_n": place}).where(response)
    named = F.regexp_extract("session_id", r"^session-(\d{6}-\d{6})(?:-|$)", 1)
    part = lambda i: F.try_to_number(F.substring(named, i, 2), F.lit("99")).cast("int")
    named_ms = F.unix_millis(F.try_make_timestamp(2000 + part(1), part(3), part(5), part(8), part(10), part(12).cast("decimal(8,6)"), F.lit(zone)))
    said = _count(F.col("r.timestampMs"))
    made = marked.withColumn("session_id", F.regexp_extract("input_path", FOLDER, 1)).select(
        "input_path", "session_id", "asked", "_n", said.alias("said"), F.coalesce(F.when(said > 0, said), named_ms).alias("timestamp_ms"),
        agent_name(F.coalesce(_some("r.event.agentEvent.agent.name"), _some("r.event.agentEvent.agent.id"))).alias("agent"), F.posexplode("r.event.agentEvent.modelUsage").alias("_i", "u"))
    made = made.withColumns({c: F.coalesce(*[_count(F.col(f"u.{n}")) for n in names], F.lit(0)) for c, names in JUNIE_COUNTERS.items()})
    made = made.withColumns({"model_id": _some("u.model"), "provider_id": _some("u.provider")}).where((F.least(*TOKENS) >= 0) & (F.greatest(*TOKENS) > 0) & F.coalesce(F.col("said") >= 0, F.lit(True)))
    fit = F.col("model_id").isNotNull() & F.col("timestamp_ms").isNotNull()  # others are for the gate to name
    first = F.min(F.when(fit, F.col("_i"))).over(Window.partitionBy("input_path", "_n"))
    key = F.concat_ws(":", F.lit("junie"), "session_id", "timestamp_ms", "model_id", *TOKENS, "_i")
    made = made.withColumns({"is_turn_start": F.col("asked") & (F.coalesce(first, F.lit(-1)) == F.col("_i")), "dedup_key": F.when(fit, key), "input_seq": F.col("_n") * 4294967296 + F.col("_i")})
    return _records(made, "junie", ["agent", "is_turn_start"])


def read_commandcode(spark: SparkSession, root: str) -> DataFrame:
    """Transcripts hold no counters: output is estimated from an answer's content, input from what came since the answer
    before it.  The model is that of the session's .meta.json; without one it is unknown, and never priced."""
    lines = ordered_lines(spark, root, "*.jsonl").where(~F.col("input_path").endswith(".checkpoints.jsonl"))
    v = F.try_parse_json("value")
    text = F.to_json(F.try_variant_get("v", "$.content", "variant"))
    chars = F.when(text.isNull() | text.isin("null", "[]", "{}"), 0).otherwise(F.char_length(text)).cast("bigint")
    lines = lines.withColumn("v", v).where("v is not null").select("input_path", *PLACE, chars.alias("chars"), *[F.try_variant_get("v", f"$.{p}", "string").alias(p) for p in ("role", "timestamp", "sessionId")])
    answer = F.coalesce(F.col("role") == "assistant", F.lit(False))
    file = Window.partitionBy("input_path").orderBy(*PLACE)
    rows = lines.withColumns({"answer": answer, "_n": F.row_number().over(file), "turn": F.coalesce(F.sum(answer.cast("int")).over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    turn = Window.partitionBy("input_path", "turn")
    rows = rows.withColumns({"heard": F.sum(F.when(~F.col("answer"), F.col("chars")).otherwise(0)).over(turn), "is_turn_start": F.coalesce(F.bool_or(F.col("role") == "user").over(turn), F.lit(False))})
    rows = rows.where("answer").withColumns({"tok_input": F.ceil(F.col("heard") / 4), "tok_output": F.ceil(F.col("chars") / 4), "timestamp_ms": decode_timestamp(F.col("timestamp"))}).where("tok_input + tok_output > 0")
    own = _some("sessionId")
    told = F.last(F.when(F.col("timestamp_ms").isNotNull(), own), ignorenulls=True).over(file.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("session_id", F.coalesce(own, told)).withColumn("fit", F.col("session_id").isNotNull() & F.col("timestamp_ms").isNotNull())
    nth = F.sum(F.col("fit").cast("int")).over(file.rowsBetween(Window.unboundedPreceding, 0)) - 1
    rows = rows.withColumn("dedup_key", F.when(F.col("fit"), F.concat_ws(":", F.lit("commandcode"), "session_id", nth)))
    stem = lambda end: F.regexp_replace("input_path", end, "")
    meta = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").option("wholetext", True).text(root)
    meta = meta.select(F.col("_metadata.file_path").alias("input_path"), _some(F.try_variant_get(F.try_parse_json("value"), "$.model", "string")).alias("model")).select(stem(r"\.meta\.json$").alias("_stem"), "model")
    made = rows.withColumn("_stem", stem(r"\.jsonl$")).join(meta, "_stem", "left")
    model = F.regexp_replace(F.regexp_extract("model", "[^/]*$", 0), "(?i)(?<=.)-free$", "")
    zero = F.lit(0)
    made = made.withColumns({"model_id": F.coalesce(model, F.lit("commandcode-model-unknown")), "provider_id": F.when(F.col("model").isNull(), "unknown"), "workspace_key": F.regexp_extract("input_path", FOLDER, 1), "input_seq": F.col("_n"), "tok_cache_read": zero, "tok_cache_write": zero, "tok_reasoning": zero})
    return _records(made, "commandcode", ["workspace_key", "is_turn_start"])


#: Names of dsh's transcripts and their versions.
DSH_FILES = r"/session(?:\.v([34]))?\.jsonl(?:\.zstd)?$"
DSH_USAGE = "struct<inputTokens:bigint, outputTokens:bigint, cacheReadTokens:bigint, cacheWriteTokens:bigint, reasoningTokens:bigint>"
DSH = f"""type string, id string, cwd string, version bigint, isSeeded boolean, seedLength bigint, seq bigint, time bigint, data struct<inherited:boolean, turn:bigint, step:bigint, usage:{DSH_USAGE},
  header:struct<config:struct<provider:string, model:string>>, stream:array<struct<type:string, chunk:struct<type:string, usage:{DSH_USAGE}>>>,
  message:struct<id:string, source:struct<provider:string, model:string, replayState:struct<response:struct<responseModel:string>>>>>"""


def read_dsh(spark: SparkSession, root: str) -> DataFrame:
    """Of the transcripts in a folder only those of the newest version count.  What a session inherits, up to its last
    inherited mark, is another's; a seeded session without such a mark has no records.  In versions 3 and 4 a step's
    later usage replaces that before it, unless the step was tried again in between."""
    lines = ordered_lines(spark, root, "session*.jsonl").unionByName(zstd_lines(spark, root, "session*.jsonl.zstd")).where(F.col("input_path").rlike(DSH_FILES))
    named = F.coalesce(F.regexp_extract("input_path", DSH_FILES, 1).try_cast("int"), F.lit(0))
    lines = lines.withColumns({"folder": F.regexp_replace("input_path", "/[^/]+$", ""), "named": named, "r": F.from_json("value", DSH)}).drop("value")
    lines = lines.withColumn("newest", F.max("named").over(Window.partitionBy("folder"))).where("named = newest")
    # All windows below have folder among their keys, so the lines move once.
    file = Window.partitionBy("folder", "input_path").orderBy(*PLACE)
    whole, so_far = Window.partitionBy("folder", "input_path"), file.rowsBetween(Window.unboundedPreceding, 0)
    kind = F.trim("r.type")
    carried = lambda of, value: F.last(F.when(kind == of, value), ignorenulls=True).over(so_far)
    config = F.col("r.data.header.config")
    rows = lines.withColumns({
        "_n": F.row_number().over(file), "kind": kind, "s": carried("session", F.struct(_some("r.id").alias("id"), _some("r.cwd").alias("cwd"), F.col("r.version").alias("version"), F.coalesce(F.col("r.isSeeded") & F.col("r.version").isin(3, 4), F.lit(False)).alias("seeded"), F.greatest(F.col("r.seedLength"), F.lit(0)).alias("seed"))),
        "q": carried("request/header", F.struct(_some(config["provider"]).alias("provider"), _some(config["model"]).alias("model"))),
    })
    mark = F.coalesce((F.col("kind") == "session/end-seed") & F.col("s.seeded") & F.col("r.data.inherited"), F.lit(False))
    rows = rows.withColumns({"border": F.max(F.when(mark, F.struct("_n", F.col("r.seq").alias("seq")))).over(whole), "bad": F.bool_or(mark & (F.coalesce(F.col("r.seq"), F.lit(-1)) < 0)).over(whole), "lost": F.max_by(F.col("s.seeded"), F.col("_n")).over(whole)})
    rows = rows.where("not bad and not (coalesce(lost, false) and border is null) and (border is null or _n > border._n)")
    usages = F.transform(F.filter("r.data.stream", lambda x: (x["type"] == "chunk") & (x["chunk"]["type"] == "usage")), lambda x: x["chunk"]["usage"])
    rows = rows.withColumn("u", F.coalesce("r.data.usage", F.try_element_at(usages, F.lit(-1))))
    n = {c: F.coalesce(F.col(f"u.{c}"), F.lit(0)) for c in ("inputTokens", "outputTokens", "cacheReadTokens", "cacheWriteTokens", "reasoningTokens")}
    real = lambda c: F.when(~(F.lower(c).eqNullSafe("unknown") | (c.startswith("<") & c.endswith(">"))), c)
    source = F.col("r.data.message.source")
    seed = F.coalesce(F.col("border.seq"), F.col("s.seed"), F.lit(0))
    counted = F.col("kind").isin("assistant/message", "assistant/attempt", "compaction/summary") & F.col("u").isNotNull() & (F.least(*n.values()) >= 0) & (F.greatest(*n.values()) > 0) & ~F.coalesce((seed > 0) & (F.col("r.seq") < seed), F.lit(False))
    rows = rows.withColumns({
        "counted": counted, "summary": F.col("kind") == "compaction/summary", "turn": F.col("r.data.turn"), "step": F.col("r.data.step"), "retry": F.col("kind") == "llm/retry-started",
        "model_id": F.coalesce(_some(source["replayState"]["response"]["responseModel"]), _some(source["model"]), "q.model"), "provider_id": F.coalesce(real(_some(source["provider"])), real(F.col("q.provider"))),
        "session_id": F.coalesce("s.id", _some(F.regexp_extract("input_path", FOLDER, 1))), "timestamp_ms": F.when(F.col("r.time") > 0, F.col("r.time")),
        "tok_input": n["inputTokens"], "tok_output": F.greatest(n["outputTokens"] - n["reasoningTokens"], F.lit(0)), "tok_cache_read": n["cacheReadTokens"], "tok_cache_write": n["cacheWriteTokens"], "tok_reasoning": n["reasoningTokens"],
    })
    # Retries of the same step so far tell one attempt from the next.
    rows = rows.withColumn("attempt", F.sum(F.col("retry").cast("int")).over(Window.partitionBy("folder", "input_path", "turn", "step").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)))
    asked = F.sum((F.col("kind") == "user/message").cast("int")).over(so_far)
    rows = rows.withColumn("asked", F.coalesce(asked, F.lit(0))).where("counted")
    fit = F.col("model_id").isNotNull() & F.col("timestamp_ms").isNotNull() & F.col("session_id").isNotNull()
    identity = F.coalesce(F.concat(F.lit("msg:"), _some("r.data.message.id")), F.concat(F.lit("seq:"), F.col("r.seq").cast("string")), F.concat(F.lit("sid:"), "session_id"))
    key = F.concat_ws(":", F.lit("dsh"), F.when(F.col("summary"), "summary"), identity, "timestamp_ms", F.coalesce("provider_id", F.lit("")), "model_id", *TOKENS)
    rows = rows.withColumns({"fit": fit, "dedup_key": F.when(fit, key)})
    again = F.row_number().over(Window.partitionBy("folder", "input_path", "dedup_key").orderBy(*PLACE)) > 1
    rows = rows.withColumn("again", again).where("not (fit and again)").drop("again")
    steps = F.col("fit") & ~F.col("summary") & F.col("s.version").isin(3, 4) & F.col("turn").isNotNull() & F.col("step").isNotNull()
    rows = rows.withColumn("settles", F.coalesce(steps, F.lit(False)))
    own = Window.partitionBy("folder", "input_path", "settles").orderBy(*PLACE)
    same = F.lag(F.struct("turn", "step", "attempt")).over(own).eqNullSafe(F.struct("turn", "step", "attempt")) & F.col("settles")
    # A record starts its turn if it is its turn's first, or without a turn the first since a message of the user.
    plain = F.col("fit") & ~F.col("summary")
    opens = F.row_number().over(Window.partitionBy("folder", "input_path", "turn", plain).orderBy(*PLACE)) == 1
    taken = F.lag("asked", 1, 0).over(Window.partitionBy("folder", "input_path", F.col("turn").isNull() & plain).orderBy(*PLACE)) < F.col("asked")
    rows = rows.withColumns({"is_turn_start": plain & F.when(F.col("turn").isNotNull(), opens).otherwise(taken), "island": F.sum((~same).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))})
    island = Window.partitionBy("folder", "input_path", "settles", "island")
    rows = rows.withColumns({"is_turn_start": F.min_by("is_turn_start", "_n").over(island), "input_seq": F.min("_n").over(island), "last": F.max("_n").over(island)}).where("_n = last")
    rows = normalize_workspace(rows.withColumn("_cwd", F.col("s.cwd")), "_cwd")
    return _records(rows, "dsh", ["workspace_key", "is_turn_start"])


GROK_COUNTS = ("inputTokens", "outputTokens", "cachedReadTokens", "cachedWriteTokens", "reasoningTokens")
_GROK = ", ".join(f"{c}:bigint" for c in (*GROK_COUNTS, "totalTokens", "modelCalls"))
GROK = f"struct<{_GROK}, modelUsage:map<string, struct<{_GROK}>>>"
#: Where a line of grok's says a thing, the first place that does counts.
GROK_PLACES = {
    "model": ["params.update._meta.modelId", "params._meta.modelId", "params.modelId", "model_id", "modelId", "model"],
    "session": ["params.sessionId", "params.session_id", "sessionId", "session_id"],
    "prompt": ["params.update.promptId", "params.update.prompt_id", "params._meta.promptId", "params._meta.prompt_id"],
    "total": ["params._meta.totalTokens", "params.update._meta.totalTokens", "params.update.totalTokens", "params.totalTokens", "usage.totalTokens", "totalTokens"],
    "time": ["params._meta.agentTimestampMs", "params.update._meta.agentTimestampMs", "params.timestamp", "timestamp", "ts"],
}


def _grok_detail(u: Column) -> Column:
    """Disjoint buckets of a turn's or a model's counters, and whether they can be right."""
    inp, out, read, write, think = (F.coalesce(u[c], F.lit(0)) for c in GROK_COUNTS)
    r = F.least(think, out)
    fit = (F.least(inp, out, read, write, think) >= 0) & (F.coalesce(u["modelCalls"], F.lit(1)) > 0) & (F.coalesce(u["totalTokens"], inp + out) == inp + out) & (read + write <= inp)
    return F.struct((inp - read - write).alias("tok_input"), (out - r).alias("tok_output"), read.alias("tok_cache_read"), write.alias("tok_cache_write"), r.alias("tok_reasoning"), u["modelCalls"].alias("calls"), fit.alias("fit"))


def read_grok(spark: SparkSession, root: str) -> DataFrame:
    """Completed turns with their counters by model, and for turns without one what the running total grew by, split by
    the usual shares over all such turns of a file.

    A turn begins with a message of the user; before the first, where the total grows.  Totals that fall back are
    passed over.  Of a prompt's completions the largest counts, the later one of equals.  A completion that can't be
    right covers its turn without a record.  A line that can't be read, or tells of a state without a time, ends the
    file.  If no turn grows and none is completed, the total itself is a record.  Files beside the updates aren't read."""
    import pandas as pd

    from ..functions.imputation import SHARES, allocate_batch

    lines = ordered_lines(spark, root, "updates.jsonl").withColumn("v", F.try_parse_json("value"))
    text = lambda p: F.try_variant_get("v", f"$.{p}", "string")
    said = {c: F.coalesce(*[_some(text(p)) for p in GROK_PLACES[c]]) for c in ("model", "session", "prompt", "total")} | {"time": F.coalesce(*[decode_timestamp(text(p)) for p in GROK_PLACES["time"]])}
    file = Window.partitionBy("input_path").orderBy(*PLACE)
    rows = lines.select("input_path", *PLACE, F.col("v").isNull().alias("damaged"), text("params.update.sessionUpdate").alias("kind"), F.from_json(F.to_json(F.try_variant_get("v", "$.params.update.usage", "variant")), GROK).alias("u"), *[c.alias(n) for n, c in said.items()])
    rows = rows.withColumns({"_n": F.row_number().over(file), "raw": F.col("total"), "total": F.col("total").try_cast("bigint"), "done": F.coalesce((F.col("kind") == "turn_completed") & F.col("u").isNotNull(), F.lit(False)), "asks": F.coalesce(F.col("kind") == "user_message_chunk", F.lit(False))})
    parts = F.array_sort(F.transform(F.map_entries("u.modelUsage"), lambda e: F.struct(F.trim(e["key"]).alias("model"), _grok_detail(e["value"]).alias("d"))))
    rows = rows.withColumns({"parts": F.when(F.col("done") & (F.size("u.modelUsage") > 0), parts), "top": F.when(F.col("done"), _grok_detail(F.col("u")))})
    added = lambda *names: F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, e: a + sum((e["d"][n] for n in names[1:]), e["d"][names[0]]))
    whole = {"inputTokens": added("tok_input", "tok_cache_read", "tok_cache_write"), "outputTokens": added("tok_output", "tok_reasoning"), "cachedReadTokens": added("tok_cache_read"), "cachedWriteTokens": added("tok_cache_write"), "totalTokens": added(*TOKENS)}
    agrees = F.col("u.reasoningTokens").isNull() | (F.least("u.reasoningTokens", whole["outputTokens"]) == added("tok_reasoning"))
    for name, value in whole.items():
        agrees = agrees & (F.coalesce(F.col(f"u.{name}"), value) == value)
    calls = F.when(F.forall("parts", lambda e: e["d"]["calls"].isNotNull()), F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, e: a + e["d"]["calls"]))
    agrees = agrees & F.forall("parts", lambda e: e["d"]["fit"] & ((e["model"] != "") | (sum((e["d"][c] for c in TOKENS[1:]), e["d"]["tok_input"]) == 0))) & (F.coalesce("u.modelCalls", F.lit(1)) > 0) & (F.coalesce(F.col("u.modelCalls") == calls, F.lit(True)))
    size = F.when(F.col("parts").isNotNull(), whole["totalTokens"]).otherwise(sum((F.col(f"top.{c}") for c in TOKENS[1:]), F.col("top.tok_input")))
    so_far, before = file.rowsBetween(Window.unboundedPreceding, 0), file.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"sound": F.col("done") & F.when(F.col("parts").isNotNull(), agrees).otherwise(F.col("top.fit")), "size": size})
    rows = rows.withColumns({"bears": (F.col("asks") | F.col("raw").isNotNull() | (F.col("sound") & (F.col("size") > 0))) & (F.col("sound") | ~F.col("done"))})
    known = F.last(F.when(F.col("bears"), F.col("model")), ignorenulls=True)
    nameless = F.col("sound") & F.col("parts").isNull() & (F.col("size") > 0) & F.coalesce("model", known.over(before)).isNull()
    rows = rows.withColumn("nameless", nameless).withColumns({"bears": F.col("bears") & ~F.col("nameless"), "wrong": F.col("done") & (~F.col("sound") | F.col("nameless"))})
    ends = F.col("damaged") | (~F.col("wrong") & F.col("raw").isNotNull() & F.col("total").isNull()) | (F.col("bears") & (F.col("time").isNull() | F.coalesce(F.col("total") < 0, F.lit(False))))
    rows = rows.withColumn("ended", F.max(ends.cast("int")).over(so_far) > 0).withColumn("cut", F.max(F.col("ended").cast("int")).over(Window.partitionBy("input_path")) > 0).where("not ended and (bears or wrong)")
    counted = F.when(F.col("bears"), F.col("total"))
    rows = rows.withColumns({"model": F.last(F.when(F.col("bears"), F.col("model")), ignorenulls=True).over(so_far), "session": F.coalesce(F.when(F.col("wrong"), F.col("session")), F.last(F.when(F.col("bears"), F.col("session")), ignorenulls=True).over(so_far)), "high": F.max(counted).over(before), "turn": F.sum(F.col("asks").cast("int")).over(so_far)})
    rows = rows.withColumns({"grows": F.coalesce(counted > F.col("high"), F.col("high").isNull() & counted.isNotNull() & (counted > 0) & (F.col("turn") > 0), F.lit(False)), "holds": F.coalesce(counted >= F.coalesce("high", F.lit(0)), F.lit(False)), "completes": F.col("sound") & (F.col("size") > 0) & F.col("bears")})
    active = (F.col("turn") > 0) | (F.coalesce(F.sum(F.col("grows").cast("int")).over(before), F.lit(0)) > 0)
    one = Window.partitionBy("input_path", "session", F.coalesce("prompt", F.concat(F.lit("line-"), "_n"))).orderBy("_n")
    seen = F.coalesce(F.sum(F.col("completes").cast("int")).over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    rows = rows.withColumn("covers", (F.col("completes") | F.col("wrong")) & ~seen & active)
    decoded = lambda c: F.try_url_decode(F.regexp_replace(c, r"\+", "%2B"))
    folder = decoded(decoded(F.regexp_extract("input_path", "([^/]+)/[^/]+/[^/]+$", 1)))  # by the path, and by the client

    finished = rows.where("completes").withColumn("key", F.coalesce("prompt", F.concat(F.lit("line-"), "_n")))
    finished = finished.groupBy("input_path", "session", "key").agg(F.max_by(F.struct("_n", "time", "parts", "top", "model", F.col("u.modelCalls").alias("all_calls")), F.struct("size", "_n")).alias("c"))
    details = F.coalesce(F.filter("c.parts", lambda e: sum((e["d"][c] for c in TOKENS[1:]), e["d"]["tok_input"]) > 0), F.array(F.struct(F.col("c.model").alias("model"), F.col("c.top").alias("d"))))
    finished = finished.withColumn("alone", F.coalesce(F.size("c.parts") == 1, F.lit(True))).select("input_path", "session", "key", "c", "alone", F.posexplode(details).alias("_i", "e"))
    finished = finished.select(
        "input_path", F.col("session").alias("session_id"), F.col("e.model").alias("model_id"), F.col("c.time").alias("timestamp_ms"), *[F.col(f"e.d.{c}").alias(c) for c in TOKENS], (F.col("_i") == 0).alias("is_turn_start"),
        F.coalesce("e.d.calls", F.when(F.col("alone"), F.col("c.all_calls")), F.lit(0)).cast("int").alias("message_count"), F.concat_ws(":", F.lit("grok"), "session", "key", "e.model").alias("dedup_key"), (F.col("c._n") * 4294967296 + F.col("_i")).alias("input_seq"))

    high = F.greatest(F.coalesce(F.max(counted), F.lit(0)), F.coalesce(F.min_by("high", "_n"), F.lit(0)))
    base = F.when(F.col("turn") > 0, F.coalesce(F.min_by("high", "_n"), F.lit(0))).otherwise(F.min_by(counted, F.when(counted.isNotNull(), F.col("_n"))))
    model = F.when(F.col("turn") > 0, F.min_by("model", F.when(F.col("model").isNotNull(), F.col("_n")))).otherwise(F.min_by("model", F.when(F.col("grows"), F.col("_n"))))
    turns = rows.groupBy("input_path", "turn").agg(
        (high - base).alias("delta"), model.alias("model_id"), F.max_by("time", F.when(F.col("grows"), F.col("_n"))).alias("timestamp_ms"), F.bool_or("covers").alias("covered"), F.max("_n").alias("_n"), F.bool_or(F.col("completes") | F.col("wrong")).alias("told"),
        high.alias("high"), F.max_by("time", F.when(F.col("holds"), F.col("_n"))).alias("held"), F.max_by("model", "_n").alias("latest"), F.max_by("session", "_n").alias("session"), F.bool_or("cut").alias("cut"))
    all_turns = Window.partitionBy("input_path")
    turns = turns.withColumns({
        "session_id": F.last("session", ignorenulls=True).over(all_turns.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "grew": F.max("delta").over(all_turns), "told": F.bool_or("told").over(all_turns),
        "index": F.col("turn") - 1 + F.max(F.when((F.col("turn") == 0) & (F.col("delta") > 0), 1).otherwise(0)).over(all_turns), "last": F.max("turn").over(all_turns),
    })
    only = ~F.col("told") & ~F.col("cut") & (F.coalesce("grew", F.lit(0)) <= 0) & (F.col("turn") == F.col("last")) & (F.col("high") > 0)
    pending = (F.col("delta") > 0) & ~F.col("covered") & ~(F.col("cut") & (F.col("turn") == F.col("last")))
    turns = turns.withColumn("only", only).where(pending | only).select(
        "input_path", "session_id", F.when(F.col("only"), F.col("latest")).otherwise(F.col("model_id")).alias("model_id"), F.when(F.col("only"), F.col("held")).otherwise(F.col("timestamp_ms")).alias("timestamp_ms"), F.when(F.col("only"), F.col("high")).otherwise(F.col("delta")).alias("delta"),
        F.concat_ws(":", F.lit("grok"), "session_id", F.when(F.col("only"), 0).otherwise(F.col("index"))).alias("dedup_key"), (F.col("_n") * 4294967296).alias("input_seq"))

    def split(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("input_seq")
        shares = pd.DataFrame(allocate_batch([int(x) for x in group["delta"]], SHARES), columns=TOKENS, index=group.index)
        return pd.concat([group.drop(columns="delta"), shares], axis=1)

    schema = "input_path string, session_id string, model_id string, timestamp_ms bigint, dedup_key string, input_seq bigint, " + ", ".join(f"{c} bigint" for c in TOKENS)
    grown = turns.groupBy("input_path").applyInPandas(split, schema).withColumns({"is_turn_start": F.lit(True), "message_count": F.lit(1)})
    made = finished.unionByName(grown).withColumns({"provider_id": F.lit("xai"), "client": F.lit("grok")})
    made = normalize_workspace(made.withColumn("_folder", folder), "_folder")
    return made.select(*[F.col(c).cast("bigint") if c in (*TOKENS, "timestamp_ms", "input_seq") else F.col(c) for c in COLUMNS], "workspace_key", "is_turn_start")
