"""Clients that keep one JSON document per thread and whose records need the whole of it: amp and codebuff.

A document is decoded in Python by one task, so the largest bounds memory.  One that can't be decoded gives no rows;
an entry that can't be right (a negative count, a number that is none) is left out, as is one that counts nothing."""
from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.adapter import TOKENS
from .readers import COLUMNS

FIELDS = ["model_id", "provider_id", "session_id", "timestamp_ms", *TOKENS, "dedup_key"]
TOP = 2**63


def _dict(value: object) -> dict:
    return value if isinstance(value, dict) else {}


def _text(value: object) -> str | None:
    return value if isinstance(value, str) and value.strip() else None


def moment(value: object) -> int | None:
    """Epoch milliseconds of RFC 3339 text with a zone; none otherwise."""
    try:
        when = datetime.fromisoformat(value.strip())
        return math.floor(when.timestamp() * 1000 + 0.0005) if when.tzinfo else None
    except (AttributeError, TypeError, ValueError, OverflowError):
        return None


def millis(value: object) -> int | None:
    """As moment(), or of a whole number of seconds or milliseconds (from 1e12 on), also as text."""
    try:
        number = int(value) if isinstance(value, str) or type(value) is int else 0
    except ValueError:
        return moment(value)
    return None if not 0 < number < TOP // 1000 else number if number >= 10**12 else number * 1000


def _whole(value: object) -> int:
    """A count; an exception for what isn't one."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value < TOP or value != int(value):
        raise ValueError("not a count")
    return int(value)


#: amp's counters in a ledger, in a message.
AMP_LEDGER = ("input", "output", "cacheReadInputTokens", "cacheCreationInputTokens")
AMP_MESSAGE = ("inputTokens", "outputTokens", "cacheReadInputTokens", "cacheCreationInputTokens")


def _amp_entry(usage: object, names: tuple[str, ...], model: object) -> tuple[str, tuple[int, ...]] | None:
    try:
        counts = tuple(0 if _dict(usage).get(c) is None else _whole(usage[c]) for c in names)
    except ValueError:
        return None
    return (model, counts) if 0 < sum(counts) < TOP and _text(model) else None


def amp(thread: dict, path: str) -> Iterator[tuple]:
    """The ledger's events, and those messages that no event stands for, in order of time.

    A message is the event that names it, or else the next one, from the last match on and then from the start, with
    its model and counts; an event stands for one message.  A message's time is the thread's, and its id in seconds."""
    session = _text(thread.get("id"))
    if session is None:
        return
    events = []
    for e in _dict(thread.get("usageLedger")).get("events") or ():
        e = _dict(e)
        got, when = _amp_entry(e.get("tokens"), AMP_LEDGER, e.get("model")), moment(e.get("timestamp"))
        if got and when:
            events.append((when, got, e.get("toMessageId")))
    named: dict[int, list[int]] = {}
    alike: dict[tuple, list[int]] = {}
    for i, (_, got, to) in enumerate(events):
        alike.setdefault(got, []).append(i)
        if isinstance(to, int) and to > 0:
            named.setdefault(to, []).append(i)
    used, at, created, alone = set(), 0, thread.get("created"), []
    for m in thread.get("messages") or ():
        m, usage = _dict(m), _dict(_dict(m).get("usage"))
        got, number = _amp_entry(usage, AMP_MESSAGE, usage.get("model")), m.get("messageId")
        if m.get("role") != "assistant" or not got or not isinstance(number, int) or number <= 0 or not isinstance(created, int) or created <= 0:
            continue
        free = [i for i in named.get(number, ()) if i not in used] or [i for i in alike.get(got, ()) if i not in used]
        if free:
            i = next((i for i in free if i >= at), free[0])
            used.add(i)
            at = i + 1
        elif created + number * 1000 < TOP:
            alone.append((created + number * 1000, got, None))
    for when, (model, counts), _ in sorted(events + alone, key=lambda x: x[0]):
        yield (model, None, session, when, *counts, 0, None)


#: Spellings of codebuff's counters; the first present counts.
CODEBUFF = (
    ("inputTokens", "input_tokens", "promptTokens", "prompt_tokens"), ("outputTokens", "output_tokens", "completionTokens", "completion_tokens"),
    ("cacheReadInputTokens", "cache_read_input_tokens", "cachedTokensCreated", "cached_tokens_created"),
    ("cacheCreationInputTokens", "cache_creation_input_tokens", "cacheCreationTokens", "cache_creation_tokens"),
)


def _picked(value: dict, names: tuple[str, ...]) -> int | None:
    found = [_whole(value[n]) for n in names if n in value]
    return found[0] if found else None


def _codebuff_usage(value: object) -> tuple[list[int], str | None] | None:
    value = _dict(value)
    try:
        counts = [_picked(value, names) for names in CODEBUFF]
        if counts[2] is None:
            counts[2] = _picked(_dict(value.get("promptTokensDetails", value.get("prompt_tokens_details"))), ("cachedTokens", "cached_tokens"))
    except ValueError:
        return None
    return [c or 0 for c in counts], value["model"] if isinstance(value.get("model"), str) else None


def _filled(parts: list[tuple[list[int], str | None]]) -> tuple[list[int], str | None]:
    """Each counter from the first part where it isn't zero, the model from the first that names one."""
    counts = [next((c for c in column if c), 0) for column in zip(*(counts for counts, _ in parts), strict=True)] or [0] * 4
    return counts, next((model for _, model in parts if model is not None), None)


def _codebuff_found(meta: dict) -> tuple[list[int], str | None]:
    parts = [([0] * 4, meta["model"] if isinstance(meta.get("model"), str) else None)]
    parts += [_codebuff_usage(u) for u in (meta.get("usage"), _dict(meta.get("codebuff")).get("usage")) if u is not None]
    state = meta
    for name in ("runState", "sessionState", "mainAgentState"):
        state = _dict(state.get(name))
    history = state.get("messageHistory")
    for entry in reversed(history if isinstance(history, list) else []):
        options = _dict(_dict(entry).get("providerOptions"))
        if _dict(entry).get("role") == "assistant":
            own = _dict(options.get("codebuff"))
            named = [([0] * 4, own["model"])] if isinstance(own.get("model"), str) else []
            parts += [*named, *(_codebuff_usage(u) for u in (options.get("usage"), own.get("usage")) if u is not None)]
    return _filled([p for p in parts if p is not None])


def codebuff(messages: list, path: str) -> Iterator[tuple]:
    """Usage of assistant messages from their metadata, each counter from the first place that has it.  The session is
    channel, project and chat, and the chat's name is the time of messages that have none."""
    channel, chat = path.split("/")[-6:-5], path.split("/")[-2]
    session = f"{''.join(channel)}/{path.split('/')[-4]}/{chat}" if channel else None
    named = millis(re.sub(r"T(\d+)-(\d+)-", r"T\1:\2:", chat))
    for i, m in enumerate(messages):
        m = _dict(m)
        meta = _dict(m.get("metadata"))
        kind = next((m[c] for c in ("variant", "role") if isinstance(m.get(c), str)), "")
        if kind not in ("ai", "agent", "assistant"):
            continue
        counts, model = _codebuff_found(meta)
        if not 0 < sum(counts) < TOP:
            continue
        when = next((t for t in map(millis, (m.get("timestamp"), m.get("createdAt"), meta.get("timestamp"), None)) if t), named)
        key = _text(m.get("id")) or ":".join(map(str, ("codebuff", session, when, model, i, *counts)))
        yield (model, None, session, when, *counts, 0, key)


#: Of a client: the documents' names, what they are, and their records.
THREADS: dict[str, tuple[str, type, Callable[..., Iterator[tuple]]]] = {"amp": ("T-*.json", dict, amp), "codebuff": ("chat-messages.json", list, codebuff)}


def read_threads(spark: SparkSession, client: str, root: str) -> DataFrame:
    """Records of a client that keeps a document per thread under root; input_seq is a record's place in its document."""
    import pyarrow as pa

    glob, shape, records = THREADS[client]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    value = json.loads(text)
                except ValueError:
                    continue
                rows = list(records(value, path)) if isinstance(value, shape) else []
                columns = list(zip(*rows, strict=True)) or [[]] * len(FIELDS)
                kinds = [pa.int64() if f in TOKENS or f == "timestamp_ms" else pa.string() for f in FIELDS]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64())], [*FIELDS, "input_path", "input_seq"])

    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("wholetext", True).text(root).select(F.col("_metadata.file_path"), "value")
    schema = ", ".join(f"{f} {'bigint' if f in TOKENS or f == 'timestamp_ms' else 'string'}" for f in FIELDS)
    return files.mapInArrow(run, f"{schema}, input_path string, input_seq bigint").withColumns({"client": F.lit(client), "message_count": F.lit(1)}).select(*COLUMNS)
