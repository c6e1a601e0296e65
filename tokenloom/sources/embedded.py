"""Rows of clients that keep their usage in SQLite and whose rows SQL alone can't settle.

Each function takes an open database and gives tuples of model, provider, session, time in milliseconds, the five
buckets, and a dedup key; a row that can't be right (a negative count, a damaged document) is left out."""
from __future__ import annotations

import json
import sqlite3
from datetime import datetime, timezone

from ..functions.imputation import SHARES, allocate_batch
from .opencode import workspace_key

#: The only owner whose threads zed itself bills.
HOSTED = "zed.dev"


def _columns(db: sqlite3.Connection, table: str) -> set[str]:
    return {row[1] for row in db.execute(f"PRAGMA table_info({table})")}


def hermes(db: sqlite3.Connection, per_model: str, per_session: str) -> list[tuple]:
    """Usage by model where sessions have it, and by session where they don't; old databases have sessions alone."""
    if _columns(db, "session_model_usage"):
        return db.execute(per_model).fetchall()
    return db.execute(per_session).fetchall()


def zcode(db: sqlite3.Connection) -> list[tuple]:
    """Rows in order of time.  A computed total tells whether input holds the caches and output the reasoning: it does
    if it is the sum of those two alone; tables without such a column always did."""
    told = "computed_total_tokens" in _columns(db, "model_usage")
    found = db.execute(f"""SELECT id, session_id, model_id, started_at, completed_at, duration_ms, input_tokens, output_tokens, reasoning_tokens, cache_read_input_tokens, cache_creation_input_tokens,
        {'computed_total_tokens' if told else 'NULL'} FROM model_usage ORDER BY coalesce(completed_at, started_at, 0), id""")
    out = []
    for key, session, model, began, ended, took, *counts, total in found:
        inp, outp, think, read, write = (c or 0 for c in counts)
        if min(inp, outp, think, read, write, total or 0, took or 0) < 0 or not key:
            continue
        both, everything = inp + outp, inp + outp + think + read + write
        if not told or total is not None and max(think, read, write) > 0 and total == both != everything:
            inp, outp = max(inp - read - write, 0), max(outp - think, 0)
        when = began if began and began > 0 else None
        if when is None and ended and ended > 0:
            when = ended - took if took and ended > took > 0 else ended
        if inp + outp + think + read + write:
            out.append((model, "zai", session, when, inp, outp, read, write, think, f"zcode-sqlite:{key}"))
    return out


def _zed_usage(value: dict) -> tuple[int, int, int, int]:
    found = tuple(int(value.get(c, 0)) for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"))
    if min(found) < 0:
        raise ValueError("a negative count")
    return found


def _millis(*texts: str | None) -> int | None:
    for text in texts:
        try:
            at = datetime.fromisoformat(text.replace("Z", "+00:00"))
        except (AttributeError, ValueError):
            continue
        return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)
    return None


def zed(db: sqlite3.Connection) -> list[tuple]:
    """A row per thread that zed served: the sum over its requests, or else the thread's running total."""
    import zstandard

    out = []
    for key, updated, created, kind, data in db.execute("SELECT id, updated_at, created_at, data_type, data FROM threads ORDER BY id"):
        try:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(data) if kind.strip().lower() == "zstd" else data
            thread = json.loads(raw)
            model = thread.get("model") or {}
            if thread.get("imported") or (model.get("provider") or "").strip().lower() != HOSTED:
                continue
            requests = thread.get("request_token_usage") or {}
            each = [_zed_usage(u) for u in (requests.values() if isinstance(requests, dict) else requests)]
            total = [sum(x) for x in zip(*each, strict=True)] if each else [0] * 4
            if not sum(total):
                total = _zed_usage(thread.get("cumulative_token_usage") or {})
        except (ValueError, TypeError, AttributeError, zstandard.ZstdError):
            continue
        if sum(total):
            out.append(((model.get("model") or "").strip(), HOSTED, key, _millis(created, updated, thread.get("updated_at")), *total, 0, f"zed:{key}"))
    return out


def _warp_time(text: object) -> int | None:
    """Epoch milliseconds; a time without a zone is UTC."""
    try:
        when = datetime.fromisoformat(text.strip())
    except (AttributeError, ValueError):
        return None
    made = (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp()
    return int(made * 1000 + 0.0005) if made > 0 else None


def _warp_total(item: dict) -> int:
    """Of the three counters that are there; an exception if one is no count."""
    found = [item[c] for c in ("warp_tokens", "byok_tokens", "custom_endpoint_tokens") if item.get(c) is not None]
    if any(type(n) is not int or n < 0 for n in found):
        raise ValueError("not a count")
    return sum(found)


def warp(db: sqlite3.Connection) -> list[tuple]:
    """A row per conversation and model, with the conversation's workspace after the dedup key.  Only totals are kept:
    all of a database are split at once, so that rows and buckets both add up."""
    places: dict[str, str] = {}
    if _columns(db, "ai_queries"):
        for talk, folder in db.execute("SELECT conversation_id, working_directory FROM ai_queries WHERE trim(conversation_id) <> '' ORDER BY conversation_id"):
            if talk not in places and isinstance(folder, str) and (key := workspace_key(folder)):
                places[talk] = key
    found, totals = [], []
    for talk, text, changed in db.execute("SELECT conversation_id, conversation_data, last_modified_at FROM agent_conversations WHERE trim(conversation_data) <> '' ORDER BY id"):
        talk, when = (talk or "").strip(), _warp_time(changed)
        try:
            usage = (json.loads(text).get("conversation_usage_metadata") or {}).get("token_usage") or []
        except (AttributeError, TypeError, ValueError):
            continue
        for i, item in enumerate(usage if talk and isinstance(usage, list) else []):
            try:
                total = _warp_total(item)
            except (AttributeError, ValueError):
                continue
            model = item.get("model_id")
            if total and (model is None or isinstance(model, str)):
                model = (model or "").strip() or None  # a missing one, or a missing time, is for the gate to name
                found.append((model, None, talk, when, f"warp:{talk}:{i}:{model}", places.get(talk)))
                totals.append(total if model and when else 0)
    split = allocate_batch(totals, SHARES)
    return [(*row[:4], *parts, row[4], row[5]) for row, parts in zip(found, split, strict=True)]
