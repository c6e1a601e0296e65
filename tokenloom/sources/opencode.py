"""opencode's databases: two message tables, of which a file may have either or both, joined to their sessions.

A row that is damaged is left out alone.  Rows that say the same of the same moment, and don't differ in the
message's own id, are one record; if their workspaces differ it has none."""
from __future__ import annotations

import json
import re
import sqlite3

#: Message table -> tables that may hold its sessions, the first one there counts.
TABLES = {"session_message": ("session_v2", "session"), "message": ("session",)}


def workspace_key(root: str | None) -> str | None:
    raw = (root or "").strip()
    least = 2 if raw.startswith(("\\\\", "//")) else 1
    key = re.sub("/+", "/", raw.replace("\\", "/"))
    key = "/" + key if least == 2 else key
    if re.match("[a-z]:/", key):
        key = key[0].upper() + key[1:]
    return (key.rstrip("/") if len(key) > least else key) or None


def queries(db: sqlite3.Connection) -> dict[str, str]:
    """Message table -> its query: id, session, data, directory and parent of the session, type."""
    tables = {name for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    out = {}
    for table, holders in TABLES.items():
        if table in tables:
            holder = next((h for h in holders if h in tables), None)
            columns = {r[1] for r in db.execute(f"PRAGMA table_info({holder})")} if holder else set()
            if holder and not {"id", "directory"} <= columns:  # SQLite would read "directory" as a text
                raise ValueError(f"opencode table {holder} has no id or directory")
            found = f"nullif(s.directory, ''), {'s.parent_id' if 'parent_id' in columns else 'NULL'}" if holder else "NULL, NULL"
            join = f"LEFT JOIN {holder} s ON s.id = m.session_id" if holder else ""
            out[table] = f"SELECT m.id, m.session_id, m.data, {found}, {'m.type' if table == 'session_message' else 'NULL'} FROM {table} m {join} ORDER BY m.id, m.session_id"
    if not out:
        raise ValueError("opencode database has neither message nor session_message")
    return out


def _text(value: object) -> str | None:
    if value is not None and not isinstance(value, str):
        raise ValueError(value)
    return value


def _whole(value: object) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not 0 <= value < 2**63:
        raise ValueError(value)
    return value


def decoded(row: tuple, table: str) -> tuple | None:
    """(own id, fingerprint, record, workspace key) of a row; None if it has no usage; an exception if it is damaged."""
    row_id, session, data, directory, parent, kind = row
    if table == "session_message" and _text(kind) != "assistant":
        if kind is None:
            raise ValueError(row_id)
        return None
    m = json.loads(_text(data))
    role = _text(m.get("role"))
    if table == "message" and role is None or table == "session_message" and role not in (None, "assistant"):
        raise ValueError(role)
    if role not in (None, "assistant"):
        return None
    if m["tokens"] is None:
        return None
    t, cache, model, time = m["tokens"], m["tokens"]["cache"], m.get("model") or {}, m["time"]
    tokens = (_whole(t["input"]), _whole(t["output"]), _whole(cache["read"]), _whole(cache["write"]), _whole(0 if t.get("reasoning") is None else t["reasoning"]))
    if not _whole(sum(tokens)):
        return None
    own = _text(m.get("id"))
    model_id, provider = (_text(m[a] if m.get(a) is not None else model.get(b)) for a, b in (("modelID", "id"), ("providerID", "providerID")))
    created = time["created"]
    if isinstance(created, bool) or created != int(created) or not 0 < created < 2**63:
        raise ValueError(created)
    if not all(_text(x) and x.strip() for x in (row_id, session, model_id)) or own is not None and not own.strip():
        raise ValueError(row_id)
    agent = next((x.strip() for x in (_text(m.get("mode")), _text(m.get("agent"))) if x and x.strip()), None)
    path = m.get("path")
    inside = path.get("root") if isinstance(path, dict) and isinstance(path.get("root"), str) else None
    root = directory if (_text(directory) or "").strip() else inside
    record = [model_id, provider, session, int(created), *tokens, own if own is not None else row_id]
    return own, (int(created), time.get("completed"), model_id, provider, tokens, agent), [*record, None, not (_text(parent) or "").strip()], workspace_key(root)


def records(db: sqlite3.Connection) -> list[tuple]:
    """model, provider, session, time, the five counters, dedup key, workspace key, and whether the session has no
    parent, for each record of both tables."""
    seen: dict[tuple, list[dict]] = {}
    out: list[dict] = []
    for table, sql in queries(db).items():
        for row in db.execute(sql):
            try:
                made = decoded(row, table)
            except (ValueError, TypeError, KeyError, AttributeError, OverflowError):
                continue
            if made is None:
                continue
            own, fingerprint, record, workspace = made
            same = seen.setdefault(fingerprint, [])
            old = next((x for x in same if own is None or x["own"] is None or x["own"] == own), None)
            if old is None:
                old = {"own": own, "record": record, "workspaces": set()}
                same.append(old), out.append(old)
            elif old["own"] is None and own is not None:
                old["own"], old["record"][9] = own, record[9]
            if workspace:
                old["workspaces"].add(workspace)
    return [(*x["record"][:10], next(iter(x["workspaces"])) if len(x["workspaces"]) == 1 else None, x["record"][11]) for x in out]
