import json
import sqlite3

from pyspark.sql import functions as F

from tokenloom.plans.queries import PRICE_COLUMNS
from tokenloom.sources import artifacts, catalogs, readers
from tokenloom.streaming import incremental


def test_json_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    good = {"type": "assistant", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "requestId": "q", "message": {"id": "m", "model": "claude-x", "usage": {"input_tokens": 3, "output_tokens": 4, "cache_read_input_tokens": 5}}}
    other = {**good, "message": {**good["message"], "model": "<synthetic>"}}
    (tmp_path / "a/x.jsonl").write_text("\n".join([json.dumps(good), "{broken", json.dumps(other), json.dumps({"type": "user"})]))
    rows = readers.read_lines(spark, "claude", str(tmp_path)).collect()
    assert [(r["model_id"], r["tok_input"], r["tok_output"], r["tok_cache_read"], r["tok_cache_write"], r["timestamp_ms"], r["dedup_key"]) for r in rows] == [("claude-x", 3, 4, 5, 0, 1704067200000, "m:q")]


def test_qwen_thoughts_inside_candidates(spark, tmp_path):
    u = {"promptTokenCount": 10, "candidatesTokenCount": 6, "thoughtsTokenCount": 2, "cachedContentTokenCount": 4, "totalTokenCount": 16}
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"type": "assistant", "model": "qwen3", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "usageMetadata": x}) for x in (u, {**u, "totalTokenCount": 18})))
    rows = readers.read_lines(spark, "qwen", str(tmp_path)).orderBy("input_seq").collect()
    assert [(r["tok_input"], r["tok_output"], r["tok_cache_read"], r["tok_reasoning"]) for r in rows] == [(6, 4, 4, 2), (6, 6, 4, 2)]


def test_database_joins_and_leaves_no_session_out(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "h.db")
    db.execute("CREATE TABLE sessions (id TEXT, model TEXT, billing_provider TEXT, started_at REAL, input_tokens INT, output_tokens INT, cache_read_tokens INT, cache_write_tokens INT, reasoning_tokens INT)")
    db.execute("CREATE TABLE session_model_usage (session_id TEXT, model TEXT, billing_provider TEXT, input_tokens INT, output_tokens INT, cache_read_tokens INT, cache_write_tokens INT, reasoning_tokens INT)")
    db.execute("INSERT INTO sessions VALUES ('a', 'm', 'p', 1.5, 9, 9, 0, 0, 0), ('b', 'n', NULL, 2, 7, 5, 1, 2, 8)")
    db.execute("INSERT INTO session_model_usage VALUES ('a', 'm1', NULL, 4, 6, 0, 0, 2)")
    db.commit(), db.close()
    rows = readers.read_all(spark, {"hermes": str(tmp_path)}).orderBy("session_id").collect()
    assert [(r["session_id"], r["model_id"], r["provider_id"], r["tok_input"], r["tok_output"], r["tok_reasoning"], r["timestamp_ms"]) for r in rows] == [("a", "m1", "p", 4, 4, 2, 1500), ("b", "n", None, 7, 0, 5, 2000)]


def test_opencode_has_two_tables_and_their_sessions(spark, tmp_path):
    def data(n, **more):
        return json.dumps({"role": "assistant", "modelID": "m", "providerID": "p", "time": {"created": 5}, "tokens": {"input": n, "output": 2, "reasoning": None, "cache": {"read": 3, "write": 4}}, **more})

    def put_db(name, *tables):
        with sqlite3.connect(tmp_path / name) as db:
            for table, columns, rows in tables:
                db.execute(f"CREATE TABLE {table} ({columns})")
                db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(columns.split(',')))})", rows)
        db.close()

    new = [("a", "s1", data(1, role=None), "assistant"), ("b", "s1", data(9), "user"), ("c", "s2", json.dumps({"model": {"id": "n", "providerID": "q"}, "time": {"created": 6.0}, "tokens": {"input": 2, "output": 0, "cache": {"read": 0, "write": 0}}}), "assistant"), ("d", "s1", "{damaged", "assistant")]
    old = [("x", "s1", data(1)), ("y", "s3", data(7, path={"root": "c:\\w\\"})), ("z", "s3", data(8, role="user")), ("zz", "s3", data(8, tokens=None)), ("zy", "s3", data(-8)), ("zx", "s3", data(8, time=None))]
    put_db("both.db", ("session_message", "id TEXT, session_id TEXT, data TEXT, type TEXT", new), ("message", "id TEXT, session_id TEXT, data TEXT", old), ("session_v2", "id TEXT, directory TEXT, parent_id TEXT", [("s1", "/w//v2/", None), ("s2", "", "s1")]), ("session", "id TEXT, directory TEXT", [("s1", "/other", )]))
    put_db("new.db", ("session_message", "id TEXT, session_id TEXT, data TEXT, type TEXT", [("n", "s", data(30), "assistant")]))
    put_db("old.db", ("message", "id TEXT, session_id TEXT, data TEXT", [("o", "s", data(40, id="own"))]))
    put(tmp_path / "dr", "q.settings.json", {"model": "m", "tokenUsage": {"inputTokens": 1}})
    rows = readers.read_all(spark, {"opencode": str(tmp_path), "droid": str(tmp_path / "dr")}).orderBy("client", "tok_input").collect()
    got = [tuple(r[c] for c in ("session_id", "model_id", "provider_id", "timestamp_ms", *readers.TOKENS, "dedup_key", "workspace_key", "is_main_session")) for r in rows if r["client"] == "opencode"]
    assert got == [
        ("s1", "m", "p", 5, 1, 2, 3, 4, 0, "a", None, True),  # in both tables, whose sessions name two workspaces
        ("s2", "n", "q", 6, 2, 0, 0, 0, 0, "c", None, False), ("s3", "m", "p", 5, 7, 2, 3, 4, 0, "y", "C:/w", True),
        ("s", "m", "p", 5, 30, 2, 3, 4, 0, "n", None, True), ("s", "m", "p", 5, 40, 2, 3, 4, 0, "own", None, True),
    ]
    assert [(r["client"], r["workspace_key"], r["is_main_session"]) for r in rows][0] == ("droid", None, None)


def test_stream_dedup_and_hours(spark, tmp_path):
    rows = [(i, "c", f"2024-01-01 0{i % 3}:10:00", "k" if i < 2 else None, 1) for i in range(6)]
    df = spark.createDataFrame(rows, "input_seq bigint, client string, t string, dedup_key string, n bigint").select("input_seq", "client", F.col("t").cast("timestamp").alias("ts"), "dedup_key", *[F.col("n").alias(c) for c in readers.TOKENS])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = incremental.deduplicated(stream).writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("deduped").count() == 5
    assert incremental.hourly(df).agg(F.sum("records")).first()[0] == 6


def told(df):
    return [tuple(r[c] for c in ("session_id", "model_id", "provider_id", "timestamp_ms", *readers.TOKENS)) for r in df.orderBy("input_path", "input_seq").collect()]


def put(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))


def test_artifacts(spark, tmp_path):
    say = {"type": "say", "say": "api_req_started", "ts": 1704067200000, "modelInfo": {"providerId": "p", "modelId": "m"}}
    texts = [{"tokensIn": 10, "tokensOut": 2, "cacheReads": 3, "cacheWrites": 1}, {"tokensIn": 1, "tokensOut": 2, "cacheReads": 3}, {"tokensIn": 0}]
    put(tmp_path / "roo/t1", "ui_messages.json", [*({**say, "text": json.dumps(t)} for t in texts), {"type": "ask"}, {**say, "text": "no json"}])
    put(tmp_path / "roo/t2", "ui_messages.json", "{damaged")
    assert told(artifacts.read_artifacts(spark, "roocode", str(tmp_path / "roo"))) == [("t1", "m", "p", 1704067200000, 6, 2, 3, 1, 0)]
    put(tmp_path / "mux/s", "session-usage.json", {"byModel": {"a:m:1": {"input": {"tokens": 4}, "reasoning": {"tokens": 2}}, "n": {"output": {"tokens": 1}}, "z": {}}, "lastRequest": {"timestamp": 5}})
    assert sorted(told(artifacts.read_artifacts(spark, "mux", str(tmp_path / "mux")))) == [("s", "m:1", "a", 5, 4, 0, 0, 0, 2), ("s", "n", None, 5, 0, 1, 0, 0, 0)]
    entry = {"role": "assistant", "ts": 1704067200000, "metrics": {"inputTokens": 9, "outputTokens": 1, "cacheReadTokens": 4, "cacheWriteTokens": 5}, "modelInfo": {"id": "m"}}
    put(tmp_path / "cl", "x.messages.json", {"version": 1, "sessionId": "s", "messages": [{"role": "user"}, entry]})
    put(tmp_path / "cl", "y.messages.json", {"version": 2, "sessionId": "s", "messages": [entry]})
    assert told(artifacts.read_artifacts(spark, "cline", str(tmp_path / "cl"))) == [("s", "m", None, 1704067200000, 0, 1, 4, 5, 0)]
    put(tmp_path / "dr", "q.settings.json", {"model": "m", "providerLockTimestamp": "2024-01-01T00:00:00Z", "tokenUsage": {"inputTokens": 1, "thinkingTokens": 2}})
    assert told(artifacts.read_artifacts(spark, "droid", str(tmp_path / "dr"))) == [("q", "m", None, 1704067200000, 1, 0, 0, 0, 2)]


def test_openclaw_carries_the_model(spark, tmp_path):
    def message(**more):
        return json.dumps({"type": "message", "message": {"role": "assistant", "timestamp": 7, "usage": {"input": 1}, **more}})

    lines = [message(), json.dumps({"type": "model_change", "modelId": "a", "provider": "p"}), message(), message(model="b"), message(), message(provider="q"), "{damaged", message(), json.dumps({"type": "custom", "customType": "model-snapshot", "data": {"modelId": "c", "provider": "r"}}), message(timestamp=0), message()]
    put(tmp_path, "s.jsonl", "\n".join(lines))
    assert [(r[1], r[2]) for r in told(artifacts.read_openclaw(spark, str(tmp_path)))] == [(None, None), ("a", "p"), ("b", None), ("b", None), ("b", "q"), (None, None), ("c", "r")]


def test_catalogs(spark, tmp_path):
    put(tmp_path, "l.json", {"P1/M0": {"input_cost_per_token": 1e-6, "output_cost_per_token": "x", "mode": "chat"}, "github_copilot/m": {"input_cost_per_token": 1}})
    put(tmp_path, "o.json", {"data": [{"id": "p/m", "pricing": {"prompt": "0.5", "completion": "-1"}}, {"id": "p/any", "pricing": {"prompt": "-1", "completion": "-1"}}]})
    put(tmp_path, "d.json", {"P": {"models": {"M": {"cost": {"input": 3, "output": 6}}, "N": {"cost": {"input": 3}}, "O": {}}}})
    found = [catalogs.litellm(spark, str(tmp_path / "l.json")), catalogs.openrouter(spark, str(tmp_path / "o.json")), catalogs.models_dev(spark, str(tmp_path / "d.json"))]
    assert [tuple(r[c] for c in ("key", "model", "owner", "input", "output")) for df in found for r in df.collect()] == [("p1/m0", "m0", "p1", 1e-6, None), ("p/m", "m", "p", 0.5, None), ("p/m", "m", "p", 3e-6, 6e-6)]
    assert found[0].unionByName(found[1]).unionByName(found[2]).columns == PRICE_COLUMNS


def test_all_clients_in_one_frame(spark, tmp_path):
    put(tmp_path / "dr", "q.settings.json", {"model": "m", "tokenUsage": {"inputTokens": 1}})
    put(tmp_path / "oc", "s.jsonl", json.dumps({"type": "message", "message": {"role": "assistant", "model": "n", "timestamp": 7, "usage": {"input": 2}}}))
    rows = readers.read_all(spark, {"openclaw": str(tmp_path / "oc"), "droid": str(tmp_path / "dr")}).collect()
    assert sorted((r["client"], r["model_id"], r["tok_input"]) for r in rows) == [("droid", "m", 1), ("openclaw", "n", 2)]
