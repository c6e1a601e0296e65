import datetime as dt
import json
import os
import sqlite3
import time

import pytest
import zstandard
from pyspark.sql import functions as F

from tokenloom.functions import calendar, providers
from tokenloom.operators import estimate, facts, lookup, quality, reports
from tokenloom.plans import answers, price_queries
from tokenloom.sources import readers, settings


def put(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(content if isinstance(content, str) else json.dumps(content))


def line(i, n, model="Claude-Opus-4-1", **more):
    return json.dumps({"type": "assistant", "sessionId": "s1", "timestamp": f"2024-01-0{1 + i % 3}T2{i % 4}:30:00Z", "requestId": f"q{i}", "message": {"id": f"m{i}", "model": model, "usage": {"input_tokens": n, "output_tokens": 2 * n}}, **more})


@pytest.fixture
def roots(tmp_path):
    put(f"{tmp_path}/claude/b/x.jsonl", "\n".join([line(0, 10), line(1, 20), line(0, 99), "{damaged", line(2, 30, "commandcode-model-unknown")]))
    put(f"{tmp_path}/claude/a/y.jsonl", "\n".join([line(1, 7), line(3, 1, sessionId=""), line(4, -5)]))
    put(f"{tmp_path}/gemini/tmp/p/chats/s.json", {"sessionId": "g", "messages": [{"id": "1", "timestamp": "2024-01-02T00:00:00Z", "model": "gemini-3", "tokens": {"input": 10, "output": 5, "cached": 4, "thoughts": 1, "tool": 2, "total": 18}}, {"id": "2", "timestamp": "2024-01-02T00:00:00Z", "model": "gemini-3", "tokens": {"input": 10, "output": 5, "cached": 4, "thoughts": 1, "tool": 2, "total": 22}}, {"id": "3"}]})
    put(f"{tmp_path}/gemini/tmp/p/other.json", {"sessionId": "no", "messages": [{"tokens": {"input": 9}}]})
    return {"claude": f"{tmp_path}/claude", "gemini": f"{tmp_path}/gemini"}


def test_files_to_answers(spark, roots):
    prices = price_queries.price_table(spark)
    rules = [("claude-opus-4-1", "claude-opus-4.1")]
    made = settings.Settings(machine_labels={f"{roots['claude']}/a": "laptop"}, zone="Asia/Shanghai")
    usage, rejected = answers.usage_from(spark, roots, made, rules, prices)
    rows = sorted((r["client"], r["tok_input"], r["tok_output"], r["tok_cache_read"], r["tok_reasoning"], r["model_id"], r["provider_id"], r["complete"]) for r in usage.collect())
    # of m1 the first in order of file stays; of m0 the first line
    assert rows == [("claude", 7, 14, 0, 0, "claude-opus-4.1", "anthropic", True), ("claude", 10, 20, 0, 0, "claude-opus-4.1", "anthropic", True), ("claude", 30, 60, 0, 0, "commandcode-model-unknown", "unknown", False), ("gemini", 8, 5, 4, 1, "gemini-3", "google", False), ("gemini", 12, 5, 4, 1, "gemini-3", "google", False)]
    assert sorted(r["reason"] for r in rejected.collect()) == ["invalid-usage", "missing-session"]
    costs = {r["tok_input"]: r["cost"] for r in usage.where("client = 'claude'").collect()}
    assert costs == pytest.approx({7: 7 * 15e-6 + 14 * 75e-6, 10: 10 * 15e-6 + 20 * 75e-6, 30: 0})
    models = {r["model_id"]: (r["tokens"], r["session_count"]) for r in facts.refold(facts.fine_models(usage), "model").collect()}
    assert models == {"claude-opus-4.1": (51, 1), "commandcode-model-unknown": (90, 1), "gemini-3": (18 + 22, 1)}
    assert {str(r["local_date"]) for r in facts.buckets(usage, "local_date").collect()} >= {"2024-01-02", "2024-01-03"}
    assert {r["machine"] for r in usage.select("machine").distinct().collect()} >= {"local"}
    only, _ = answers.usage_from(spark, roots, settings.Settings(clients=("gemini",)))
    assert only.count() == 2 and only.agg(F.sum("cost")).first()[0] == 0
    with pytest.raises(ValueError):
        answers.usage_from(spark, roots, settings.Settings(clients=("nobody",)))


def test_report_is_one_json_text(spark, roots):
    usage, rejected = answers.usage_from(spark, roots)
    models = facts.refold(facts.fine_models(usage), "workspace,model") if "workspace_key" in usage.columns else facts.refold(facts.fine_models(usage), "model")
    days = facts.buckets(usage, "local_date")
    health = rejected.groupBy("client", F.col("reason").alias("issue")).agg(F.count(F.lit(1)).alias("records"))
    got = json.loads(reports.models_report(models, "workspace,model", health, days=days, metadata={"processingTimeMs": "1"}).first()["value"])
    assert got["groupBy"] == "workspace,model" and got["metadata"] == {"processingTimeMs": "1"}
    assert got["totals"]["tokens"] == sum(m["tokens"]["total"] for m in got["models"]) == sum(d["tokens"]["total"] for d in got["daily"])
    assert {(h["client"], h["issue"], h["records"]) for h in got["health"]} == {("claude", "invalid-usage", 1), ("claude", "missing-session", 1)}
    assert [d["date"] for d in got["daily"]] == sorted(d["date"] for d in got["daily"])
    empty = json.loads(reports.models_report(models.limit(0), "model").first()["value"])
    assert empty["models"] == [] and empty["totals"] == {"tokens": 0, "cost": 0.0}


def test_embedded_databases(spark, tmp_path):
    cols = "id, session_id, turn_id, model_id, started_at, completed_at, duration_ms, input_tokens, output_tokens, reasoning_tokens, cache_read_input_tokens, cache_creation_input_tokens"
    for name, more, rows in (("new", ", computed_total_tokens", [("a", "s", "t", "glm", 5, None, None, 10, 8, 3, 4, 1, 18), ("b", "s", "t", "glm", None, 90, 30, 10, 8, 3, 4, 1, 26), ("c", "s", "t", "glm", 7, 9, 1, 0, 0, 0, 0, 0, 0), ("d", "s", "t", "glm", 7, 9, 1, -1, 0, 0, 0, 0, 0)]), ("old", "", [("a", "s", "t", "glm", 5, None, None, 10, 8, 3, 4, 1)])):
        os.makedirs(tmp_path / name)
        with sqlite3.connect(tmp_path / name / "z.db") as db:
            db.execute(f"CREATE TABLE model_usage ({cols}{more})")
            db.executemany(f"INSERT INTO model_usage VALUES ({', '.join('?' * len(rows[0]))})", rows)
        db.close()
    got = {name: [tuple(r[c] for c in ("timestamp_ms", *readers.TOKENS, "dedup_key")) for r in readers.read_databases(spark, "zcode", str(tmp_path / name)).orderBy("input_seq").collect()] for name in ("new", "old")}
    assert got == {"new": [(5, 5, 5, 4, 1, 3, "zcode-sqlite:a"), (60, 10, 8, 4, 1, 3, "zcode-sqlite:b")], "old": [(5, 5, 5, 4, 1, 3, "zcode-sqlite:a")]}
    def thread(**more):
        return json.dumps({"model": {"provider": "zed.dev", "model": "claude"}, "updated_at": "2024-01-01T00:00:00Z", **more}).encode()
    use = {"input_tokens": 3, "output_tokens": "4"}
    os.makedirs(tmp_path / "zed")
    with sqlite3.connect(tmp_path / "zed/t.db") as db:
        db.execute("CREATE TABLE threads (id, updated_at, created_at, folder_paths, folder_paths_order, data_type, data)")
        db.executemany("INSERT INTO threads VALUES (?, NULL, ?, NULL, NULL, ?, ?)", [
            ("a", "1970-01-01T00:00:01Z", "zstd", zstandard.compress(thread(request_token_usage={"x": use, "y": use}))), ("b", None, "json", thread(cumulative_token_usage={"input_tokens": 9, "cache_read_input_tokens": 2})),
            ("c", None, "json", thread(model={"provider": "openai", "model": "gpt"}, request_token_usage=[use])), ("d", None, "json", b"{"), ("e", None, "json", thread(imported=True, request_token_usage=[use])), ("f", None, "json", thread(request_token_usage=[{"input_tokens": -1}])), ("g", None, "brotli", b"x")])
    db.close()
    rows = readers.read_databases(spark, "zed", str(tmp_path / "zed")).orderBy("session_id").collect()
    assert [(r["session_id"], r["timestamp_ms"], r["tok_input"], r["tok_output"], r["tok_cache_read"]) for r in rows] == [("a", 1000, 6, 8, 0), ("b", 1704067200000, 9, 0, 2)]
    os.makedirs(tmp_path / "h")
    with sqlite3.connect(tmp_path / "h/h.db") as db:
        db.execute("CREATE TABLE sessions (id, model, billing_provider, started_at, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens)")
        db.execute("INSERT INTO sessions VALUES ('b', 'n', NULL, 2, 7, 5, 1, 2, 8)")
    db.close()
    assert [(r["tok_input"], r["tok_reasoning"]) for r in readers.read_databases(spark, "hermes", str(tmp_path / "h")).collect()] == [(7, 5)]


def test_absent_total_is_not_zero(spark, tmp_path):
    u = {"promptTokenCount": 10, "candidatesTokenCount": 6, "thoughtsTokenCount": 2}
    put(f"{tmp_path}/c.jsonl", "\n".join(json.dumps({"type": "assistant", "model": "q", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "usageMetadata": x}) for x in (u, {**u, "totalTokenCount": 0})))
    assert [(r["tok_output"], r["tok_reasoning"]) for r in readers.read_lines(spark, "qwen", str(tmp_path)).orderBy("input_seq").collect()] == [(6, 2), (4, 2)]


def test_settings(spark, tmp_path):
    put(f"{tmp_path}/s.json", {"timezone": "UTC", "extraScanPaths": {"claude": [f"{tmp_path}/x", f"{tmp_path}/y"]}, "clients": ["claude"], "pricingOrder": ["OpenRouter", "LiteLLM", "Models.dev"]})
    os.makedirs(tmp_path / "x")
    os.symlink(tmp_path / "x", tmp_path / "y")
    found = settings.load_settings(f"{tmp_path}/s.json")
    assert found.clients == ("claude",) and settings.all_roots({"claude": f"{tmp_path}/x", "pi": "/p"}, found) == {"claude": [f"{tmp_path}/x"], "pi": ["/p"]}
    assert settings.load_settings(f"{tmp_path}/none.json") == settings.Settings()
    for wrong in ({"local_label": " "}, {"machine_labels": {"a/b": "x"}}, {"price_order": ("LiteLLM",)}):
        with pytest.raises(ValueError):
            settings.Settings(**wrong)
    assert settings.selected_clients(None, ["b", "a"]) == ["a", "b"] and settings.selected_clients(["b"], ["a", "b"]) == ["b"]
    with pytest.raises(ValueError):
        settings.selected_clients([], ["a"])
    put(f"{tmp_path}/m.toml", '[[rules]]\npattern = "a*"\nmodel = "b"\n')
    assert settings.load_mappings(f"{tmp_path}/m.toml", [("x", "y")]) == [("a*", "b"), ("x", "y")]
    put(f"{tmp_path}/n.toml", 'include_defaults = false\n[[rules]]\npattern = "a"\nmodel = "b"\n')
    assert settings.load_mappings(f"{tmp_path}/n.toml", [("x", "y")]) == [("a", "b")]
    assert settings.staleness(f"{tmp_path}/m.toml") == "fresh" and settings.staleness(f"{tmp_path}/m.toml", time.time() + 7200) == "stale" and settings.staleness("/none") == "missing"


def test_custom_prices(spark, tmp_path):
    rate = {"input_cost_per_million_tokens": 2, "output_cost_per_token": 3e-6, "notes": None}
    put(f"{tmp_path}/p.json", {"models": {"House": rate, "house": {"input_cost_per_token": 5e-6, "cache_creation_input_token_cost_above_1hr_above_100k_tokens": 1e-6}, "bad": {"input_cost_per_token": -1}, "odd": {"what": 1}, "none": {}}, "provider_overrides": [
        {"provider_id": " ACME ", "model_id": "House", "pricing": rate}, {"provider_id": "two", "model_id": "x", "pricing": rate}, {"provider_id": "Two", "model_id": "X", "pricing": rate}, {"provider_id": "unknown", "model_id": "x", "pricing": rate}]})
    prices, wrong = settings.custom_prices(spark, f"{tmp_path}/p.json")
    rows = {(r["key"], r["row_billing_provider"]): (r["input"], r["output"], r["hour_100k"]) for r in prices.collect()}
    assert rows == {("house", None): (5e-6, None, 1e-6), ("house", "acme"): (2e-6, 3e-6, None)} and len(wrong) == 6
    asked = spark.createDataFrame([("House", None, "acme"), ("house", "x", None)], ", ".join(f"{k} string" for k in lookup.KEYS))
    found = {r["billing_provider"]: r["input"] for r in lookup.with_prices(asked, lookup.scoped_catalog(prices), estimate.RATE_COLUMNS).collect()}
    assert found == {"acme": 2e-6, None: 5e-6}


def test_asked_range():
    today = dt.date(2024, 2, 10)
    assert calendar.asked_range(today, "week") == (dt.date(2024, 2, 4), today) and calendar.asked_range(today, year=2023) == (dt.date(2023, 1, 1), dt.date(2023, 12, 31))
    assert calendar.asked_range(today) == (None, None)
    for wrong in ({"name": "week", "year": 2023}, {"since": today, "name": "today"}, {"since": today, "until": dt.date(2024, 1, 1)}):
        with pytest.raises(ValueError):
            calendar.asked_range(today, **wrong)


def test_tags_meet(spark):
    df = spark.createDataFrame([("openai/gpt-5.4", "openai"), ("a/b.azure", "microsoft"), ("bare", "x")], "key string, hint string")
    rows = df.select(providers.key_tags(F.col("key")).alias("t"), providers.provider_tags(F.col("hint")).alias("h")).collect()
    assert [list(r["t"]) for r in rows] == [["openai"], ["a", "b", "microsoft"], []] and [list(r["h"]) for r in rows] == [["openai"], ["microsoft"], ["x"]]


def test_merged_keeps_records_without_key(spark):
    rows = [("c", None, 1, "m", "s", 5, 1, 1, 1, 1, "p", False), ("c", None, 2, "m", "s", 5, 1, 1, 1, 1, "p", False), ("c", "k", 3, "m", "s", 9, 1, 2, 1, 1, "p", False), ("c", "k", 4, "n", "s", 4, 3, 1, 1, 1, "q", True)]
    df = spark.createDataFrame(rows, "client string, dedup_key string, input_seq bigint, model_id string, session_id string, tok_input bigint, tok_output bigint, tok_cache_read bigint, tok_cache_write bigint, tok_reasoning bigint, provider_id string, split boolean").withColumn("ts", F.lit(0))
    got = {r["input_seq"]: (r["tok_input"], r["tok_output"], r["billing_provider"], r["billing_conflicted"]) for r in quality.merged(df, "split").collect()}
    assert got == {1: (5, 1, "p", False), 2: (5, 1, "p", False), 3: (4, 3, None, True)}
