import json
import random
import sqlite3

import zstandard

from tokenloom.sources import readers, threads
from tokenloom.sources.sessions import zstd_lines

TIME = 1704067200000


def put_lines(folder, name, *lines):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def got(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("input_path", "input_seq").collect()]


def test_junie_turns_counters_and_time_of_the_session(spark, tmp_path):
    def said(*usage, **more):
        return {"timestampMs": TIME, "event": {"agentEvent": {"kind": "LlmResponseMetadataEvent", "agent": {"name": "code reviewer"}, "modelUsage": list(usage)}}, **more}

    prompt = {"kind": "UserPromptEvent"}
    put_lines(tmp_path, "session-240101-020000-x/events.jsonl", prompt, said({"model": " m ", "inputTokens": "3.9", "output": 2, "cacheRead": 1, "provider": "p"}, {"model": "n", "input": 1}), said({"model": "m", "input": 5}, {"model": "m", "input": -1}, {"model": "m", "input": "x"}, {"model": "m"}),
              prompt, '{"kind": "UserPromptEvent"', said({"model": "k", "input": 1, "thinkingTokens": 2}, timestampMs=None), prompt, said({"input": 4}, {"model": "z", "input": 6}), {"kind": "Other"})
    put_lines(tmp_path, "other/events.jsonl", said({"model": "m", "input": 1}, timestampMs=0))
    rows = got(readers.read_all(spark, {"junie": str(tmp_path)}, "Asia/Shanghai"), "session_id", "model_id", "provider_id", "timestamp_ms", *readers.TOKENS, "agent", "is_turn_start")
    a, s = "Code Reviewer", "session-240101-020000-x"
    assert rows == [
        ("other", "m", None, None, 1, 0, 0, 0, 0, a, False),
        (s, "m", "p", TIME, 3, 2, 1, 0, 0, a, True), (s, "n", None, TIME, 1, 0, 0, 0, 0, a, False), (s, "m", None, TIME, 5, 0, 0, 0, 0, a, False),
        (s, "k", None, TIME - 6 * 3600000, 1, 0, 0, 0, 2, a, False), (s, None, None, TIME, 4, 0, 0, 0, 0, a, False), (s, "z", None, TIME, 6, 0, 0, 0, 0, a, True),
    ]


def test_commandcode_estimates_from_what_came_since_the_answer_before(spark, tmp_path):
    def line(role, content, **more):
        return {"role": role, "content": content, "timestamp": "2024-01-01T00:00:00Z", **more}

    talk = [line("user", "é\"x", sessionId="q"), line("tool", [{"a": [1, "b"]}]), "{broken", line("assistant", "hello", sessionId="s"), line("assistant", None), line("user", []), line("assistant", "again"), line("tool", {}), line("assistant", "tail", timestamp="never"), line("assistant", "end")]
    put_lines(tmp_path, "projects/w/a.jsonl", *talk)
    put_lines(tmp_path, "projects/w/a.meta.json", {"model": "org/big-FREE"})
    put_lines(tmp_path, "projects/w/b.jsonl", line("assistant", "early"), line("assistant", "x" * 10, sessionId="t"))
    put_lines(tmp_path, "projects/w/a.checkpoints.jsonl", line("assistant", "no", sessionId="n"))
    rows = got(readers.read_all(spark, {"commandcode": str(tmp_path)}), "session_id", "model_id", "provider_id", "timestamp_ms", "tok_input", "tok_output", "dedup_key", "workspace_key", "is_turn_start")
    heard = -(-(len('"é\\"x"') + len('[{"a":[1,"b"]}]')) // 4)
    unknown = ("commandcode-model-unknown", "unknown")
    assert rows == [
        ("s", "big", None, TIME, heard, 2, "commandcode:s:0", "w", True), ("s", "big", None, TIME, 0, 2, "commandcode:s:1", "w", True), ("s", "big", None, None, 0, 2, None, "w", False), ("s", "big", None, TIME, 0, 2, "commandcode:s:2", "w", False),
        (None, *unknown, TIME, 0, 2, None, "w", False), ("t", *unknown, TIME, 0, 3, "commandcode:t:0", "w", False),
    ]


def dsh(kind, seq, n=0, **data):
    return {"type": kind, "seq": seq, "time": TIME + seq, "data": {**({"usage": {"inputTokens": n, "outputTokens": 5, "reasoningTokens": 2}} if n else {}), **data}}


def test_dsh_settles_steps_and_leaves_out_what_is_inherited(spark, tmp_path):
    head = {"type": "session", "id": "s", "cwd": "c:\\w\\", "version": 4}
    model = dsh("request/header", 0, header={"config": {"provider": "Unknown", "model": "h"}})
    own = {"source": {"provider": "p", "model": "m", "replayState": {"response": {"responseModel": "served"}}}}
    stream = [{"type": "chunk", "chunk": {"type": "usage", "usage": {"inputTokens": n}}} for n in (1, 70)]
    put_lines(tmp_path, "a/session.v4.jsonl", head, model, dsh("user/message", 1), dsh("assistant/attempt", 2, 10, turn=1, step=1), dsh("compaction/summary", 3, 20), dsh("assistant/message", 4, 30, turn=1, step=1, message=own), dsh("llm/retry-started", 5, turn=1, step=1),
              dsh("assistant/message", 6, 40, turn=1, step=1), dsh("assistant/message", 7, 50, turn=1, step=2), dsh("assistant/message", 7, 50, turn=1, step=2), dsh("user/message", 8), dsh("assistant/message", 9, 60), dsh("assistant/message", 10, stream=stream), dsh("assistant/message", 11, -1), "{")
    put_lines(tmp_path, "a/session.jsonl", head, model, dsh("assistant/message", 2, 99))
    seeded = {**head, "id": "f", "version": 3, "isSeeded": True, "seedLength": 1}
    put_lines(tmp_path, "f/session.v3.jsonl", seeded, model, dsh("assistant/message", 1, 10), dsh("session/end-seed", 2, inherited=True), dsh("assistant/message", 3, 20), dsh("session/end-seed", 5, inherited=True), dsh("assistant/message", 4, 30), dsh("assistant/message", 6, 40), dsh("session/end-seed", 7))
    put_lines(tmp_path, "g/session.v3.jsonl", {**seeded, "id": "g"}, model, dsh("assistant/message", 8, 10))
    put_lines(tmp_path, "h/session.jsonl", {"type": "session", "seedLength": 3}, dsh("assistant/message", 2, 10, message=own), dsh("assistant/message", 3, 20, message=own))
    (tmp_path / "z").mkdir()
    (tmp_path / "z/session.v4.jsonl.zstd").write_bytes(zstandard.compress("\n".join(map(json.dumps, [{**head, "id": "z"}, model, dsh("assistant/message", 3, 80)])).encode()))
    rows = got(readers.read_all(spark, {"dsh": str(tmp_path)}), "session_id", "model_id", "provider_id", "tok_input", "tok_output", "tok_reasoning", "workspace_key", "is_turn_start")
    assert rows == [
        ("s", "served", "p", 30, 3, 2, "C:/w", True), ("s", "h", None, 20, 3, 2, "C:/w", False), ("s", "h", None, 40, 3, 2, "C:/w", False), ("s", "h", None, 50, 3, 2, "C:/w", False), ("s", "h", None, 60, 3, 2, "C:/w", True), ("s", "h", None, 70, 0, 0, "C:/w", False),
        ("f", "h", None, 40, 3, 2, "C:/w", False), ("h", "served", "p", 20, 3, 2, None, False), ("z", "h", None, 80, 3, 2, "C:/w", False),
    ]


def test_zstd_lines_up_to_where_a_file_is_cut(spark, tmp_path):
    lines = [f"{i} " + "".join(random.Random(i).choices("abcdefgh", k=200)) for i in range(3000)]
    whole = zstandard.compress("\n\n".join(lines).encode())
    (tmp_path / "a.zstd").write_bytes(whole)
    (tmp_path / "b.zstd").write_bytes(whole[: len(whole) // 2])
    rows = zstd_lines(spark, str(tmp_path), "*.zstd").orderBy("input_path", "_line").collect()
    assert [r["value"] for r in rows if r["input_path"].endswith("a.zstd")] == lines
    cut = [r["value"] for r in rows if r["input_path"].endswith("b.zstd")]
    assert 0 < len(cut) < 3000 and cut[:-1] == lines[: len(cut) - 1]


def test_amp_messages_that_no_ledger_event_stands_for(spark, tmp_path):
    def event(n, when, **more):
        return {"timestamp": when, "model": "m", "tokens": {"input": n, "output": 1}, **more}

    def message(number, n, **more):
        return {"role": "assistant", "messageId": number, "usage": {"model": "m", "inputTokens": n, "outputTokens": 1}, **more}

    day = "2024-01-01T00:00:0{}Z".format
    events = [event(5, day(3)), event(9, day(1), toMessageId=2), event(5, day(2)), event(-1, day(4)), event(7, None), event(8, day(9)[:-1])]
    messages = [message(1, 5), message(2, 77), message(3, 5), message(4, 5), message(5, 6), message(None, 6), message(6, 0, role="user"), "odd"]
    put_lines(tmp_path, "T-1.json", {"id": "t", "created": TIME, "usageLedger": {"events": events}, "messages": messages})
    put_lines(tmp_path, "T-2.json", {"id": " ", "messages": messages})
    put_lines(tmp_path, "T-3.json", "{")
    rows = got(readers.read_all(spark, {"amp": str(tmp_path)}), "session_id", "model_id", "timestamp_ms", "tok_input", "tok_output")
    assert rows == [("t", "m", TIME + t, n, 1) for t, n in ((1000, 9), (2000, 5), (3000, 5), (4000, 5), (5000, 6))]


def test_codebuff_takes_each_counter_from_the_first_place_that_has_it(spark, tmp_path):
    chat = "manicode/projects/p/chats/2024-01-01T00-00-00.000Z/chat-messages.json"
    history = [{"role": "assistant", "providerOptions": {"usage": {"prompt_tokens": 3}}}, {"role": "assistant", "providerOptions": {"codebuff": {"model": "late", "usage": {"completion_tokens": 4}}}}, {"role": "user", "providerOptions": {"usage": {"prompt_tokens": 99}}}]
    put_lines(tmp_path, chat, [
        {"id": "a", "variant": "ai", "metadata": {"model": "m", "usage": {"inputTokens": 5, "output_tokens": 0}, "codebuff": {"usage": {"inputTokens": 9, "outputTokens": 2, "promptTokensDetails": {"cachedTokens": 6}}}}},
        {"role": "assistant", "timestamp": 1704067201, "metadata": {"runState": {"sessionState": {"mainAgentState": {"messageHistory": history}}}}},
        {"role": "assistant", "metadata": {"model": "m", "usage": {"inputTokens": 5, "outputTokens": -1}}}, {"role": "user", "metadata": {"usage": {"inputTokens": 5}}}, {"role": "agent", "createdAt": "2024-01-01T00:00:02Z", "metadata": {"usage": {"inputTokens": 1.0}}},
    ])
    rows = got(readers.read_all(spark, {"codebuff": str(tmp_path)}), "session_id", "model_id", "timestamp_ms", *readers.TOKENS, "dedup_key")
    s = "manicode/p/2024-01-01T00-00-00.000Z"
    assert rows == [(s, "m", TIME, 5, 2, 6, 0, 0, "a"), (s, "late", TIME + 1000, 3, 4, 0, 0, 0, f"codebuff:{s}:{TIME + 1000}:late:1:3:4:0:0"), (s, None, TIME + 2000, 1, 0, 0, 0, 0, f"codebuff:{s}:{TIME + 2000}:None:4:1:0:0:0")]
    assert threads.millis("1704067200") == threads.millis(TIME) == TIME and threads.millis(-5) is threads.millis("x") is None


def test_warp_totals_are_split_all_at_once(spark, tmp_path):
    usage = [{"model_id": "m", "warp_tokens": 100, "byok_tokens": None}, {"model_id": "n", "byok_tokens": 3, "custom_endpoint_tokens": 4}, {"model_id": "m", "warp_tokens": -1}, {"warp_tokens": 5}, "odd", {"model_id": "z", "warp_tokens": 0}]
    with sqlite3.connect(tmp_path / "w.db") as db:
        db.execute("CREATE TABLE agent_conversations (id INTEGER, conversation_id TEXT, conversation_data TEXT, last_modified_at TEXT)")
        db.execute("CREATE TABLE ai_queries (conversation_id TEXT, working_directory TEXT)")
        db.executemany("INSERT INTO agent_conversations VALUES (?, ?, ?, ?)", [(1, "c", json.dumps({"conversation_usage_metadata": {"token_usage": usage}}), "2024-01-01 00:00:00.500"), (2, "d", "{", "2024-01-01 00:00:00"), (3, "e", json.dumps({"conversation_usage_metadata": {"token_usage": usage[:1]}}), None), (4, "f", "{}", None)])
        db.executemany("INSERT INTO ai_queries VALUES (?, ?)", [("c", " "), ("c", "/w//x/")])
    db.close()
    rows = got(readers.read_all(spark, {"warp": str(tmp_path)}), "session_id", "model_id", "timestamp_ms", *readers.TOKENS, "dedup_key", "workspace_key")
    assert [(r[0], r[1], r[2], sum(r[3:8]), *r[8:]) for r in rows] == [("c", "m", TIME + 500, 100, "warp:c:0:m", "/w/x"), ("c", "n", TIME + 500, 7, "warp:c:1:n", "/w/x"), ("c", None, TIME + 500, 0, "warp:c:3:None", "/w/x"), ("e", "m", None, 0, "warp:e:0:m", None)]
    assert [sum(r[i] for r in rows) for i in range(3, 8)] == [9, 1, 97, 0, 0]  # 107 x shares: 8.66, 0.45, 97.34, 0.41, 0.14


def grok(update=None, total=None, at=0, model=None, **more):
    meta = {"agentTimestampMs": TIME + at} | ({"totalTokens": total} if total is not None else {}) | ({"modelId": model} if model else {})
    return {"params": {"sessionId": "s", "_meta": meta, "update": {"sessionUpdate": update, **more}}}


def test_grok_turns_that_are_completed_and_those_that_only_grow(spark, tmp_path):
    ask, done = "user_message_chunk", "turn_completed"
    used = {"inputTokens": 10, "outputTokens": 5, "cachedReadTokens": 4, "reasoningTokens": 2, "totalTokens": 15}
    put_lines(tmp_path, "%2Fw%2Fx/s/updates.jsonl", grok("other"), grok(total=100, at=1, model="g"), grok(total=160, at=2), grok(ask, at=3), grok(total=170, at=4), grok(total=150, at=5), grok(total=200, at=6), grok(ask, at=7, model="h"), grok(total=230, at=8),
              grok(done, at=9, usage=used, promptId="p"), grok(done, at=10, usage={**used, "modelCalls": 3}, promptId="p"), grok(ask, at=11), grok(total=300, at=12), grok(done, at=13, usage={**used, "totalTokens": 9}), grok(ask, at=14), grok(total=301, at=15),
              grok(done, at=16, usage={"inputTokens": 20, "modelUsage": {"b": used, "a": {"inputTokens": 10, "modelCalls": 2}}}), grok(ask, at=17), grok(total=340, at=18))
    put_lines(tmp_path, "w/only/updates.jsonl", grok(total=40, at=1, model="g"), grok(total=40, at=2))
    put_lines(tmp_path, "w/cut/updates.jsonl", grok(ask, at=1, model="g"), grok(total=50, at=2), grok(ask, at=3), grok(total=90, at=4), "{", grok(ask, at=5))
    rows = got(readers.read_all(spark, {"grok": str(tmp_path)}), "input_path", "model_id", "timestamp_ms", *readers.TOKENS, "message_count", "dedup_key", "workspace_key", "is_turn_start")
    seen = sorted((r[0].split("/")[-2], r[2] - TIME, r[1], sum(r[3:8]), *r[8:]) for r in rows)
    assert seen == [
        ("cut", 2, "g", 50, 1, "grok:s:0", "w", True), ("only", 2, "g", 40, 1, "grok:s:0", "w", True),
        ("s", 2, "g", 60, 1, "grok:s:0", "/w/x", True), ("s", 6, "g", 40, 1, "grok:s:1", "/w/x", True), ("s", 10, "h", 15, 3, "grok:s:p:h", "/w/x", True),
        ("s", 16, "a", 10, 2, "grok:s:line-17:a", "/w/x", True), ("s", 16, "b", 15, 0, "grok:s:line-17:b", "/w/x", False), ("s", 18, "h", 39, 1, "grok:s:5", "/w/x", True),
    ]
    assert [r[3:8] for r in rows if r[9] == "grok:s:p:h"] == [(6, 3, 4, 0, 2)]


def test_claude_copies_advisors_and_sidechains(spark, tmp_path):
    from tokenloom.plans.answers import usage_from

    def said(n, out, key="m", request="q", more=None, **line):
        usage = {"input_tokens": n, "output_tokens": out, **(more or {})}
        return {"type": "assistant", "sessionId": "s", "cwd": "/w/", "timestamp": "2024-01-01T00:00:00Z", "requestId": request, "message": {"id": key, "model": "claude-x", "usage": usage}, **line}

    hour = {"cache_creation_input_tokens": 9, "cache_creation": {"ephemeral_1h_input_tokens": 4}}
    advice = {"iterations": [{"type": "message", "model": "z", "input_tokens": 99}, {"type": "advisor_message", "model": "claude-o", "input_tokens": 7, "output_tokens": 1}, {"type": "advisor_message", "model": " "}]}
    put_lines(tmp_path, "p/s.jsonl", said(50, 1), said(5, 8, more=hour), said(60, 3, more=advice), said(1, 1, key=None), said(1, 1, key=None), said(2, 2, "k", None, providerId="aws"), "{", said(3, 1, "k", None, providerId="gcp"))
    put_lines(tmp_path, "p/agent-1.jsonl", {"type": "user", "isSidechain": True, "sessionId": "s"}, said(4, 4, "side", sessionId="other"), said(5, 9, more=advice))
    usage, rejected = usage_from(spark, {"claude": str(tmp_path)}, merge_claude=True)
    seen = sorted((r["session_id"], r["model_id"], r["tok_input"], r["tok_output"], r["tok_cache_write"], r["tok_write_1h"], r["message_count"], r["workspace_key"], r["is_main_session"], r["billing_provider"]) for r in usage.collect())
    # agent-1.jsonl comes first, so the identity of m and of its advisor's call is the sidechain's
    assert seen == [
        ("s", "claude-o", 7, 1, 0, 0, 0, "/w", False, None), ("s", "claude-x", 1, 1, 0, 0, 1, "/w", True, None), ("s", "claude-x", 1, 1, 0, 0, 1, "/w", True, None), ("s", "claude-x", 3, 2, 0, 0, 1, "/w", True, None),
        ("s", "claude-x", 4, 4, 0, 0, 1, "/w", False, None), ("s", "claude-x", 5, 9, 9, 4, 1, "/w", False, None),
    ]
    assert rejected.count() == 0
