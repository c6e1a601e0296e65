import json

from tokenloom.sources import cumulative, readers


def test_increments():
    def reports(*totals):
        return list(cumulative.increments((None if t is None else [t, 0, 0, 0, 0], None if x is None else [x, 0, 0, 0, 0]) for t, x in totals))

    def first(found):
        return [None if f is None else f[0] for f in found]

    assert first(reports((10, None), (10, None), (25, None))) == [10, None, 15]
    assert first(reports((100, None), (99, None), (130, None))) == [100, None, 30]  # late: near below
    assert first(reports((100, 100), (60, 20), (130, 30))) == [100, None, 30]  # late: within two increments
    assert first(reports((100, 100), (10, 10), (15, 5))) == [100, 10, 5]  # a new start
    assert first(reports((0, None), (7, None), (0, None), (9, None)))[1] == 7
    assert first(reports((None, 4), (None, None))) == [4, None]


def test_buckets():
    assert cumulative.buckets([10, 3, 2, 4, 1]) == (5, 4, 3, 2, 1)
    assert cumulative.buckets([4, 3, 2, 4, 1]) is None and cumulative.buckets([0] * 5) is None


def test_codex(spark, tmp_path):
    def count(total, **last):
        info = {"total_token_usage": {"input_tokens": total, "cached_input_tokens": 1, "output_tokens": 2}} | ({"last_token_usage": last} if last else {})
        return {"timestamp": "2024-01-01T00:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": info}}

    lines = [{"type": "session_meta", "payload": {"id": "s", "model_provider": "p"}}, count(10), {"type": "turn_context", "payload": {"model": "a"}}, count(10), count(30), {"type": "turn_context", "payload": {"model": "b"}}, count(50, input_tokens=20, cached_input_tokens=5, output_tokens=4, reasoning_output_tokens=3)]
    (tmp_path / "x.jsonl").write_text("\n".join(["{damaged", *map(json.dumps, lines)]))
    (tmp_path / "empty.jsonl").write_text("")
    rows = readers.read_all(spark, {"codex": str(tmp_path)}).orderBy("input_seq").collect()
    assert [(r["session_id"], r["model_id"], r["provider_id"], *(r[c] for c in readers.TOKENS)) for r in rows] == [("s", "a", "p", 9, 2, 1, 0, 0), ("s", "a", "p", 20, 0, 0, 0, 0), ("s", "b", "p", 15, 4, 5, 0, 3)]
    assert {r["timestamp_ms"] for r in rows} == {1704067200000}
