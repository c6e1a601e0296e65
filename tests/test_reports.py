import json

from tokenloom.operators import facts, reports
from tokenloom.plans.adapter import usage
from tokenloom.sources import snapshots


def test_models_json(spark, sf_dir):
    models = facts.refold(facts.fine_models(usage(spark, sf_dir)), "model")
    rows = {r["model_id"]: r for r in models.collect()}
    found = [json.loads(r["value"]) for r in reports.models_json(models).collect()]
    assert len(found) == len(rows)
    for x in found:
        row = rows[x["modelId"]]
        assert x["tokens"]["total"] == row["tokens"] and x["tokens"]["displayedOutput"] == row["tok_output"] + row["tok_reasoning"] and x["cost"] == row["cost"]


def test_table_ends_with_the_total(spark, sf_dir):
    rows = reports.models_table(facts.fine_models(usage(spark, sf_dir))).collect()
    assert [r["is_total"] for r in rows] == [False] * (len(rows) - 1) + [True]
    assert [r["cost"] for r in rows[:-1]] == sorted((r["cost"] for r in rows[:-1]), reverse=True)
    assert rows[-1]["tokens"] == sum(r["tokens"] for r in rows[:-1])


def test_snapshots(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    assert snapshots.load(spark, at, "a", 0).status == "missing"
    snapshots.save(spark.range(3), at, "a", 1000)
    snapshots.save(spark.range(5), at, "a", 2000)
    found = snapshots.load(spark, at, "a", 2001)
    assert (found.status, found.saved_ms, found.data.count()) == ("fresh", 2000, 5)
    assert snapshots.load(spark, at, "a", 2000 + snapshots.FRESH_MS).status == "stale"
    assert snapshots.load(spark, at, "a", 1999).status == "stale"
    assert snapshots.load(spark, at, "b", 2001).status == "missing"
    for p in (tmp_path / "s").glob("data-*/*"):
        p.unlink()
    assert snapshots.load(spark, at, "a", 2001).status == "failure"
