import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.functions import calendar, imputation, names
from tokenloom.operators import pricing, quality


def test_model_names():
    rules = [("claude-*sonnet*", "claude-sonnet"), ("gpt-5", "gpt-five")]
    assert names.normalize_model(" custom:openrouter/Claude-Sonnet-4-5-20250929:free ") == "claude-sonnet-4.5"
    assert names.canonical("anthropic/claude-3-sonnet", rules) == "claude-sonnet"
    assert names.canonical("GPT-5-2025-08-07", rules) == "gpt-five"
    assert names.wildcard("a*c", "AbbC") and not names.wildcard("a.c", "abc")


def test_canonicalize_joins_distinct_spellings(spark):
    df = spark.createDataFrame([(1, "x/GPT-5"), (2, None), (3, "x/GPT-5")], "i int, raw string")
    got = {r["i"]: r["model_id"] for r in names.canonicalize(df, "raw", [("gpt-5", "five")]).collect()}
    assert got == {1: "five", 2: None, 3: "five"}


def test_agent_names(spark):
    df = spark.createDataFrame([("code​  reviewer",), ("ui-api  BOT",)], "a string")
    assert [r[0] for r in df.select(names.agent_name(F.col("a"))).collect()] == ["Code Reviewer", "UI API BOT"]


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=12))
def test_batch_split_keeps_rows_and_columns(totals):
    weights = [50, 20, 20, 5, 5]
    rows = imputation.allocate_batch(totals, weights)
    assert [sum(r) for r in rows] == totals
    assert [sum(r[i] for r in rows) for i in range(5)] == imputation.split_total(sum(totals), weights)


def test_clock_changes():
    zone = "America/New_York"
    assert calendar.wall_to_epoch(dt.datetime(2024, 3, 10, 2, 30), zone) is None
    assert calendar.wall_to_epoch(dt.datetime(2024, 11, 3, 1, 30), zone) == int(dt.datetime(2024, 11, 3, 5, 30, tzinfo=dt.timezone.utc).timestamp())
    with pytest.raises(ValueError):
        calendar.in_range(F.lit(None), dt.date(2024, 2, 1), dt.date(2024, 1, 1))


def test_timestamps(spark):
    df = spark.createDataFrame([("1700000000",), ("1700000000000",), ("2023-11-14T22:13:20Z",), ("0",), ("x",)], "t string")
    assert [r[0] for r in df.select(calendar.decode_timestamp(F.col("t"))).collect()] == [1700000000000] * 3 + [None] * 2


def test_tier_without_a_rate_is_passed_over(spark):
    df = spark.createDataFrame([(100,), (150,), (300,)], "t bigint")
    cost = pricing.tiered(F.col("t"), F.lit(1.0), [(100, F.lit(None).cast("double")), (200, F.lit(2.0))])
    assert [r[0] for r in df.select(cost).collect()] == [100.0, 150.0, 400.0]


def test_first_wins_keeps_null_keys(spark):
    df = spark.createDataFrame([("c", None, 1), ("c", None, 2), ("c", "k", 4), ("c", "k", 3)], "client string, dedup_key string, input_seq int")
    assert sorted(r["input_seq"] for r in quality.first_wins(df).collect()) == [1, 2, 3]
