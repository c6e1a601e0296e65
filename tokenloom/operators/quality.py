"""Acceptance of records, first-wins and merging dedup, and reconciliation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.adapter import TOKENS

#: Reasons in the order in which they are tried.
REASONS = ["missing-model", "missing-session", "invalid-timestamp", "invalid-usage", "invalid-message-count"]


def reject_reason(one_hour: str | None = None) -> Column:
    """The first reason to reject a record, or null.  A record without positive tokens isn't rejected but filtered."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = F.lit(False)
    for c in TOKENS:
        bad = bad | (F.coalesce(F.col(c), F.lit(0)) < 0)
    if one_hour:
        bad = bad | (F.col(one_hour) > F.col("tok_cache_write"))
    tests = [blank(F.col("model_id")), blank(F.col("session_id")), F.col("ts").isNull(), bad, F.col("message_count") < 0]
    out = F.when(tests[0], REASONS[0])
    for test, reason in zip(tests[1:], REASONS[1:], strict=True):
        out = out.when(test, reason)
    return out


def gate(usage: DataFrame, one_hour: str | None = None) -> DataFrame:
    """usage with `reason` and `accepted`: neither rejected nor without tokens."""
    marked = usage.withColumn("reason", reject_reason(one_hour))
    return marked.withColumn("accepted", F.col("reason").isNull() & (F.greatest(*[F.col(c) for c in TOKENS]) > 0))


def first_wins(usage: DataFrame, key: str = "dedup_key", order: str = "input_seq") -> DataFrame:
    """The first record of each (client, key) in arrival order; records without key all stay.

    Keyless records skip the shuffle, so a hot null key costs nothing; the rest is a minimum per key with
    map-side partial aggregation, not a window that would gather a hot key's rows."""
    keyed, free = usage.where(F.col(key).isNotNull()), usage.where(F.col(key).isNull())
    picked = keyed.groupBy("client", key).agg(F.min_by(F.struct(*[F.col(c) for c in usage.columns]), order).alias("_r"))
    return picked.select("_r.*").unionByName(free)


def max_merge(usage: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Copies of a message merged: identity of the first, each bucket's maximum, and whether billing conflicts."""
    made = usage.where(F.col(key).isNotNull()).groupBy("client", key).agg(
        F.min("input_seq").alias("input_seq"), F.min_by("model_id", "input_seq").alias("model_id"), F.min_by("session_id", "input_seq").alias("session_id"),
        *[F.max(c).alias(c) for c in TOKENS], F.count_distinct("provider_id").alias("_n"), F.min("provider_id").alias("_p"))
    return made.select("client", key, "input_seq", "model_id", "session_id", *TOKENS, F.when(F.col("_n") == 1, F.col("_p")).alias("billing_provider"), (F.col("_n") > 1).alias("billing_conflicted"))


def health(gated: DataFrame, *by: str) -> DataFrame:
    """Per group and issue its records: a reason to reject, without-tokens, or accepted."""
    issue = F.coalesce("reason", F.when(F.col("accepted"), "accepted").otherwise("without-tokens"))
    return gated.groupBy(*by, issue.alias("issue")).agg(F.count(F.lit(1)).alias("records"))


def merged(usage: DataFrame, split: str, key: str = "dedup_key") -> DataFrame:
    """Copies of a message as one record: identity and time of the first, each bucket's maximum, and whether billing
    conflicts.  Input that a copy splits by cache (split) counts before any that none does.  Records without key
    stay as they are, and skip the exchange."""
    keyed = usage.where(F.col(key).isNotNull()).groupBy("client", key).agg(
        F.min("input_seq").alias("input_seq"), *[F.min_by(c, "input_seq").alias(c) for c in ("model_id", "session_id", "ts")],
        F.coalesce(F.max(F.when(F.col(split), F.col("tok_input"))), F.max("tok_input")).alias("tok_input"), *[F.max(c).alias(c) for c in TOKENS if c != "tok_input"],
        F.min("provider_id").alias("_p"), F.max("provider_id").alias("_q"))
    columns = ["client", key, "input_seq", "model_id", "session_id", "ts", *TOKENS]
    conflict = F.coalesce(F.col("_p") != F.col("_q"), F.lit(False))
    whole = keyed.select(*columns, F.when(~conflict, F.col("_p")).alias("billing_provider"), conflict.alias("billing_conflicted"))
    free = usage.where(F.col(key).isNull()).select(*columns, F.col("provider_id").alias("billing_provider"), F.lit(False).alias("billing_conflicted"))
    return whole.unionByName(free)


def merge_copies(usage: DataFrame, split: str, one_hour: str, key: str = "dedup_key") -> DataFrame:
    """merged() for whole records: all other columns are the first copy's.  usage has billing_provider, which is null
    where copies name different ones."""
    keyed, free = usage.where(F.col(key).isNotNull()), usage.where(F.col(key).isNull())
    most = [c for c in (*TOKENS, one_hour) if c != "tok_input"]
    made = keyed.groupBy("client", key).agg(
        F.min_by(F.struct(*[F.col(c) for c in usage.columns]), "input_seq").alias("_r"), F.coalesce(F.max(F.when(F.col(split), F.col("tok_input"))), F.max("tok_input")).alias("_tok_input"),
        *[F.max(c).alias(f"_{c}") for c in most], F.min("billing_provider").alias("_p"), F.max("billing_provider").alias("_q"))
    new = {"tok_input": F.col("_tok_input"), "billing_provider": F.when(F.col("_p") == F.col("_q"), F.col("_p"))} | {c: F.col(f"_{c}") for c in most}
    return made.select(*[new.get(c, F.col(f"_r.{c}")).alias(c) for c in usage.columns]).unionByName(free)


def snapshot_residual(usage: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What snapshots (session_id, model_id, tokens) have beyond the records: maximum minus sum, not below 0."""
    most = snapshots.groupBy("session_id", "model_id").agg(*[F.max(c).alias(c) for c in TOKENS])
    used = usage.groupBy("session_id", "model_id").agg(*[F.sum(c).alias(f"_{c}") for c in TOKENS])
    left = most.join(used, ["session_id", "model_id"], "left").select("session_id", "model_id", *[F.greatest(F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0)), F.lit(0)).cast("bigint").alias(c) for c in TOKENS])
    return left.where(F.greatest(*[F.col(c) for c in TOKENS]) > 0)


def owned_elsewhere(usage: DataFrame, claims: DataFrame) -> DataFrame:
    """Records whose session no other client claims."""
    return usage.join(claims.select("session_id").distinct(), "session_id", "left_anti")


def cumulative_delta(usage: DataFrame, counter: Column, by: list[str], order: str = "input_seq") -> DataFrame:
    """Increments of a cumulative counter: what it rises above the highest value before; repeats and falls give 0."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.coalesce(F.max("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return usage.withColumn("_c", counter).withColumn("delta", F.greatest(F.col("_c") - before, F.lit(0)).cast("bigint")).drop("_c")


def carry_forward(usage: DataFrame, value: Column, by: list[str], order: str = "input_seq") -> DataFrame:
    """The last known value up to each record, and where there is none the first after it."""
    w = Window.partitionBy(*by).orderBy(order)
    last = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return usage.withColumn("carried", F.coalesce(last, following))


def settlements(usage: DataFrame, step: Column, by: list[str], order: str = "input_seq") -> DataFrame:
    """Of adjacent records of one step the last: it settles those before."""
    w = Window.partitionBy(*by).orderBy(order)
    return usage.withColumn("_s", step).withColumn("_next", F.lead("_s").over(w)).where(~F.col("_s").eqNullSafe(F.col("_next"))).drop("_s", "_next")
