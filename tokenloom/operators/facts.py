"""Pre-aggregated facts (totals, models, agents, days, hours, sessions) and their regrouping.

Measures are sums of integers, so facts add up to the same totals whichever way they are folded; distinct
counts are exact.  Sums are made in decimal(38,0) and given as bigint; one beyond it is an error, never wrong."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.adapter import GROUPINGS, TOKENS, UNKNOWN_WORKSPACE


def total(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(20,0)")).cast("bigint").alias(column)


def sums(*more: str) -> list[Column]:
    return [total(c) for c in (*TOKENS, *more)]


def dollars(column: str = "cost_micros") -> Column:
    return (F.col(column) / F.lit(1e6)).alias("cost")


def totals_by_client(usage: DataFrame) -> DataFrame:
    return usage.groupBy("client").agg(*sums("cost_micros")).select("client", *TOKENS, dollars())


def fine_models(usage: DataFrame) -> DataFrame:
    """The finest fact: everything the model views can group by, with arrival order."""
    keys = ["machine", "client", "provider_id", "workspace_key", "session_id", "model_id"]
    return usage.groupBy(*keys).agg(*sums("tokens", "cost_micros", "message_count"), F.min("input_seq").alias("first_seen"))


def refold(fine: DataFrame, grouping: str, clients: list[str] | None = None) -> DataFrame:
    """Model rows of a grouping: sums, providers sorted, clients by contribution, exact session counts.

    The client order needs sums per client first; sessions are distinct per client, so both come from one
    regrouping by (group, client) and one by group."""
    keys = GROUPINGS[grouping]
    if clients is not None:
        fine = fine.where(F.col("client").isin(clients))
    label = [F.coalesce(F.regexp_extract("workspace_key", "[^/]+$", 0), F.lit(UNKNOWN_WORKSPACE)).alias("workspace_label")] if "workspace_key" in keys else []
    if "client" in keys:  # a group has one client: one regrouping does, and one provider if that is a key too
        by_session = fine.groupBy(*keys, "session_id").agg(*sums("tokens", "cost_micros", "message_count"), *([] if "provider_id" in keys else [F.collect_set("provider_id").alias("_p")]))
        many = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_p")))), ", ")
        out = by_session.groupBy(*keys).agg(*sums("tokens", "cost_micros", "message_count"), F.count(F.lit(1)).alias("session_count"), *([] if "provider_id" in keys else [many.alias("providers")]))
        named = [F.col("provider_id").alias("providers")] if "provider_id" in keys else ["providers"]
        return out.select(*keys, *label, *TOKENS, "tokens", "message_count", dollars(), *named, F.col("client").alias("clients"), "session_count")
    inner = fine.groupBy(*dict.fromkeys([*keys, "client"])).agg(*sums("tokens", "cost_micros", "message_count"), F.min("first_seen").alias("first_seen"), F.collect_set("provider_id").alias("_p"), F.count_distinct("session_id").alias("_s"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("tokens")).alias("t"), "first_seen", F.col("client").alias("c"))))
    out = inner.groupBy(*keys).agg(*sums("tokens", "cost_micros", "message_count"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_p")))), ", ").alias("providers"), F.array_join(F.transform(ranked, lambda x: x["c"]), ", ").alias("clients"), F.sum("_s").cast("bigint").alias("session_count"))
    return out.select(*keys, *label, *TOKENS, "tokens", "message_count", dollars(), "providers", "clients", "session_count")


def agents(usage: DataFrame) -> DataFrame:
    return usage.where("agent is not null").groupBy("client", "agent").agg(*sums("cost_micros", "message_count"), F.count_distinct("session_id").alias("instances")).select("client", "agent", *TOKENS, "message_count", dollars(), "instances")


def buckets(usage: DataFrame, bucket: str, *keys: str) -> DataFrame:
    made = usage.groupBy(bucket, *keys).agg(*sums("tokens", "cost_micros", "message_count"), F.sum(F.col("is_turn_start").cast("bigint")).alias("turn_count"))
    return made.select(bucket, *keys, *TOKENS, "tokens", "message_count", "turn_count", dollars())


def periods(usage: DataFrame, kind: str) -> DataFrame:
    """Months or ISO weeks, folded from days: an active day has messages, turns or tokens."""
    days = usage.groupBy("local_date").agg(*sums("tokens", "cost_micros", "message_count"), F.sum(F.col("is_turn_start").cast("bigint")).alias("turn_count"))
    start = F.date_trunc("month" if kind == "monthly" else "week", "local_date").cast("date")
    active = ((F.col("message_count") > 0) | (F.col("turn_count") > 0) | (F.col("tokens") > 0)).cast("bigint")
    folded = days.withColumn("start_date", start).groupBy("start_date").agg(*sums("tokens", "cost_micros", "message_count", "turn_count"), F.sum(active).alias("active_days"))
    if kind == "monthly":
        label, year = F.date_format("start_date", "MMMM"), F.year("start_date")
    else:
        last = F.date_add("start_date", 6)
        label = F.concat(F.lit("W"), F.lpad(F.extract(F.lit("WEEK"), "start_date").cast("string"), 2, "0"), F.lit(" "), F.date_format("start_date", "MMM dd"), F.lit(" - "), F.date_format(last, "MMM dd"))
        year = F.extract(F.lit("YEAROFWEEK"), F.col("start_date"))
    return folded.select("start_date", year.cast("int").alias("section_year"), label.alias("label"), *TOKENS, "tokens", "message_count", "turn_count", "active_days", dollars())


def sessions(usage: DataFrame) -> DataFrame:
    """One row per (client, session): first known workspace in arrival order, sorted models, seen from and to (seconds)."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    first = F.min_by("workspace_key", F.when(F.col("workspace_key").isNotNull(), F.col("input_seq")))
    return usage.groupBy("client", "session_id").agg(
        *sums("tokens", "cost_micros", "message_count"), F.sum(F.col("is_turn_start").cast("bigint")).alias("turn_count"), first.alias("workspace_key"),
        F.array_join(F.array_sort(F.collect_set("model_id")), ",").alias("models"), F.min(F.floor(seconds)).alias("first_seen"), F.max(F.floor(seconds)).alias("last_seen"),
    ).select("client", "session_id", "workspace_key", "models", *TOKENS, "tokens", "message_count", "turn_count", "first_seen", "last_seen", dollars())


def session_clients(session_rows: DataFrame, clients: DataFrame) -> DataFrame:
    """Per known client: sessions, distinct workspaces, time spent, last seen; clients without sessions count zero."""
    found = session_rows.groupBy("client").agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("workspace_key").alias("workspaces"), F.sum(F.col("last_seen") - F.col("first_seen")).alias("seconds"), F.max("last_seen").alias("last_seen"))
    return clients.join(found, "client", "left").select("client", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("sessions", "workspaces", "seconds")], "last_seen")


def invariants(usage: DataFrame) -> DataFrame:
    """Clients whose facts don't add up to their total; must be empty."""
    wanted = usage.groupBy("client").agg(total("tokens"))
    ways = {"model": fine_models(usage), "daily": buckets(usage, "local_date", "client"), "hourly": buckets(usage, "local_hour", "client")}
    out = [wanted.join(made.groupBy("client").agg(F.sum("tokens").cast("bigint").alias("_t")), "client", "full").where(~F.col("tokens").eqNullSafe(F.col("_t"))).select("client", F.lit(name).alias("fact")) for name, made in ways.items()]
    return out[0].union(out[1]).union(out[2])
