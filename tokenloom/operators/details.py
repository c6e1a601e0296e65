"""Daily and hourly rows per grouping, the detail rows of a bucket, whole profiles, and achievements."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.adapter import GROUPINGS, TOKENS
from .facts import dollars, sums

# The five steps of each ladder (cache in percent).
LADDERS = {
    "streak": [7, 15, 30, 90, 180],
    "tokens": [100_000_000, 1_000_000_000, 10_000_000_000, 100_000_000_000, 1_000_000_000_000],
    "cache": [50, 80, 90, 95, 99],
    "models": [10, 20, 30, 100, 200],
    "clients": [1, 5, 10, 15, 20],
}
DAY_PARTS = ["Morning", "Daytime", "Evening", "Night"]


def daily_models(usage: DataFrame, grouping: str) -> DataFrame:
    """Per date and client its rows under a grouping, with the provider of the earliest record."""
    keys = list(dict.fromkeys(["local_date", "client", *GROUPINGS[grouping]]))
    provider = [] if "provider_id" in keys else [F.min_by("provider_id", "input_seq").alias("provider_id")]
    made = usage.groupBy(*keys).agg(*sums("tokens", "cost_micros", "message_count"), *provider)
    return made.select(*keys, *[c for c in ("provider_id",) if c not in keys], *TOKENS, "tokens", "message_count", dollars(), "cost_micros")


def hourly_models(usage: DataFrame, grouping: str) -> DataFrame:
    """Per hour its models, whoever the client, with the clients in order; by provider or machine only where the grouping asks."""
    keys = ["local_hour", *[k for k in GROUPINGS[grouping] if k in ("provider_id", "machine", "model_id")]]
    made = usage.groupBy(*keys).agg(*sums("tokens", "cost_micros", "message_count"), F.array_join(F.array_sort(F.collect_set("client")), ", ").alias("clients"))
    return made.select(*keys, "clients", *TOKENS, "tokens", "message_count", dollars())


def detail_rows(usage: DataFrame, grouping: str = "model") -> DataFrame:
    """Per date the rows under a grouping over all clients: clients by tokens (equals by name), providers once each in
    the order in which the clients, by name, have them."""
    days = daily_models(usage, grouping)
    keys = ["local_date", *GROUPINGS[grouping]]
    by_tokens = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("tokens")).alias("t"), F.col("client").alias("c")))), lambda x: x["c"])
    met = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col("client").alias("c"), F.col("provider_id").alias("p")))), lambda x: x["p"]))
    made = days.groupBy(*keys).agg(*sums("tokens", "cost_micros", "message_count"), F.array_join(by_tokens, ", ").alias("clients"), F.array_join(met, ", ").alias("providers"))
    return made.select(*keys, "clients", "providers", *TOKENS, "tokens", "message_count", dollars())


def completed(rows: DataFrame, key: str, values: list, *counts: str) -> DataFrame:
    """rows with one for each of values: those that are missing count 0."""
    kind = rows.schema[key].dataType.simpleString()
    spine = rows.sparkSession.createDataFrame([(v,) for v in values], f"{key} {kind}")
    return spine.join(rows, key, "left").na.fill(0, list(counts))


def level(value: Column, steps: list[int]) -> Column:
    """The last step (from 0) that value reaches, or -1."""
    return (F.size(F.filter(F.array(*[F.lit(s).cast("long") for s in steps]), lambda s: value >= s)) - 1).cast("int")


def achievements(overview: DataFrame, streaks: DataFrame) -> DataFrame:
    """ladder, level: where the overview's one row and the current streak stand; the cache's rate is in tenths of a percent."""
    values = {"streak": F.col("current_streak"), "tokens": F.col("tokens"), "cache": F.floor(F.col("cache_rate") / 10), "models": F.col("models"), "clients": F.col("clients")}
    one = overview.crossJoin(streaks)  # a row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("ladder"), level(v, LADDERS[n]).alias("level")) for n, v in values.items()])).alias("x")).select("x.*")
