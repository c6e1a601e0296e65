"""Price lookup by rank of candidates, tiered cost, service tiers, time-of-day rates and provenance."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rates of a price row: base, then those above a number of tokens of the bucket.
PRICED = {"tok_input": "input", "tok_output": "output", "tok_cache_read": "cache_read", "tok_cache_write": "cache_write"}
LONG_PROMPT = 272_000
WHOLE_PROMPT = 200_000


def usable(price: Column) -> Column:
    return F.when(price.isNotNull() & ~F.isnan(price) & (price >= 0) & (price < float("inf")), price)


def pick_prices(wanted: DataFrame, prices: DataFrame) -> DataFrame:
    """For each (model_id, provider_id) the price row of the best candidate, or none.

    Candidates match the model exactly (lower case).  A row scoped to the provider comes before an unscoped
    one, whatever its catalog; then the catalog's ordinal, then the key.  Rows without any usable price are
    no candidates.  prices: catalog, ordinal, key, model, owner and rates.  The lookup runs on distinct pairs."""
    any_price = F.coalesce(*[usable(F.col(c)) for c in ("input", "output", "cache_read", "cache_write")]).isNotNull()
    pairs = wanted.select("model_id", "provider_id").distinct()
    offers = prices.where(any_price).withColumn("_m", F.lower("model"))
    met = pairs.join(offers, (F.lower(pairs["model_id"]) == F.col("_m")) & (F.col("owner").isNull() | (F.col("owner") == pairs["provider_id"])))
    rank = F.struct(F.col("owner").isNull().alias("class"), "ordinal", "key")
    row = F.struct(*[F.col(c) for c in prices.columns])
    return met.groupBy("model_id", "provider_id").agg(F.min_by(row, rank).alias("price"))


def tiered(tokens: Column, base: Column, tiers: list[tuple[int, Column]]) -> Column:
    """Marginal cost: tokens above a bound cost its rate; a tier without a rate is passed over."""
    cost, below, rate = F.lit(0.0), F.lit(0).cast("bigint"), F.coalesce(usable(base), F.lit(0.0))
    for bound, price in tiers:
        price = usable(price)
        here = F.greatest(F.least(tokens, F.lit(bound)) - below, F.lit(0))
        cost = F.when(price.isNull(), cost).otherwise(cost + here * rate)
        below = F.when(price.isNull(), below).otherwise(F.lit(bound).cast("bigint"))
        rate = F.coalesce(price, rate)
    return cost + F.greatest(tokens - below, F.lit(0)) * rate


def in_window(minutes: Column, start: Column, end: Column) -> Column:
    """Whether a minute of the day is in [start, end), which may pass midnight."""
    return F.when(start <= end, (minutes >= start) & (minutes < end)).otherwise((minutes >= start) | (minutes < end))


def service_rate(tier: Column, base: Column, priority: Column, flex: Column) -> Column:
    """The rate of a service tier; null where a tier has none, or isn't known."""
    return F.when(tier.isNull() | tier.isin("default", "standard"), base).when(tier.isin("fast", "priority"), priority).when(tier == "flex", flex)
