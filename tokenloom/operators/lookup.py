"""One price row for each (model, provider, billing provider): ranked candidates from catalogs and custom prices."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import providers
from .pricing import usable

#: Ranks of candidates, best first.
CUSTOM_SCOPED, CUSTOM, PROVIDER, ANY = range(4)
KEYS = ["model_id", "provider_id", "billing_provider"]


def is_deepseek_v4(model: Column) -> Column:
    return providers.last_segment(model).rlike("^deepseek-v4(-.+)?$")


def scoped_catalog(prices: DataFrame) -> DataFrame:
    """prices (catalog, key, litellm_provider, ...) with model, scope and owner: whose models a row is about.

    A LiteLLM row of a GPT route, or of a bare GPT or Claude name with its maker, belongs to that provider; another
    key with a slash is a route, which providers match by tags; the rest holds for everyone.  Claude versions
    written with a dash have a dot."""
    name = F.lower(F.substring_index("key", "/", -1))
    model = F.regexp_replace(name, r"^claude-(opus|sonnet|haiku|fable)-([1-9]\d?)-(\d)$", "claude-$1-$2.$3")
    lite, gpt = F.col("catalog") == "LiteLLM", name.startswith("gpt-")
    maker = F.col("litellm_provider")
    owner = F.when(lite & gpt & F.col("key").contains("/"), providers.grouped_provider(F.substring_index("key", "/", 1))).when(
        ~F.col("key").contains("/") & lite & (((maker == "openai") & gpt) | ((maker == "anthropic") & name.startswith("claude-"))), maker)
    return prices.withColumns({"model": model, "owner": owner}).withColumn("scope", F.when(F.col("owner").isNotNull(), "provider").when(F.col("key").contains("/"), "route").otherwise("any")).withColumn("tags", providers.key_tags(F.col("key")))


def lookup(wanted: DataFrame, prices: DataFrame, rates: list[str], source: str | None = None) -> DataFrame:
    """KEYS (distinct, nulls kept) of wanted, price_scope (whose prices count), and price, the best row, where there is one.

    prices: scoped_catalog() and row_billing_provider, ordinal (the catalogs' order), periods.  Custom rows come
    first, that of the billing provider before the one for all; then rows of the provider's scope, then those for
    everyone, each in the order of catalogs, native keys before routes, then by key.  For DeepSeek v4 an
    OpenRouter row with time periods comes before all catalogs.  A row without a usable rate is none.  source
    asks one catalog alone."""
    asked = wanted.select(*KEYS).distinct().withColumn("scope_wanted", providers.provider_scope(F.col("provider_id"), F.col("model_id")))
    asked = asked.withColumns({"hints": providers.provider_tags(F.col("scope_wanted")), "group_wanted": providers.grouped_provider(F.col("scope_wanted"))})
    offers = prices.where(F.coalesce(*[usable(F.col(c)) for c in rates]).isNotNull())
    offers = offers if source is None else offers.where(F.lower("catalog") == source.lower())
    offers = offers.select(F.struct(*[F.col(c) for c in prices.columns]).alias("p"))
    met = asked.join(offers, F.lower("model_id") == F.col("p.model"))
    custom = F.col("p.catalog") == "Custom"
    scoped = F.when(F.col("p.scope") == "provider", F.col("p.owner") == F.col("group_wanted")).when(F.col("p.scope") == "route", F.arrays_overlap("p.tags", "hints"))
    rank = F.when(custom & F.col("p.row_billing_provider").isNull(), CUSTOM).when(custom & (F.col("p.row_billing_provider") == F.col("billing_provider")), CUSTOM_SCOPED).when(~custom & F.coalesce(scoped, F.lit(False)), PROVIDER).when(~custom & (F.col("p.scope") == "any"), ANY)
    found = met.withColumn("rank", rank).where("rank is not null")
    order = F.struct("rank", "p.ordinal", F.col("p.key").contains("/").alias("routed"), F.lower("p.key").alias("lower"), F.col("p.key").alias("key"))
    routed = F.col("p.catalog") == "OpenRouter"
    best = found.groupBy(*KEYS, F.col("scope_wanted").alias("price_scope")).agg(F.min_by("p", order).alias("best"), F.min("rank").alias("rank"), F.min_by(F.when(routed, F.col("p")), F.when(routed, order)).alias("routed"))
    timed = is_deepseek_v4(F.col("model_id")) & (F.col("rank") >= PROVIDER) & (F.size("routed.periods") > 0)
    return best.select(*KEYS, "price_scope", F.when(F.coalesce(timed, F.lit(False)), F.col("routed")).otherwise(F.col("best")).alias("price"))


def with_prices(usage: DataFrame, prices: DataFrame, rates: list[str], source: str | None = None) -> DataFrame:
    """usage with the price row's columns beside it, null where there is none.  The rows looked up, one per distinct
    combination, are joined with nulls equal to nulls; Spark broadcasts them where they are few."""
    found = lookup(usage, prices, rates, source).select(*[F.col(c).alias(f"_k_{c}") for c in KEYS], "price_scope", "price")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in KEYS]
    joined = usage.join(found, same[0] & same[1] & same[2], "left")
    return joined.select(*usage.columns, "price_scope", "price.catalog", "price.key", "price.litellm_provider", "price.row_billing_provider", "price.periods", *[F.col(f"price.{r}") for r in rates])
