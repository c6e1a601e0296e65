"""The cost of a record under one price row: time periods, service tiers, whole-request cards, marginal tiers.

A price row is wide: a column per component and condition (RATES), null where it has none.  The steps are
ordered, each takes the rates that the one before leaves, and the first error stops the rest: the record keeps
its tokens and costs nothing."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pricing import usable

COMPONENTS = ("input", "output", "read", "write", "hour")
#: Conditions and the components that may have a rate of their own under them; hour is writing for an hour.
RATES = {
    "": COMPONENTS, "_100k": COMPONENTS, "_128k": COMPONENTS[:2], "_200k": COMPONENTS, "_256k": COMPONENTS[:2], "_272k": COMPONENTS[:4],
    "_priority": COMPONENTS[:4], "_272k_priority": COMPONENTS[:4], "_flex": COMPONENTS[:4], "_272k_flex": COMPONENTS[:4],
}
RATE_COLUMNS = [f"{c}{s}" for s, cs in RATES.items() for c in cs]
#: Prompt sizes over which (xAI: from which) a whole request has other rates.
WHOLE_REQUEST, XAI_REQUEST, HAIKU_REQUEST = 272_000, 200_000, 100_000
HAIKU = "claude-haiku-5.5"
# Models whose cache writes cost what input costs where a catalog is silent.
WRITES_AS_INPUT = """
gpt-5 gpt-5-chat gpt-5-chat-latest gpt-5-codex gpt-5-mini gpt-5-nano gpt-5-pro gpt-5-search-api gpt-5.1 gpt-5.1-chat-latest
gpt-5.1-codex gpt-5.1-codex-max gpt-5.1-codex-mini gpt-5.2 gpt-5.2-chat-latest gpt-5.2-codex gpt-5.2-pro gpt-5.3-chat-latest
gpt-5.3-codex gpt-5.4 gpt-5.4-mini gpt-5.4-nano gpt-5.4-pro gpt-5.5 gpt-5.5-cyber gpt-5.5-cyber-preview gpt-5.5-pro
""".split()
PERIODS = "periods array<struct<days:array<string>,start:int,end:int,input:double,output:double,read:double,write:double>>"


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _first(cases: list[tuple[Column, str]]) -> Column:
    """The error of the first condition that holds, or null."""
    return F.coalesce(*[F.when(condition, F.lit(error)) for condition, error in cases], F.lit(None).cast("string"))


def in_period(period: Column, ts: Column) -> Column:
    """Whether a UTC time is on one of the period's days and in its [start, end) of HHMM, which may pass midnight."""
    clock, start, end = F.hour(ts) * 100 + F.minute(ts), period["start"], period["end"]
    day = period["days"].isNull() | F.exists(period["days"], lambda d: F.lower(d) == F.lower(F.date_format(ts, "EEEE")))
    return day & F.when(start.isNull() & end.isNull(), True).when(start < end, (clock >= start) & (clock < end)).when(start > end, (clock >= start) | (clock < end)).otherwise(False)


def with_periods(df: DataFrame, applies: Column, ts: str = "ts") -> DataFrame:
    """Base rates overlaid by those of the periods that hold at ts, the last in the row's order that names a rate."""
    def overlaid(c: str) -> Column:
        named = F.filter("periods", lambda p: in_period(p, F.col(ts)) & p[c].isNotNull())
        return F.when(applies & F.col(ts).isNotNull() & (F.size(named) > 0), F.element_at(named, -1)[c]).otherwise(F.col(c))

    return df.withColumns({c: overlaid(c) for c in COMPONENTS[:4]})


def with_write_rates(df: DataFrame) -> DataFrame:
    """Of models in WRITES_AS_INPUT (their key without maker and date), served by openai and priced by a catalog
    that knows no other owner, missing write rates are those of input."""
    base = F.regexp_replace(F.regexp_replace(F.lower("key"), "^openai/", ""), "-[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$", "")
    applies = (F.col("price_scope") == "openai") & F.col("catalog").isin("LiteLLM", "OpenRouter") & base.isin(WRITES_AS_INPUT) & (F.coalesce("litellm_provider", F.lit("openai")) == "openai")
    return df.withColumns({f"write{s}": F.when(F.coalesce(applies, F.lit(False)), F.coalesce(f"write{s}", f"input{s}")).otherwise(F.col(f"write{s}")) for s in ("", "_272k", "_priority", "_272k_priority", "_flex", "_272k_flex")})


def marginal(tokens: Column, base: Column, tiers: list[tuple[int, Column]]) -> Column:
    """Tokens above a bound cost its rate; a tier without a usable rate is passed over, a base without one is 0."""
    bounds = F.array(*[F.struct(F.lit(b).cast("double").alias("bound"), usable(r).alias("rate")) for b, r in tiers])
    state = F.struct(F.lit(0.0).alias("cost"), F.lit(0.0).alias("below"), F.coalesce(usable(base), F.lit(0.0)).alias("rate"))

    def step(s: Column, t: Column) -> Column:
        part = F.greatest(F.least(tokens, t["bound"]) - s["below"], F.lit(0.0)) * s["rate"]
        return F.when(t["rate"].isNull(), s).otherwise(F.struct((s["cost"] + part).alias("cost"), t["bound"].alias("below"), t["rate"].alias("rate")))

    return F.aggregate(bounds, state, step, lambda s: s["cost"] + F.greatest(tokens - s["below"], F.lit(0.0)) * s["rate"]) if tiers else tokens * F.coalesce(usable(base), F.lit(0.0))


def estimate(df: DataFrame) -> DataFrame:
    """df with cost, complete (every used component has a usable rate) and pricing_error.

    df has a record (model_id, provider_id, tok_input, tok_output, tok_reasoning, tok_cache_read, tok_cache_write,
    tok_write_1h, service_tier, is_aggregate, ts, deepseek: whether time periods hold for its model) and its price row
    (catalog, null where there is none; price_scope, key, litellm_provider, row_billing_provider, periods, RATES).  Nulls in counts
    are 0, in is_aggregate false."""
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("tok_input", "tok_output", "tok_reasoning", "tok_cache_read", "tok_cache_write", "tok_write_1h")}
    hour = F.least(F.greatest(n["tok_write_1h"], F.lit(0)), n["tok_cache_write"])
    used = {"input": n["tok_input"], "output": n["tok_output"] + n["tok_reasoning"], "read": n["tok_cache_read"], "write": n["tok_cache_write"] - hour, "hour": hour}
    made = with_write_rates(with_periods(df, F.coalesce(F.col("deepseek"), F.lit(False))))
    kept, taken = df.columns, {f"_n_{c}": x.cast("double") for c, x in used.items()}
    aggregate, none = F.coalesce(F.col("is_aggregate"), F.lit(False)), F.lit(None).cast("double")
    made = made.withColumns({**taken, "_write_all": n["tok_cache_write"].cast("double"), "_one": hour > 0})
    rate, has = lambda c: F.col(c), lambda cs: _any(F.col(c).isNotNull() for c in cs)

    # service tier
    tier = F.when(F.col("service_tier").isNull() | (F.col("service_tier") == "default"), "default").when(F.col("service_tier").isin("fast", "priority"), "priority").when(F.col("service_tier") == "flex", "flex")
    made = made.withColumn("_tier", tier)
    chosen = lambda c, s: F.when(F.col("_tier") == "priority", rate(f"{c}{s}_priority")).when(F.col("_tier") == "flex", rate(f"{c}{s}_flex")).otherwise(rate(f"{c}{s}"))
    four = COMPONENTS[:4]
    made = made.withColumns({**{f"_s_{c}": chosen(c, "") for c in four}, **{f"_l_{c}": chosen(c, "_272k") for c in four}})
    prompt = F.col("_n_input") + F.col("_n_read") + F.col("_write_all")
    made = made.withColumn("_long", (prompt > WHOLE_REQUEST) & (has(f"{c}_272k" for c in four) | has(f"_l_{c}" for c in four)))
    made = made.withColumn("_flat", F.col("_long") | (F.col("_tier") != "default"))
    made = made.withColumns({f"_f_{c}": F.when(F.col("_long"), F.col(f"_l_{c}")).otherwise(F.col(f"_s_{c}")) for c in four})
    tokens = {"input": F.col("_n_input"), "output": F.col("_n_output"), "read": F.col("_n_read"), "write": F.col("_write_all")}
    tier_error = _first([
        (F.col("_tier").isNull(), "unsupported-service-tier"), (aggregate & F.col("_long"), "ambiguous-request-tier"),
        *[(F.col("_flat") & (tokens[c] > 0) & usable(F.col(f"_f_{c}")).isNull(), f"missing-service-tier-rate:{c}") for c in four]])
    now = {c: F.when(F.col("_flat"), F.col(f"_f_{c}") if c in four else none).otherwise(rate(c)) for c in COMPONENTS}
    steps = {f"{c}{s}": F.when(~F.col("_flat"), rate(f"{c}{s}")) for s in ("_100k", "_128k", "_200k", "_256k") for c in RATES[s]}
    made = made.withColumns({"_e1": tier_error, **{f"_r_{c}": x for c, x in now.items()}, **{f"_r_{c}": x for c, x in steps.items()}})

    # a billing provider's row must price what is used
    billing_error = _first([(F.col("row_billing_provider").isNotNull() & (F.col(f"_n_{c}") > 0) & F.col(f"_r_{c}").isNull(), f"missing-billing-rate:{c}") for c in COMPONENTS])

    # xAI: the whole request
    three = COMPONENTS[:3]
    xai = F.coalesce(F.col("provider_id") == "xai", F.lit(False)) & has(f"_r_{c}_200k" for c in three)
    high = xai & (F.col("_n_input") + F.col("_n_read") >= XAI_REQUEST)
    made = made.withColumns({"_e2": billing_error, "_xai": xai, "_high": high})
    xai_error = _first([(F.col("_high") & aggregate, "ambiguous-request-tier"), *[(F.col("_high") & (F.col(f"_n_{c}") > 0) & usable(F.col(f"_r_{c}_200k")).isNull(), f"missing-service-tier-rate:{c}") for c in three]])
    made = made.withColumns({"_e3": xai_error, **{f"_r_{c}": F.when(F.col("_high"), F.col(f"_r_{c}_200k")).otherwise(F.col(f"_r_{c}")) for c in three}, **{f"_r_{c}_200k": F.when(~F.col("_xai"), F.col(f"_r_{c}_200k")) for c in three}})

    # Haiku: the whole request
    card = (F.col("model_id") == HAIKU) & ((F.col("catalog") != "Custom") | has(f"_r_{c}_100k" for c in COMPONENTS)) & (prompt > HAIKU_REQUEST)
    made = made.withColumn("_card", F.coalesce(card, F.lit(False)))
    card_error = _first([(F.col("_card") & aggregate, "ambiguous-request-tier"), *[(F.col("_card") & (F.col(f"_n_{c}") > 0) & usable(F.col(f"_r_{c}_100k")).isNull(), f"missing-service-tier-rate:{c}") for c in COMPONENTS]])
    made = made.withColumns({"_e4": card_error, **{f"_r_{c}": F.when(F.col("_card"), F.col(f"_r_{c}_100k")).otherwise(F.col(f"_r_{c}")) for c in COMPONENTS}, **{f"_r_{c}{s}": F.when(~F.col("_card"), F.col(f"_r_{c}{s}")) for s in ("_128k", "_200k", "_256k") for c in RATES[s]}})

    bounds = {"_128k": 128_000, "_200k": 200_000, "_256k": 256_000}
    cost = reduce(lambda a, b: a + b, [marginal(F.col(f"_n_{c}"), F.col(f"_r_{c}"), [(b, F.col(f"_r_{c}{s}")) for s, b in bounds.items() if c in RATES[s]]) for c in COMPONENTS])
    priced_error = F.coalesce("_e1", "_e2", "_e3", "_e4", F.when(F.col("_one") & usable(F.col("_r_hour")).isNull(), "missing-1h-rate"))
    bare_error = _first([(F.col("_one"), "missing-1h-rate"), (F.coalesce(F.col("service_tier") != "default", F.lit(False)), "missing-service-tier-rate:model")])
    found = F.col("catalog").isNotNull()
    made = made.withColumn("pricing_error", F.when(found, priced_error).otherwise(bare_error))
    good = found & F.col("pricing_error").isNull()
    covered = ~_any((F.col(f"_n_{c}") > 0) & usable(F.col(f"_r_{c}")).isNull() for c in COMPONENTS)
    return made.select(*kept, F.when(good, cost).otherwise(F.lit(0.0)).alias("cost"), (good & covered).alias("complete"), "pricing_error")


def status(estimated: DataFrame, *by: str) -> DataFrame:
    """Per group: priced (every record whole), partial or unpriced, and the price rows that were used."""
    used = F.col("catalog").isNotNull() & F.col("pricing_error").isNull()
    made = estimated.groupBy(*by).agg(F.bool_and("complete").alias("_all"), F.bool_or(used).alias("_any"), F.array_join(F.array_sort(F.collect_set(F.when(used, F.concat_ws(" ", "catalog", "key")))), ", ").alias("sources"))
    return made.select(*by, F.when(F.col("_all"), "priced").when(F.col("_any"), "partial").otherwise("unpriced").alias("status"), "sources")
