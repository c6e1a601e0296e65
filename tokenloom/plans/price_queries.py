"""Prices and costs over the usage view: a small set of catalogs that reaches every rule, each query with its SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import providers
from ..operators import estimate, lookup
from .registry import over, query

M = 1e-6
# (catalog, ordinal, key, litellm_provider, row_billing_provider, rates in dollars a million tokens); what scoped_catalog()
# makes of the key stands beside, for the SQL: model, scope, owner, tags.
ROWS = [
    ("LiteLLM", 1, "gpt-5.4", "openai", None, {"input": 1, "output": 8, "read": 0.1, "input_272k": 2, "output_272k": 12, "read_272k": 0.2, "input_priority": 2, "output_priority": 16, "read_priority": 0.2, "input_272k_priority": 4, "output_272k_priority": 24, "input_flex": 0.5, "output_flex": 4}, "gpt-5.4", "provider", "openai", []),
    ("LiteLLM", 1, "azure/gpt-5.4", "azure", None, {"input": 1.1, "output": 8.8, "read": 0.11, "write": 1.1, "input_priority": 2.2}, "gpt-5.4", "provider", "microsoft", ["microsoft"]),
    ("OpenRouter", 2, "openai/gpt-5.4", None, None, {"input": 1.2, "output": 9}, "gpt-5.4", "route", None, ["openai"]),
    ("LiteLLM", 1, "grok-4", "xai", None, {"input": 3, "output": 15, "read": 0.75, "write": 1, "input_200k": 6, "output_200k": 30, "write_200k": 2}, "grok-4", "any", None, []),
    ("LiteLLM", 1, "claude-haiku-5-5", "anthropic", None, {"input": 1, "output": 5, "read": 0.1, "write": 1.25, "hour": 2, "input_100k": 2, "output_100k": 7.5, "read_100k": 0.2, "write_100k": 2.5}, "claude-haiku-5.5", "provider", "anthropic", []),
    ("Models.dev", 3, "vertex/claude-haiku-5.5", None, None, {"input": 1, "output": 5, "read": 0.1, "write": 1.25}, "claude-haiku-5.5", "route", None, ["google"]),
    ("OpenRouter", 2, "deepseek/deepseek-v4-pro", None, None, {"input": 0.4, "output": 1.6, "read": 0.04, "write": 0.4}, "deepseek-v4-pro", "route", None, ["deepseek"]),
    ("LiteLLM", 1, "deepseek-v4-pro", None, None, {"input": 0.5, "output": 2}, "deepseek-v4-pro", "any", None, []),
    ("Custom", 0, "house-model", None, "acme", {"input": 9, "output": 9}, "house-model", "any", None, []),
    ("Custom", 0, "house-model", None, None, {"input": 7, "output": 7, "read": 0.7, "write": 7, "hour": 14}, "house-model", "any", None, []),
    ("LiteLLM", 1, "house-model", None, None, {"input": 1}, "house-model", "any", None, []),
    ("LiteLLM", 1, "claude-opus-4-1", "anthropic", None, {"input": 15, "output": 75, "read": 1.5, "write": 18.75, "hour": 30, "input_200k": 30, "output_200k": 100, "read_200k": 3, "write_200k": 37.5, "hour_200k": 60}, "claude-opus-4.1", "provider", "anthropic", []),
    ("OpenRouter", 2, "anthropic/claude-opus-4.1", None, None, {"input": 16, "output": 80}, "claude-opus-4.1", "route", None, ["anthropic"]),
    ("Models.dev", 3, "google-vertex/claude-opus-4.1", None, None, {"input": 14, "output": 70, "read": 1.4, "write": 17, "input_128k": 20, "input_256k": 28, "output_256k": 90}, "claude-opus-4.1", "route", None, ["google"]),
    ("LiteLLM", 1, "nobody-knows", None, None, {}, "nobody-knows", "any", None, []),
]
#: Weekends are cheaper; from 16:30 to 00:30 input is cheaper still.
PERIODS = [(["Saturday", "sunday"], None, None, 0.3 * M, None, 0.03 * M, None), (None, 1630, 30, 0.2 * M, None, None, None)]
TIMED = "deepseek/deepseek-v4-pro"


def price_table(spark: SparkSession) -> DataFrame:
    rows = [(c, n, k, p, b, PERIODS if k == TIMED else [], *[rates[r] * M if r in rates else None for r in estimate.RATE_COLUMNS]) for c, n, k, p, b, rates, *_ in ROWS]
    made = spark.createDataFrame(rows, f"catalog string, ordinal int, key string, litellm_provider string, row_billing_provider string, {estimate.PERIODS}, " + ", ".join(f"{r} double" for r in estimate.RATE_COLUMNS))
    return lookup.scoped_catalog(made)


# Models and providers of the usage view, spelled so that every rule has records; bucket sizes reach every bound.
MODELS = ["gpt-5.4", "grok-4", "claude-haiku-5.5", "deepseek-v4-pro", "house-model", "nobody-knows", "claude-opus-4.1"]
SEEN = ["openai", "xai", "bedrock/anthropic", "deepseek", "x", "x", "vertex_ai"]
BILLED = f"""billed AS (SELECT input_seq, client, ts, CASE model_id {' '.join(f"WHEN 'm{i}' THEN '{m}'" for i, m in enumerate(MODELS))} END AS model_id,
  CASE CAST(input_seq % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'unknown' WHEN 3 THEN CASE model_id {' '.join(f"WHEN 'm{i}' THEN '{s}'" for i, s in enumerate(SEEN))} END ELSE 'azure' END AS provider_id,
  CASE CAST(input_seq % 17 AS INT) WHEN 0 THEN 'acme' WHEN 1 THEN 'other' END AS billing_provider,
  CASE CAST(input_seq % 11 AS INT) WHEN 0 THEN 'priority' WHEN 1 THEN 'flex' WHEN 2 THEN 'fast' WHEN 3 THEN 'turbo' WHEN 4 THEN 'default' END AS service_tier,
  input_seq % 13 = 0 AS is_aggregate, tok_input * 30 AS tok_input, tok_output * 300 AS tok_output, tok_reasoning, tok_cache_read * 150 AS tok_cache_read, tok_cache_write * 100 AS tok_cache_write,
  CASE WHEN input_seq % 7 = 0 THEN tok_cache_write * 50 ELSE 0 END AS tok_write_1h FROM usage)"""


def billed(u: DataFrame) -> DataFrame:
    """The records of BILLED."""
    seq = F.col("input_seq")
    named = lambda names: F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (f"m{i}", n)]), F.col("model_id"))
    at = lambda n, values: F.get(F.array(*[F.lit(v) if v is not None else F.lit(None).cast("string") for v in values]), (seq % n).cast("int"))
    provider = F.when(seq % 5 == 3, named(SEEN)).otherwise(at(5, [None, " ", "unknown", None, "azure"]))
    return u.select(
        "input_seq", "client", "ts", named(MODELS).alias("model_id"), provider.alias("provider_id"), at(17, ["acme", "other"] + [None] * 15).alias("billing_provider"),
        at(11, ["priority", "flex", "fast", "turbo", "default"] + [None] * 6).alias("service_tier"), (seq % 13 == 0).alias("is_aggregate"), (F.col("tok_input") * 30).alias("tok_input"), (F.col("tok_output") * 300).alias("tok_output"), "tok_reasoning",
        (F.col("tok_cache_read") * 150).alias("tok_cache_read"), (F.col("tok_cache_write") * 100).alias("tok_cache_write"), F.when(seq % 7 == 0, F.col("tok_cache_write") * 50).otherwise(0).alias("tok_write_1h"))


def _literal(v) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]::VARCHAR[]"
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) if isinstance(v, int) else f"CAST({v!r} AS DOUBLE)"


_COLUMNS = ["catalog", "ordinal", "key", "litellm_provider", "row_billing_provider", *estimate.RATE_COLUMNS, "model", "scope", "owner", "tags"]
_VALUES = ", ".join("(" + ", ".join(_literal(v) for v in (c, n, k, p, b, *[float(rates[r] * M) if r in rates else None for r in estimate.RATE_COLUMNS], *more)) + ")" for c, n, k, p, b, rates, *more in ROWS)
_SCOPES = "scopes(name, grp, hints) AS (VALUES ('openai', 'openai', ['openai']), ('xai', 'xai', ['xai']), ('bedrock/anthropic', 'bedrock', ['bedrock', 'anthropic']), ('deepseek', 'deepseek', ['deepseek']), ('x', 'x', ['x']), ('vertex_ai', 'google', ['google']), ('azure', 'microsoft', ['microsoft']), ('anthropic', 'anthropic', ['anthropic']))"
_MAKER = "CASE WHEN model_id LIKE 'gpt%' THEN 'openai' WHEN model_id LIKE 'grok%' THEN 'xai' WHEN model_id LIKE 'claude%' THEN 'anthropic' WHEN model_id LIKE 'deepseek%' THEN 'deepseek' END"


def _picked(source: str | None = None) -> str:
    only = f"AND lower(p.catalog) = '{source}'" if source else ""
    return f"""{BILLED}, prices({', '.join(_COLUMNS)}) AS (VALUES {_VALUES}), {_SCOPES},
  w AS (SELECT DISTINCT model_id, provider_id, billing_provider, CASE WHEN trim(provider_id) IN ('', 'unknown') OR provider_id IS NULL THEN {_MAKER} ELSE provider_id END AS price_scope FROM billed),
  o AS (SELECT w.*, p.* EXCLUDE (model, scope, owner, tags), CASE WHEN catalog = 'Custom' THEN CASE WHEN row_billing_provider IS NULL THEN 1 WHEN row_billing_provider = billing_provider THEN 0 END
      WHEN scope = 'provider' AND owner = s.grp OR scope = 'route' AND list_has_any(tags, s.hints) THEN 2 WHEN scope = 'any' THEN 3 END AS r
    FROM w LEFT JOIN scopes s ON s.name = w.price_scope JOIN prices p ON p.model = w.model_id WHERE coalesce({', '.join('p.' + c for c in estimate.RATE_COLUMNS)}) IS NOT NULL {only}),
  x AS (SELECT * EXCLUDE (n, r) FROM (SELECT *, row_number() OVER (PARTITION BY model_id, provider_id, billing_provider ORDER BY CASE WHEN r >= 2 AND key = '{TIMED}' THEN 1.5 ELSE r END, ordinal, contains(key, '/'), lower(key)) AS n FROM o WHERE r IS NOT NULL) WHERE n = 1)"""


_SAME = " AND ".join(f"x.{c} IS NOT DISTINCT FROM b.{c}" for c in lookup.KEYS)
for _name, _source in {"price_lookup_ranked": None, "price_lookup_forced": "openrouter"}.items():
    query(_name, f"WITH {_picked(_source)} SELECT DISTINCT b.model_id, b.provider_id, b.billing_provider, x.catalog, x.key, x.row_billing_provider FROM billed b LEFT JOIN x ON {_SAME}")(
        over(lambda u, s=_source: lookup.with_prices(billed(u).select(*lookup.KEYS).distinct(), price_table(u.sparkSession), estimate.RATE_COLUMNS, s).select(*lookup.KEYS, "catalog", "key", "row_billing_provider")))

_FOUR, _FIVE, _THREE = estimate.COMPONENTS[:4], estimate.COMPONENTS, estimate.COMPONENTS[:3]


def _error(cases: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{e}'" for c, e in cases) + " END"


def _segments(c: str, bounds: list[int]) -> str:
    """Each stretch between bounds at the last rate that there is."""
    rates, out, low = [f"coalesce(r_{c}, 0)"], [], 0
    for b in bounds:
        out.append(f"greatest(least(n_{c}, {b}) - {low}, 0) * coalesce({', '.join(rates)})")
        rates, low = [f"r_{c}_{b // 1000}k", *rates], b
    return " + ".join([*out, f"greatest(n_{c} - {low}, 0) * coalesce({', '.join(rates)})"])


_BOUNDS = {"input": [128_000, 200_000, 256_000], "output": [128_000, 200_000, 256_000], "read": [200_000], "write": [200_000], "hour": [200_000]}
_TIERED = [f"{c}_{b // 1000}k" for c, bs in _BOUNDS.items() for b in bs]
_W = "price_scope = 'openai' AND catalog IN ('LiteLLM', 'OpenRouter') AND model_id = 'gpt-5.4' AND coalesce(litellm_provider, 'openai') = 'openai'"
ESTIMATED = f"""{_picked()},
  a AS (SELECT b.*, x.* EXCLUDE (model_id, provider_id, billing_provider), least(tok_write_1h, tok_cache_write) AS n_hour, tok_cache_write - least(tok_write_1h, tok_cache_write) AS n_write, b.tok_input AS n_input, tok_output + tok_reasoning AS n_output, tok_cache_read AS n_read,
    coalesce(key = '{TIMED}', false) AS timed, hour(ts) * 100 + minute(ts) AS clock FROM billed b LEFT JOIN x ON {_SAME}),
  a1 AS (SELECT * REPLACE ({', '.join(f"CASE WHEN {_W} THEN coalesce(write{s}, input{s}) ELSE write{s} END AS write{s}" for s in ('', '_272k', '_priority', '_272k_priority', '_flex', '_272k_flex'))}) FROM a),
  a2 AS (SELECT * REPLACE (CASE WHEN timed AND (clock >= 1630 OR clock < 30) THEN 0.2 / 1e6 WHEN timed AND dayofweek(ts) IN (0, 6) THEN 0.3 / 1e6 ELSE input END AS input, CASE WHEN timed AND dayofweek(ts) IN (0, 6) THEN 0.03 / 1e6 ELSE read END AS read),
    CASE WHEN coalesce(service_tier, 'default') = 'default' THEN '' WHEN service_tier IN ('fast', 'priority') THEN '_priority' WHEN service_tier = 'flex' THEN '_flex' END AS tier, n_input + n_read + tok_cache_write AS prompt FROM a1),
  a3 AS (SELECT *, {', '.join(f"CASE tier WHEN '_priority' THEN {c}_priority WHEN '_flex' THEN {c}_flex ELSE {c} END AS s_{c}, CASE tier WHEN '_priority' THEN {c}_272k_priority WHEN '_flex' THEN {c}_272k_flex ELSE {c}_272k END AS l_{c}" for c in _FOUR)} FROM a2),
  a4 AS (SELECT *, prompt > 272000 AND coalesce({', '.join(f'{c}_272k, l_{c}' for c in _FOUR)}) IS NOT NULL AS long FROM a3),
  a5 AS (SELECT *, long OR tier <> '' AS flat, {', '.join(f"CASE WHEN long THEN l_{c} ELSE s_{c} END AS f_{c}" for c in _FOUR)} FROM a4),
  a6 AS (SELECT *, {_error([("tier IS NULL", "unsupported-service-tier"), ("is_aggregate AND long", "ambiguous-request-tier"), *[(f"flat AND {'tok_cache_write' if c == 'write' else 'n_' + c} > 0 AND f_{c} IS NULL", f"missing-service-tier-rate:{c}") for c in _FOUR]])} AS e1,
    {', '.join(f"CASE WHEN flat THEN {'f_' + c if c in _FOUR else 'NULL'} ELSE {c} END AS b_{c}" for c in _FIVE)}, {', '.join(f"CASE WHEN NOT flat THEN {c} END AS q_{c}" for c in [*_TIERED, *(f'{c}_100k' for c in _FIVE)])} FROM a5),
  a7 AS (SELECT *, {_error([(f"row_billing_provider IS NOT NULL AND n_{c} > 0 AND b_{c} IS NULL", f"missing-billing-rate:{c}") for c in _FIVE])} AS e2, coalesce(provider_id = 'xai', false) AND coalesce(q_input_200k, q_output_200k, q_read_200k) IS NOT NULL AS xai FROM a6),
  a8 AS (SELECT *, xai AND n_input + n_read >= 200000 AS high, model_id = 'claude-haiku-5.5' AND (catalog <> 'Custom' OR coalesce({', '.join(f'q_{c}_100k' for c in _FIVE)}) IS NOT NULL) AND prompt > 100000 AS card FROM a7),
  a9 AS (SELECT *, {_error([("high AND is_aggregate", "ambiguous-request-tier"), *[(f"high AND n_{c} > 0 AND q_{c}_200k IS NULL", f"missing-service-tier-rate:{c}") for c in _THREE]])} AS e3,
    {_error([("card AND is_aggregate", "ambiguous-request-tier"), *[(f"card AND n_{c} > 0 AND q_{c}_100k IS NULL", f"missing-service-tier-rate:{c}") for c in _FIVE]])} AS e4,
    {', '.join(f"CASE WHEN card THEN q_{c}_100k" + (f" WHEN high THEN q_{c}_200k" if c in _THREE else "") + f" ELSE b_{c} END AS r_{c}" for c in _FIVE)},
    {', '.join(f"CASE WHEN NOT coalesce(card, false)" + (" AND NOT xai" if c in [f'{x}_200k' for x in _THREE] else "") + f" THEN q_{c} END AS r_{c}" for c in _TIERED)} FROM a8),
  e AS (SELECT *, CASE WHEN catalog IS NOT NULL THEN coalesce(e1, e2, e3, e4, CASE WHEN n_hour > 0 AND r_hour IS NULL THEN 'missing-1h-rate' END)
    WHEN n_hour > 0 THEN 'missing-1h-rate' WHEN coalesce(service_tier, 'default') <> 'default' THEN 'missing-service-tier-rate:model' END AS pricing_error FROM a9),
  estimated AS (SELECT input_seq, client, model_id, catalog, key, CASE WHEN catalog IS NOT NULL AND pricing_error IS NULL THEN {' + '.join(_segments(c, bs) for c, bs in _BOUNDS.items())} ELSE 0 END AS cost,
    catalog IS NOT NULL AND pricing_error IS NULL AND NOT ({' OR '.join(f'n_{c} > 0 AND r_{c} IS NULL' for c in _FIVE)}) AS complete, pricing_error FROM e)"""


def estimated(u: DataFrame) -> DataFrame:
    priced = lookup.with_prices(billed(u), price_table(u.sparkSession), estimate.RATE_COLUMNS)
    return estimate.estimate(priced.withColumn("deepseek", lookup.is_deepseek_v4(F.col("model_id"))))


query("estimated_cost", f"WITH {ESTIMATED} SELECT input_seq, round(cost, 9) AS cost, complete, pricing_error FROM estimated")(
    over(lambda u: estimated(u).select("input_seq", F.round("cost", 9).alias("cost"), "complete", "pricing_error")))
query("pricing_errors", f"WITH {ESTIMATED} SELECT model_id || ': ' || pricing_error AS diagnostic, count(*) AS records FROM estimated WHERE pricing_error IS NOT NULL GROUP BY 1")(
    over(lambda u: estimated(u).where("pricing_error is not null").groupBy(F.concat_ws(": ", "model_id", "pricing_error").alias("diagnostic")).agg(F.count(F.lit(1)).alias("records"))))
query("pricing_status", f"""WITH {ESTIMATED} SELECT client, model_id, CASE WHEN bool_and(complete) THEN 'priced' WHEN bool_or(catalog IS NOT NULL AND pricing_error IS NULL) THEN 'partial' ELSE 'unpriced' END AS status,
  coalesce(array_to_string(list_sort(list(DISTINCT catalog || ' ' || key) FILTER (WHERE catalog IS NOT NULL AND pricing_error IS NULL)), ', '), '') AS sources FROM estimated GROUP BY client, model_id""")(
    over(lambda u: estimate.status(estimated(u), "client", "model_id")))

# Spellings of models and providers, and what they are canonical for: the SQL has the answers as a table.
SPELLED = [
    ("gpt-5.4", "openai/eu", "openai", "openai", "gpt", "openai"), ("Claude-Opus-4-1", " Bedrock/Anthropic ", "bedrock", "anthropic", "claude", "bedrock"), ("x/GLM-4.6", "z.ai", "zai", "zai", "glm", "zai"), ("k3-large", "Moonshot-AI", "kimi", "kimi", "kimi", "kimi"),
    ("gpt-4o", "anthropic", "anthropic", "openai", "gpt", "openai"), ("llama-3", "anthropic", "anthropic", "meta", "unknown", "meta"), ("mystery", "anthropic", "anthropic", None, "unknown", "unknown"), ("qwq-32b", "", "", "qwen", "qwen", "qwen"), ("mystery", "my-router", "my-router", None, "unknown", "my-router"),
    ("o3-mini", "gpt-4", "gpt-4", "openai", "gpt", "openai"), ("model1", "azure", "microsoft", "deepseek", "deepseek", "deepseek"), ("grok-4", "X-AI", "xai", "xai", "xai", "xai"), ("gemini-3", "google.vertex", "google", "google", "gemini", "google"), ("mimo-v2", "<none>", "<none>", "xiaomi", "mimo", "xiaomi"),
    ("command-r7b", "cohere", "cohere", None, "unknown", "cohere"), ("command-r-plus", "router/Cohere", "cohere", "cohere", "unknown", "cohere"), ("a", "the owl", "owl", None, "unknown", "owl"), ("foo1o1", "GitHub-Copilot-x", "microsoft", None, "unknown", "microsoft"), ("vertex.anthropic.claude-3", "commandcode", "commandcode", "anthropic", "claude", "commandcode"),
]
_SPELLED_SQL = ", ".join("(" + ", ".join([str(i), *map(_literal, row)]) + ")" for i, row in enumerate(SPELLED))


@query("provider_identity", f"SELECT u.input_seq, s.grouped, s.maker, s.family, s.finalized FROM usage u JOIN (VALUES {_SPELLED_SQL}) s(i, model, provider, grouped, maker, family, finalized) ON s.i = u.input_seq % {len(SPELLED)}")
@over
def provider_identity(u: DataFrame) -> DataFrame:
    spelled = u.sparkSession.createDataFrame([(i, m, p) for i, (m, p, *_) in enumerate(SPELLED)], "i int, model string, provider string")
    named = spelled.select("i", providers.grouped_provider(F.col("provider")).alias("grouped"), providers.inferred(F.col("model")).alias("maker"), providers.family(F.col("model")).alias("family"), providers.finalized_provider(F.col("provider"), F.col("model")).alias("finalized"))
    return u.select("input_seq").join(F.broadcast(named), F.col("input_seq") % len(SPELLED) == F.col("i")).drop("i")
