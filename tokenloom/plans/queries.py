"""The analytics queries over the canonical usage view, each with its DuckDB SQL."""
from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import imputation, names
from ..operators import facts, pricing, quality, rankings, reports
from . import price_queries, report_queries  # noqa: F401 - they register their queries
from .adapter import TOKENS
from .registry import QUERIES, SQL, over, query

TODAY = dt.date(2024, 1, 30)
ZONE = "Asia/Shanghai"
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in TOKENS)
ALL = f"{SUMS}, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(message_count) AS BIGINT) AS message_count"
COST = "CAST(sum(cost_micros) AS BIGINT) / 1e6 AS cost"
TURNS = "CAST(sum(CAST(is_turn_start AS INT)) AS BIGINT) AS turn_count"

def _refold_sql(keys: list[str], where: str = "") -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"g.{c} IS NOT DISTINCT FROM x.{c}" for c in keys)
    label = "coalesce(regexp_extract(g.workspace_key, '[^/]+$'), 'Unknown workspace') AS workspace_label," if "workspace_key" in keys else ""
    return f"""WITH u AS (SELECT * FROM usage {where}),
      g AS (SELECT {k}, {ALL}, {COST}, array_to_string(list_sort(list(DISTINCT provider_id)), ', ') AS providers,
        count(DISTINCT (client, session_id)) AS session_count FROM u GROUP BY {k}),
      i AS (SELECT {', '.join(dict.fromkeys([*keys, 'client']))}, sum(tokens) AS t, min(input_seq) AS s FROM u GROUP BY ALL),
      x AS (SELECT {k}, string_agg(client, ', ' ORDER BY t DESC, s, client) AS clients FROM i GROUP BY {k})
      SELECT {', '.join('g.' + c for c in keys)}, {label} {', '.join('g.' + c for c in TOKENS)}, g.tokens, g.message_count, g.cost, g.providers, x.clients, g.session_count
      FROM g JOIN x ON {on}"""


for _name, _keys in {"models_by_model": "model", "models_by_client_model": "client,model", "models_by_client_provider_model": "client,provider,model", "models_by_workspace_model": "workspace,model", "models_by_machine_model": "machine,model"}.items():
    query(_name, _refold_sql(facts.GROUPINGS[_keys]))(over(lambda u, g=_keys: facts.refold(facts.fine_models(u), g)))
query("models_client_filtered", _refold_sql(["model_id"], "WHERE client IN ('click', 'purchase', 'view')"))(over(lambda u: facts.refold(facts.fine_models(u.where(F.col("client").isin("click", "purchase", "view"))), "model")))

query("models_grouping_sets", f"SELECT client, model_id, {SUMS}, {COST} FROM usage GROUP BY GROUPING SETS ((client, model_id), (client), ())")(
    over(lambda u: u.groupingSets([["client", "model_id"], ["client"], []], "client", "model_id").agg(*facts.sums("cost_micros")).select("client", "model_id", *TOKENS, facts.dollars())))
query("totals_by_client", f"SELECT client, {SUMS}, {COST} FROM usage GROUP BY client")(over(facts.totals_by_client))
query("agents", f"SELECT client, agent, {SUMS}, CAST(sum(message_count) AS BIGINT) AS message_count, {COST}, count(DISTINCT session_id) AS instances FROM usage WHERE agent IS NOT NULL GROUP BY client, agent")(over(facts.agents))
query("daily_totals", f"SELECT local_date, client, {ALL}, {TURNS}, {COST} FROM usage GROUP BY local_date, client")(over(lambda u: facts.buckets(u, "local_date", "client")))
query("daily_client_models", f"SELECT local_date, client, model_id, {ALL}, {TURNS}, {COST} FROM usage GROUP BY ALL")(over(lambda u: facts.buckets(u, "local_date", "client", "model_id")))
query("hourly_totals", f"SELECT local_hour, client, {ALL}, {TURNS}, {COST} FROM usage GROUP BY local_hour, client")(over(lambda u: facts.buckets(u, "local_hour", "client")))
query("hourly_models", f"SELECT local_hour, machine, provider_id, model_id, {ALL}, {TURNS}, {COST} FROM usage GROUP BY ALL")(over(lambda u: facts.buckets(u, "local_hour", "machine", "provider_id", "model_id")))

_DAYS = f"d AS (SELECT local_date, {ALL}, CAST(sum(cost_micros) AS BIGINT) AS cost_micros, {TURNS} FROM usage GROUP BY local_date)"
_PERIOD = f"{ALL}, CAST(sum(turn_count) AS BIGINT) AS turn_count, CAST(sum(CAST(tokens > 0 OR message_count > 0 OR turn_count > 0 AS INT)) AS BIGINT) AS active_days, {COST}"
query("monthly_periods", f"WITH {_DAYS} SELECT CAST(date_trunc('month', local_date) AS DATE) AS start_date, CAST(year(any_value(local_date)) AS INT) AS section_year, strftime(any_value(local_date), '%B') AS label, {_PERIOD} FROM d GROUP BY 1")(over(lambda u: facts.periods(u, "monthly")))
query("weekly_periods", f"""WITH {_DAYS}, w AS (SELECT *, CAST(date_trunc('week', local_date) AS DATE) AS s FROM d)
  SELECT s AS start_date, CAST(isoyear(s) AS INT) AS section_year, 'W' || lpad(CAST(week(s) AS VARCHAR), 2, '0') || ' ' || strftime(s, '%b %d') || ' - ' || strftime(s + INTERVAL 6 DAY, '%b %d') AS label, {_PERIOD} FROM w GROUP BY s""")(over(lambda u: facts.periods(u, "weekly")))
query("sessions", f"""SELECT client, session_id, arg_min(workspace_key, input_seq) FILTER (WHERE workspace_key IS NOT NULL) AS workspace_key, array_to_string(list_sort(list(DISTINCT model_id)), ',') AS models, {ALL}, {TURNS},
  CAST(min(floor(epoch(ts))) AS BIGINT) AS first_seen, CAST(max(floor(epoch(ts))) AS BIGINT) AS last_seen, {COST} FROM usage GROUP BY client, session_id""")(over(facts.sessions))
query("session_client_summary", """WITH s AS (SELECT client, session_id, arg_min(workspace_key, input_seq) FILTER (WHERE workspace_key IS NOT NULL) AS w, CAST(min(floor(epoch(ts))) AS BIGINT) AS f, CAST(max(floor(epoch(ts))) AS BIGINT) AS l FROM usage GROUP BY ALL),
  c AS (SELECT DISTINCT client FROM usage UNION SELECT 'zz-unused')
  SELECT c.client, count(s.session_id) AS sessions, count(DISTINCT s.w) AS workspaces, CAST(coalesce(sum(l - f), 0) AS BIGINT) AS seconds, max(l) AS last_seen FROM c LEFT JOIN s ON s.client = c.client GROUP BY c.client""")(
    over(lambda u: facts.session_clients(facts.sessions(u), u.select("client").distinct().union(u.sparkSession.range(1).select(F.lit("zz-unused"))))))
query("index_invariants", "SELECT client, client AS fact FROM usage WHERE false")(over(facts.invariants))

_G = "CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_micros) AS BIGINT) AS cost_micros"


def _top(keys: str, key: str, part: str = "") -> str:
    return f"WITH g AS (SELECT {keys}, {_G} FROM usage GROUP BY {keys}) SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER ({'PARTITION BY ' + part if part else ''} ORDER BY tokens DESC, cost_micros DESC, {key}) AS n FROM g) WHERE n = 1"


query("favorite_model", _top("model_id", "model_id"))(over(lambda u: rankings.best(rankings.grouped(u, "model_id"), "model_id")))
query("favorite_client", _top("client", "client"))(over(lambda u: rankings.best(rankings.grouped(u, "client"), "client")))
query("top_client_of_day", _top("local_date, client", "client", "local_date"))(over(lambda u: rankings.best(rankings.grouped(u, "local_date", "client"), "client", ["local_date"])))


def _months(u: DataFrame) -> DataFrame:
    return u.withColumn("start_date", F.date_trunc("month", "local_date").cast("date"))


query("period_top_client", "WITH " + _top("start_date, client", "client", "start_date").removeprefix("WITH ").replace("FROM usage", "FROM (SELECT *, CAST(date_trunc('month', local_date) AS DATE) AS start_date FROM usage)"))(
    over(lambda u: rankings.best(rankings.used(rankings.grouped(_months(u), "start_date", "client")), "client", ["start_date"])))
query("period_top_model", "WITH " + _top("start_date, model_id", "model_id", "start_date").removeprefix("WITH ").replace("FROM usage", "FROM (SELECT *, CAST(date_trunc('month', local_date) AS DATE) AS start_date FROM usage)"))(
    over(lambda u: rankings.best(rankings.used(rankings.grouped(_months(u), "start_date", "model_id")), "model_id", ["start_date"])))
query("peak_hour", _top("hour", "hour").replace("FROM usage", "FROM (SELECT *, CAST(hour(local_hour) AS INT) AS hour FROM usage)"))(
    over(lambda u: rankings.best(rankings.grouped(u.withColumn("hour", F.hour("local_hour")), "hour"), "hour")))
query("weekday_profile", f"SELECT CAST(isodow(local_date) - 1 AS INT) AS weekday, {_G}, count(DISTINCT local_date) AS active_days FROM usage GROUP BY 1")(
    over(lambda u: rankings.grouped(u, "local_date").groupBy(F.weekday("local_date").alias("weekday")).agg(F.sum("tokens").cast("bigint").alias("tokens"), F.sum("cost_micros").cast("bigint").alias("cost_micros"), F.count(F.lit(1)).alias("active_days"))))
query("peak_weekday", _top("weekday", "weekday").replace("FROM usage", "FROM (SELECT *, CAST(isodow(local_date) - 1 AS INT) AS weekday FROM usage)"))(
    over(lambda u: rankings.best(rankings.grouped(u.withColumn("weekday", F.weekday("local_date")), "weekday"), "weekday")))
query("time_of_day_profile", f"""SELECT CASE WHEN hour(local_hour) BETWEEN 5 AND 11 THEN 'Morning' WHEN hour(local_hour) BETWEEN 12 AND 16 THEN 'Daytime' WHEN hour(local_hour) BETWEEN 17 AND 21 THEN 'Evening' ELSE 'Night' END AS part, {_G} FROM usage GROUP BY 1""")(
    over(lambda u: rankings.grouped(u.withColumn("part", rankings.day_parts()), "part")))
query("streaks", """WITH d AS (SELECT DISTINCT local_date FROM usage), r AS (SELECT local_date, local_date - CAST(row_number() OVER (ORDER BY local_date) AS INT) AS g FROM d),
  i AS (SELECT count(*) AS n, max(local_date) AS l FROM r GROUP BY g)
  SELECT coalesce(max(CASE WHEN l IN (DATE '2024-01-30', DATE '2024-01-29') THEN n END), 0) AS current_streak, coalesce(max(n), 0) AS longest_streak FROM i""")(over(lambda u: rankings.streaks(u, TODAY)))
query("contribution_grades", """WITH s AS (SELECT CAST(range AS DATE) AS local_date FROM range(DATE '2024-01-30' - 366, DATE '2024-01-31', INTERVAL 1 DAY)),
  g AS (SELECT s.local_date, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(cost_micros), 0) AS BIGINT) / 1e6 AS cost FROM s LEFT JOIN usage u ON u.local_date = s.local_date GROUP BY 1),
  p AS (SELECT *, ln(tokens) AS l FROM g WHERE tokens > 0), c AS (SELECT median(l) AS c, max(tokens) AS peak FROM p),
  k AS (SELECT median(abs(l - c)) AS mad, median(abs(l - c)) FILTER (WHERE abs(l - c) > 0) AS pos FROM p, c),
  z AS (SELECT g.*, peak, CASE WHEN tokens > 0 THEN round((ln(CASE WHEN tokens > 0 THEN tokens END) - c) / CASE WHEN mad > 0 THEN mad ELSE pos END, 9) END AS z FROM g, c, k)
  SELECT CAST(datediff('day', DATE '2024-01-30' - 366, local_date) // 7 AS INT) AS week_idx, CAST(dayofweek(local_date) AS INT) AS dow, local_date, tokens, cost,
    CASE WHEN tokens <= 0 THEN 0 WHEN tokens = peak OR z IS NULL THEN 5 WHEN z < -1 THEN 1 WHEN z < 0 THEN 2 WHEN z < 1 THEN 3 WHEN z < 2 THEN 4 ELSE 5 END AS grade FROM z""")(over(lambda u: rankings.calendar(u, TODAY)))
query("hour_intensity", """WITH h AS (SELECT local_hour, CAST(sum(tokens) AS BIGINT) AS tokens FROM usage GROUP BY 1), s AS (SELECT *, tokens / max(tokens) OVER (PARTITION BY CAST(local_hour AS DATE)) AS s FROM h)
  SELECT local_hour, tokens, CASE WHEN tokens <= 0 THEN 0 WHEN s <= 0.25 THEN 1 WHEN s <= 0.5 THEN 2 WHEN s <= 0.75 THEN 3 ELSE 4 END AS level FROM s""")(over(rankings.hour_intensity))
query("day_model_radar", """WITH g AS (SELECT local_date, model_id, sum(tokens) AS t, sum(cost_micros) AS c FROM usage GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY local_date ORDER BY t DESC, c DESC, model_id) AS n FROM g)
  SELECT local_date, CASE WHEN n <= 3 THEN model_id ELSE 'Others' END AS name, CAST(sum(t) AS BIGINT) AS tokens FROM r GROUP BY 1, 2""")(over(lambda u: rankings.top_and_others(u, "model_id", "local_date")))
query("overview_summary", """WITH d AS (SELECT local_date, sum(tokens) AS t, sum(cost_micros) AS c FROM usage GROUP BY 1), p AS (SELECT CAST(sum(CAST(t > 0 AS INT)) AS BIGINT) AS active_days, CAST(max(t) AS BIGINT) AS peak_tokens, max(c) / 1e6 AS peak_cost FROM d),
  w AS (SELECT CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost_micros) / 1e6 AS cost, sum(tok_cache_read) AS r, sum(tok_input + tok_cache_read + tok_cache_write) AS a, count(DISTINCT model_id) AS models, count(DISTINCT client) AS clients, count(DISTINCT (client, session_id)) AS sessions FROM usage)
  SELECT tokens, cost, CAST(least((r * 1000 + a // 2) // a, 1000) AS BIGINT) AS cache_rate, models, clients, sessions, active_days, peak_tokens, peak_cost FROM w, p""")(over(rankings.overview))

# Gates, dedup and reconciliation.
_BAD = "*, CASE WHEN input_seq % 97 = 0 THEN -1 - tok_input ELSE tok_input END AS bad_input, CASE WHEN input_seq % 101 = 0 THEN ' ' ELSE session_id END AS bad_session"


def _spoilt(u: DataFrame) -> DataFrame:
    seq = F.col("input_seq")
    return u.withColumns({"tok_input": F.when(seq % 97 == 0, -1 - F.col("tok_input")).otherwise(F.col("tok_input")), "session_id": F.when(seq % 101 == 0, F.lit(" ")).otherwise(F.col("session_id"))})


_REASON = "CASE WHEN trim(bad_session) = '' THEN 'missing-session' WHEN bad_input < 0 THEN 'invalid-usage' END"
query("quality_gate", f"WITH b AS (SELECT {_BAD} FROM usage) SELECT input_seq, {_REASON} AS reason, {_REASON} IS NULL AND greatest(bad_input, tok_output, tok_cache_read, tok_cache_write, tok_reasoning) > 0 AS accepted FROM b")(over(lambda u: quality.gate(_spoilt(u)).select("input_seq", "reason", "accepted")))
query("rejection_summary", f"WITH b AS (SELECT {_BAD} FROM usage), r AS (SELECT client, {_REASON} AS reason FROM b) SELECT client, reason, count(*) AS records FROM r WHERE reason IS NOT NULL GROUP BY ALL")(
    over(lambda u: quality.gate(_spoilt(u)).where("reason is not null").groupBy("client", "reason").agg(F.count(F.lit(1)).alias("records"))))
query("dedup_first_wins", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY client, dedup_key ORDER BY input_seq) AS n FROM usage) SELECT input_seq, client, dedup_key, tokens FROM r WHERE dedup_key IS NULL OR n = 1")(
    over(lambda u: quality.first_wins(u.select("input_seq", "client", "dedup_key", "tokens"))))
_MAXES = ", ".join(f"max({c}) AS {c}" for c in TOKENS)
query("dedup_max_merge", f"""SELECT client, dedup_key, min(input_seq) AS input_seq, arg_min(model_id, input_seq) AS model_id, arg_min(session_id, input_seq) AS session_id, {_MAXES},
  CASE WHEN count(DISTINCT provider_id) = 1 THEN min(provider_id) END AS billing_provider, count(DISTINCT provider_id) > 1 AS billing_conflicted FROM usage WHERE dedup_key IS NOT NULL GROUP BY client, dedup_key""")(over(quality.max_merge))
_RES = ", ".join(f"CAST(greatest(m.{c} * 3 - coalesce(u.{c}, 0), 0) AS BIGINT) AS {c}" for c in TOKENS)
query("snapshot_residual", f"""WITH m AS (SELECT session_id, model_id, {_MAXES} FROM usage GROUP BY ALL), u AS (SELECT session_id, model_id, {SUMS} FROM usage GROUP BY ALL),
  r AS (SELECT m.session_id, m.model_id, {_RES} FROM m LEFT JOIN u ON u.session_id = m.session_id AND u.model_id = m.model_id) SELECT * FROM r WHERE greatest({', '.join(TOKENS)}) > 0""")(
    over(lambda u: quality.snapshot_residual(u, u.select("session_id", "model_id", *[(F.col(c) * 3).alias(c) for c in TOKENS]))))
query("ownership_anti_join", "SELECT input_seq, session_id FROM usage WHERE client <> 'click' AND session_id NOT IN (SELECT session_id FROM usage WHERE client = 'click')")(
    over(lambda u: quality.owned_elsewhere(u.where("client <> 'click'").select("input_seq", "session_id"), u.where("client = 'click'"))))
query("cumulative_delta", """WITH c AS (SELECT input_seq, session_id, tok_cache_read AS c FROM usage) SELECT input_seq, CAST(greatest(c - coalesce(max(c) OVER (PARTITION BY session_id ORDER BY input_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS BIGINT) AS delta FROM c""")(
    over(lambda u: quality.cumulative_delta(u, F.col("tok_cache_read"), ["session_id"]).select("input_seq", "delta")))
query("carry_forward", """SELECT input_seq, coalesce(last_value(agent IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY input_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(agent IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY input_seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS carried FROM usage""")(
    over(lambda u: quality.carry_forward(u, F.col("agent"), ["session_id"]).select("input_seq", "carried")))
query("settlement_islands", """WITH s AS (SELECT input_seq, session_id, message_count, lead(message_count) OVER (PARTITION BY session_id ORDER BY input_seq) AS n FROM usage) SELECT input_seq, session_id, message_count FROM s WHERE n IS DISTINCT FROM message_count""")(
    over(lambda u: quality.settlements(u, F.col("message_count"), ["session_id"]).select("input_seq", "session_id", "message_count")))

# Calendar.
query("calendar_local", """WITH l AS (SELECT input_seq, timezone('Asia/Shanghai', timezone('UTC', ts)) AS t FROM usage) SELECT input_seq, CAST(t AS DATE) AS local_date, date_trunc('hour', t) AS local_hour FROM l""")(
    over(lambda u: cal.localize(u.select("input_seq", "ts"), "ts", ZONE).select("input_seq", "local_date", "local_hour")))
query("date_range_filter", f"SELECT client, {SUMS} FROM usage WHERE local_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY client")(
    over(lambda u: u.where(cal.in_range(F.col("local_date"), dt.date(2024, 1, 10), dt.date(2024, 1, 20))).groupBy("client").agg(*facts.sums())))
query("date_presets", """SELECT p.preset, CAST(sum(tokens) AS BIGINT) AS tokens FROM usage u JOIN (VALUES ('today', DATE '2024-01-30', DATE '2024-01-30'), ('week', DATE '2024-01-24', DATE '2024-01-30'), ('month', DATE '2024-01-01', DATE '2024-01-30')) p(preset, a, b) ON u.local_date BETWEEN p.a AND p.b GROUP BY 1""")(
    over(lambda u: u.select("tokens", F.explode(F.array(*[F.when(cal.in_range(F.col("local_date"), *cal.preset(p, TODAY)), F.lit(p)) for p in ("today", "week", "month")])).alias("preset")).where("preset is not null").groupBy("preset").agg(facts.total("tokens"))))

# Names, workspaces and imputation.
query("workspace_normalize", r"""WITH p AS (SELECT input_seq, CASE CAST(input_seq % 4 AS INT) WHEN 0 THEN 'c:\work\\' || session_id || '\' WHEN 1 THEN '/home//u/' || session_id || '//' WHEN 2 THEN '\\srv\share\' || session_id ELSE session_id END AS raw FROM usage)
  SELECT input_seq, CASE CAST(input_seq % 4 AS INT) WHEN 0 THEN 'C:/work/' || session_id WHEN 1 THEN '/home/u/' || session_id WHEN 2 THEN '//srv/share/' || session_id ELSE session_id END AS workspace_key, session_id AS workspace_label FROM usage""")(
    over(lambda u: names.normalize_workspace(u.select("input_seq", F.when(F.col("input_seq") % 4 == 0, F.concat(F.lit("c:\\work\\\\"), "session_id", F.lit("\\"))).when(F.col("input_seq") % 4 == 1, F.concat(F.lit("/home//u/"), "session_id", F.lit("//"))).when(F.col("input_seq") % 4 == 2, F.concat(F.lit("\\\\srv\\share\\"), "session_id")).otherwise(F.col("session_id")).alias("raw")), "raw").select("input_seq", "workspace_key", "workspace_label")))
query("impute_total_single", """WITH q AS (SELECT input_seq, tokens AS t FROM usage),
  b AS (SELECT input_seq, t, i, CAST(t * n // 100 AS BIGINT) AS f, t * n % 100 AS r FROM q, (VALUES (0, 50), (1, 20), (2, 20), (3, 5), (4, 5)) w(i, n)),
  k AS (SELECT *, row_number() OVER (PARTITION BY input_seq ORDER BY r DESC, i) AS o, t - sum(f) OVER (PARTITION BY input_seq) AS left_over FROM b),
  v AS (SELECT input_seq, i, CAST(f + CAST(o <= left_over AS INT) AS BIGINT) AS v FROM k)
  SELECT input_seq, max(v) FILTER (WHERE i = 0) AS b0, max(v) FILTER (WHERE i = 1) AS b1, max(v) FILTER (WHERE i = 2) AS b2, max(v) FILTER (WHERE i = 3) AS b3, max(v) FILTER (WHERE i = 4) AS b4 FROM v GROUP BY input_seq""")(
    over(lambda u: imputation.largest_remainder(u.select("input_seq", "tokens"), "tokens", [50, 20, 20, 5, 5]).select("input_seq", *[F.col("parts")[i].alias(f"b{i}") for i in range(5)])))
query("token_estimate", "SELECT conv_id, turn, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM conversations", with_usage=False)(
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", imputation.estimate(F.col("text")).alias("tokens")))

# Prices: seven models in three catalogs, some scoped to a provider, some missing, some tiered.
PRICES = [
    ("litellm", 0, "m0", "m0", None, 1e-6, 4e-6, 1e-7, 2e-6, 2e-6, 3e-6), ("litellm", 0, "p1/m0", "m0", "p1", 9e-7, 3e-6, 1e-7, None, None, None),
    ("openrouter", 1, "m1", "m1", None, 5e-7, 2e-6, None, None, None, 8e-7), ("models.dev", 2, "p2/m1", "m1", "p2", 6e-7, 2e-6, 5e-8, 1e-6, None, None),
    ("litellm", 0, "m2", "m2", None, None, None, None, None, None, None), ("openrouter", 1, "m2", "m2", None, 2e-6, 8e-6, 2e-7, 3e-6, None, 4e-6),
    ("models.dev", 2, "m3", "m3", "p0", 3e-6, 1.5e-5, 3e-7, 3e-6, 4e-6, 6e-6), ("litellm", 0, "m4", "m4", None, 1e-7, 1e-7, 0.0, 0.0, None, None),
    ("models.dev", 2, "m5", "m5", None, 1.25e-6, 1e-5, 1.25e-7, None, None, 2.5e-6),
]
PRICE_COLUMNS = ["catalog", "ordinal", "key", "model", "owner", "input", "output", "cache_read", "cache_write", "input_above_128k", "input_above_200k"]
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) if isinstance(v, int) else f"CAST({v!r} AS DOUBLE)" for v in row) + ")" for row in PRICES)
PRICES_SQL = f"prices({', '.join(PRICE_COLUMNS)}) AS (VALUES {_VALUES})"
_PICKED = f"""{PRICES_SQL}, w AS (SELECT DISTINCT model_id, provider_id FROM usage),
  o AS (SELECT w.model_id, w.provider_id, p.*, row_number() OVER (PARTITION BY w.model_id, w.provider_id ORDER BY CASE WHEN owner IS NULL THEN 1 ELSE 0 END, ordinal, key) AS n FROM w JOIN prices p ON p.model = w.model_id AND (p.owner IS NULL OR p.owner = w.provider_id) WHERE coalesce(p.input, p.output, p.cache_read, p.cache_write) IS NOT NULL),
  x AS (SELECT * FROM o WHERE n = 1)"""


def price_table(spark: SparkSession) -> DataFrame:
    kinds = ["string", "int", "string", "string", "string", *["double"] * 6]
    return spark.createDataFrame(PRICES, ", ".join(f"{c} {k}" for c, k in zip(PRICE_COLUMNS, kinds, strict=True)))


def priced(u: DataFrame) -> DataFrame:
    picked = pricing.pick_prices(u, price_table(u.sparkSession)).select(F.col("model_id").alias("_m"), F.col("provider_id").alias("_p"), "price.*").drop("model")
    return u.join(picked, F.col("model_id").eqNullSafe(F.col("_m")) & F.col("provider_id").eqNullSafe(F.col("_p")), "left").drop("_m", "_p")


query("price_lookup", f"WITH {_PICKED} SELECT w.model_id, w.provider_id, x.catalog, x.key FROM w LEFT JOIN x ON x.model_id = w.model_id AND x.provider_id = w.provider_id")(
    over(lambda u: priced(u.select("model_id", "provider_id").distinct()).select("model_id", "provider_id", "catalog", "key")))


def _cost(u: DataFrame) -> DataFrame:
    t = F.col("tok_input") * 1000
    parts = pricing.tiered(t, F.col("input"), [(128_000, F.col("input_above_128k")), (200_000, F.col("input_above_200k"))])
    return parts + pricing.tiered(F.col("tok_output") + F.col("tok_reasoning"), F.col("output"), []) + pricing.tiered(F.col("tok_cache_read"), F.col("cache_read"), []) + pricing.tiered(F.col("tok_cache_write"), F.col("cache_write"), [])


_INPUT_COST = """(CASE
  WHEN input_above_128k IS NULL AND input_above_200k IS NULL THEN t * coalesce(input, 0)
  WHEN input_above_128k IS NULL THEN least(t, 200000) * coalesce(input, 0) + greatest(t - 200000, 0) * input_above_200k
  WHEN input_above_200k IS NULL THEN least(t, 128000) * coalesce(input, 0) + greatest(t - 128000, 0) * input_above_128k
  ELSE least(t, 128000) * coalesce(input, 0) + greatest(least(t, 200000) - 128000, 0) * input_above_128k + greatest(t - 200000, 0) * input_above_200k END)"""
query("tiered_cost", f"""WITH {_PICKED}, c AS (SELECT u.*, x.* EXCLUDE (model_id, provider_id), tok_input * 1000 AS t FROM usage u JOIN x ON x.model_id = u.model_id AND x.provider_id = u.provider_id)
  SELECT input_seq, round({_INPUT_COST} + (tok_output + tok_reasoning) * coalesce(output, 0) + tok_cache_read * coalesce(cache_read, 0) + tok_cache_write * coalesce(cache_write, 0), 9) AS cost FROM c""")(
    over(lambda u: priced(u).where("catalog is not null").select("input_seq", F.round(_cost(u), 9).alias("cost"))))
query("service_tier_cost", f"""WITH {_PICKED}, c AS (SELECT input_seq, tok_input, input, CASE CAST(input_seq % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'priority' WHEN 2 THEN 'flex' ELSE 'turbo' END AS tier FROM usage u JOIN x ON x.model_id = u.model_id AND x.provider_id = u.provider_id),
  r AS (SELECT *, CASE WHEN tier IS NULL THEN input WHEN tier = 'priority' THEN input * 2 WHEN tier = 'flex' THEN input / 2 END AS rate FROM c)
  SELECT input_seq, round(coalesce(tok_input * rate, 0), 9) AS cost, CASE WHEN tier = 'turbo' THEN 'unsupported-service-tier' WHEN rate IS NULL AND tok_input > 0 THEN 'missing-rate' END AS pricing_error FROM r""")(
    over(lambda u: _tiers(priced(u).where("catalog is not null"))))
query("time_period_price", """WITH m AS (SELECT input_seq, hour(ts) * 60 + minute(ts) AS m, tok_input FROM usage) SELECT input_seq, round(tok_input * CASE WHEN m >= 990 OR m < 30 THEN 0.5e-6 ELSE 1e-6 END, 12) AS cost FROM m""")(
    over(lambda u: u.select("input_seq", F.round(F.col("tok_input") * F.when(pricing.in_window(F.hour("ts") * 60 + F.minute("ts"), F.lit(990), F.lit(30)), F.lit(0.5e-6)).otherwise(F.lit(1e-6)), 12).alias("cost"))))
query("cost_provenance", f"""WITH {_PICKED} SELECT u.client, bool_and(x.catalog IS NOT NULL) AS complete, coalesce(array_to_string(list_sort(list(DISTINCT x.catalog) FILTER (WHERE x.catalog IS NOT NULL)), ','), '') AS sources FROM usage u LEFT JOIN x ON x.model_id = u.model_id AND x.provider_id = u.provider_id GROUP BY u.client""")(
    over(lambda u: priced(u).groupBy("client").agg(F.bool_and(F.col("catalog").isNotNull()).alias("complete"), F.array_join(F.array_sort(F.collect_set("catalog")), ",").alias("sources"))))
query("pricing_diagnostics", f"WITH {_PICKED} SELECT u.model_id || ': no-price' AS diagnostic, count(*) AS records FROM usage u LEFT JOIN x ON x.model_id = u.model_id AND x.provider_id = u.provider_id WHERE x.catalog IS NULL GROUP BY 1")(
    over(lambda u: priced(u).where("catalog is null").groupBy(F.concat("model_id", F.lit(": no-price")).alias("diagnostic")).agg(F.count(F.lit(1)).alias("records"))))

query("models_table", f"""SELECT CASE WHEN grouping(model_id) = 1 THEN 'TOTAL' ELSE model_id END AS label, grouping(model_id) = 1 AS is_total, {ALL}, {COST},
  CASE WHEN sum(tokens) > 0 THEN CAST(sum(cost_micros) AS BIGINT) / CAST(sum(tokens) AS BIGINT) END AS cost_per_million, CAST(sum(tok_output) + sum(tok_reasoning) AS BIGINT) AS displayed_output FROM usage GROUP BY GROUPING SETS ((model_id), ())""")(
    over(lambda u: reports.models_table(facts.fine_models(u))))
query("input_footprint", """SELECT c.client, count(DISTINCT u.session_id) AS sessions, count(u.input_seq) AS records FROM (VALUES ('click'), ('purchase'), ('absent')) c(client) LEFT JOIN usage u ON u.client = c.client GROUP BY c.client""")(
    over(lambda u: reports.footprint(u, ["click", "purchase", "absent"])))
LABELS = {"/data": "any", "/data/local": "laptop", "/data/local/ws": "shared", "/data/local/ws/3": "three", "/data/re": "none"}
query("machine_labels", """WITH p AS (SELECT input_seq, '/data/' || machine || '/' || coalesce(workspace_key, 'none') || '/' || session_id AS path FROM usage)
  SELECT input_seq, CASE WHEN path LIKE '/data/local/ws/3/%' THEN 'three' WHEN path LIKE '/data/local/ws/%' THEN 'shared' WHEN path LIKE '/data/local/%' THEN 'laptop' ELSE 'any' END AS label FROM p""")(
    over(lambda u: u.select("input_seq", reports.machine_label(F.concat_ws("/", F.lit("/data"), "machine", F.coalesce("workspace_key", F.lit("none")), "session_id"), LABELS).alias("label"))))
query("inventory_fingerprint", """SELECT client, count(*)::VARCHAR || ':' || sum(CAST('0x' || substr(md5(session_id || '|' || tokens::VARCHAR), 1, 15) AS BIGINT))::VARCHAR AS fingerprint FROM usage GROUP BY client""")(
    over(lambda u: reports.inventory_fingerprint(u, "session_id", "tokens")))


def _tiers(u: DataFrame) -> DataFrame:
    tier = F.when(F.col("input_seq") % 4 == 1, "priority").when(F.col("input_seq") % 4 == 2, "flex").when(F.col("input_seq") % 4 == 3, "turbo")
    rate = pricing.service_rate(F.col("tier"), F.col("input"), F.col("input") * 2, F.col("input") / 2)
    error = F.when(F.col("tier") == "turbo", "unsupported-service-tier").when(F.col("rate").isNull() & (F.col("tok_input") > 0), "missing-rate")
    return u.withColumn("tier", tier).withColumn("rate", rate).select("input_seq", F.round(F.coalesce(F.col("tok_input") * F.col("rate"), F.lit(0.0)), 9).alias("cost"), error.alias("pricing_error"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
