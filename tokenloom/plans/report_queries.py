"""Orders, shares, details, profiles and reports over the usage view, each query with its SQL."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import details, facts, orders, quality, rankings
from .adapter import GROUPINGS, TOKENS
from .registry import over, query

TODAY = dt.date(2024, 1, 30)
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in TOKENS)
ALL = f"{SUMS}, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(message_count) AS BIGINT) AS message_count"
COST = "CAST(sum(cost_micros) AS BIGINT) / 1e6 AS cost"
SORTS = {f"{by}_{way}": (by, way == "desc") for by in ("cost", "tokens", "date") for way in ("desc", "asc")}


def _ranks(view: str, columns: list[str], default: str, ties: str) -> str:
    """The SQL of every order of a view with these ties."""
    cols = {"first": default}
    for name, (by, down) in SORTS.items():
        way = "DESC" if down else "ASC"
        cols[name] = ties.format(way=way) if by == "date" else f"{by} {way}, " + ties.format(way="ASC")
    return ", ".join(f"CAST(row_number() OVER (ORDER BY {o}) AS INT) AS rank_{n}" for n, o in cols.items())


def _ordered(rows: DataFrame, view: str) -> DataFrame:
    made = {f"rank_{n}": orders.order(view, by, down, rows.columns) for n, (by, down) in SORTS.items()}
    return orders.ranked(rows, {"rank_first": orders.default_order(view, rows.columns), **made})


_MODELS = f"""g AS (SELECT workspace_key, model_id, coalesce(regexp_extract(workspace_key, '[^/]+$'), 'Unknown workspace') AS workspace_label, array_to_string(list_sort(list(DISTINCT provider_id)), ', ') AS providers, CAST(sum(tokens) AS BIGINT) AS tokens, {COST} FROM usage GROUP BY ALL)"""
_MODEL_TIES = "model_id, workspace_label, workspace_key NULLS FIRST, providers"
query("order_models", f"WITH {_MODELS} SELECT workspace_key, model_id, tokens, cost, {_ranks('models', [], 'cost DESC, model_id, providers, workspace_label, workspace_key NULLS FIRST', _MODEL_TIES)} FROM g")(
    over(lambda u: _ordered(facts.refold(facts.fine_models(u), "workspace,model").drop("clients"), "models").select("workspace_key", "model_id", "tokens", "cost", *[f"rank_{n}" for n in ("first", *SORTS)])))
query("order_agents", f"WITH g AS (SELECT client, agent, CAST(sum(tokens) AS BIGINT) AS tokens, {COST} FROM usage WHERE agent IS NOT NULL GROUP BY ALL) SELECT *, {_ranks('agents', [], 'cost DESC, tokens DESC, agent, client', 'agent, client')} FROM g")(
    over(lambda u: _ordered(facts.agents(u).withColumn("tokens", sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0]))).select("client", "agent", "tokens", "cost"), "agents")))
for _view, _key in {"daily": "local_date", "hourly": "local_hour"}.items():
    query(f"order_{_view}", f"WITH g AS (SELECT {_key}, CAST(sum(tokens) AS BIGINT) AS tokens, {COST} FROM usage GROUP BY 1) SELECT *, {_ranks(_view, [], _key + ' DESC', _key + ' {way}')} FROM g")(
        over(lambda u, v=_view, k=_key: _ordered(facts.buckets(u, k).select(k, "tokens", "cost"), v)))


def _period_ranks() -> str:
    out = ["CAST(row_number() OVER (ORDER BY start_date DESC) AS INT) AS rank_first"]
    for name, (by, down) in SORTS.items():
        way = "DESC" if down else "ASC"
        out.append(f"CAST(row_number() OVER (ORDER BY {f'start_date {way}' if by == 'date' else f'section_year DESC, {by} {way}, start_date DESC'}) AS INT) AS rank_{name}")
    return ", ".join(out)


query("order_periods", f"WITH g AS (SELECT CAST(date_trunc('week', local_date) AS DATE) AS start_date, CAST(sum(tokens) AS BIGINT) AS tokens, {COST} FROM usage GROUP BY 1), y AS (SELECT *, CAST(isoyear(start_date) AS INT) AS section_year FROM g) SELECT start_date, section_year, tokens, cost, {_period_ranks()} FROM y")(
    over(lambda u: _ordered(facts.periods(u, "weekly").select("start_date", "section_year", "tokens", "cost"), "periods")))
query("order_sessions", """WITH s AS (SELECT client, session_id, CAST(max(floor(epoch(ts))) AS BIGINT) AS last_seen FROM usage GROUP BY ALL)
  SELECT *, CAST(row_number() OVER (PARTITION BY client ORDER BY last_seen DESC, session_id) AS INT) AS rank FROM s""")(
    over(lambda u: orders.ranked(facts.sessions(u).select("client", "session_id", "last_seen"), {"rank": orders.default_order("sessions")}, ["client"])))

query("share_of_total", "WITH g AS (SELECT client, CAST(sum(tokens) AS BIGINT) AS tokens FROM usage GROUP BY 1) SELECT *, CASE WHEN sum(tokens) OVER () > 0 THEN tokens / sum(tokens) OVER () ELSE 0 END AS share FROM g")(
    over(lambda u: orders.share(u.groupBy("client").agg(facts.total("tokens")))))
query("day_family_shares", "WITH g AS (SELECT local_date, model_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM usage GROUP BY ALL) SELECT *, CASE WHEN sum(tokens) OVER (PARTITION BY local_date) > 0 THEN tokens / sum(tokens) OVER (PARTITION BY local_date) ELSE 0 END AS share FROM g")(
    over(lambda u: orders.share(u.groupBy("local_date", "model_id").agg(facts.total("tokens")), within=["local_date"])))

for _name in GROUPINGS:
    _slug = _name.replace(",", "_")
    _keys = list(dict.fromkeys(["local_date", "client", *GROUPINGS[_name]]))
    _provider = "" if "provider_id" in _keys else "arg_min(provider_id, input_seq) AS provider_id,"
    query(f"daily_by_{_slug}", f"SELECT {', '.join(_keys)}, {_provider} {ALL}, {COST} FROM usage GROUP BY {', '.join(_keys)}")(
        over(lambda u, g=_name: details.daily_models(u, g).drop("cost_micros")))
    _hour = ["local_hour", *[k for k in GROUPINGS[_name] if k in ("provider_id", "machine", "model_id")]]
    query(f"hourly_by_{_slug}", f"SELECT {', '.join(_hour)}, array_to_string(list_sort(list(DISTINCT client)), ', ') AS clients, {ALL}, {COST} FROM usage GROUP BY {', '.join(_hour)}")(
        over(lambda u, g=_name: details.hourly_models(u, g)))

_DETAIL = f"""d AS (SELECT local_date, client, model_id, arg_min(provider_id, input_seq) AS p, {ALL}, CAST(sum(cost_micros) AS BIGINT) AS cost_micros FROM usage GROUP BY local_date, client, model_id),
  f AS (SELECT *, row_number() OVER (PARTITION BY local_date, model_id, p ORDER BY client) AS n FROM d)"""
query("detail_rows", f"""WITH {_DETAIL}, g AS (SELECT local_date, model_id, string_agg(client, ', ' ORDER BY tokens DESC, client) AS clients, string_agg(p, ', ' ORDER BY client) FILTER (WHERE n = 1) AS providers, {ALL}, {COST} FROM f GROUP BY local_date, model_id)
  SELECT *, CAST(row_number() OVER (PARTITION BY local_date ORDER BY cost DESC, clients, model_id, providers) AS INT) AS rank FROM g""")(
    over(lambda u: orders.ranked(details.detail_rows(u), {"rank": orders.order("detail", "cost")}, ["local_date"])))

_G = "CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_micros) AS BIGINT) AS cost_micros"
_QUIET = "u AS (SELECT * FROM usage WHERE isodow(local_date) < 6 AND hour(local_hour) >= 5)"


def _quiet(u: DataFrame) -> DataFrame:
    """Records of no weekend and no night, so that profiles have empty rows."""
    return u.where((F.weekday("local_date") < 5) & (F.hour("local_hour") >= 5) & (F.hour("local_hour") <= 21))


query("weekday_profile_whole", f"""WITH u AS (SELECT * FROM usage WHERE isodow(local_date) < 6 AND hour(local_hour) BETWEEN 5 AND 21), g AS (SELECT CAST(isodow(local_date) - 1 AS INT) AS weekday, {_G}, count(DISTINCT local_date) AS active_days FROM u GROUP BY 1)
  SELECT s.weekday, coalesce(tokens, 0) AS tokens, coalesce(cost_micros, 0) AS cost_micros, coalesce(active_days, 0) AS active_days FROM (SELECT CAST(range AS INT) AS weekday FROM range(7)) s LEFT JOIN g ON g.weekday = s.weekday""")(
    over(lambda u: details.completed(rankings.grouped(_quiet(u), "local_date").groupBy(F.weekday("local_date").alias("weekday")).agg(F.sum("tokens").cast("bigint").alias("tokens"), F.sum("cost_micros").cast("bigint").alias("cost_micros"), F.count(F.lit(1)).alias("active_days")), "weekday", list(range(7)), "tokens", "cost_micros", "active_days")))
query("time_of_day_whole", f"""WITH u AS (SELECT * FROM usage WHERE isodow(local_date) < 6 AND hour(local_hour) BETWEEN 5 AND 21), g AS (SELECT CASE WHEN hour(local_hour) < 12 THEN 'Morning' WHEN hour(local_hour) < 17 THEN 'Daytime' ELSE 'Evening' END AS part, {_G} FROM u GROUP BY 1)
  SELECT s.part, coalesce(tokens, 0) AS tokens, coalesce(cost_micros, 0) AS cost_micros FROM (VALUES ('Morning'), ('Daytime'), ('Evening'), ('Night')) s(part) LEFT JOIN g ON g.part = s.part""")(
    over(lambda u: details.completed(rankings.grouped(_quiet(u).withColumn("part", rankings.day_parts()), "part"), "part", details.DAY_PARTS, "tokens", "cost_micros")))

_LADDERS = " UNION ALL ".join(f"SELECT '{n}' AS ladder, CAST({' + '.join(f'CAST({v} >= {s} AS INT)' for s in details.LADDERS[n])} - 1 AS INT) AS level FROM o, k" for n, v in {"streak": "k.n", "tokens": "o.t", "cache": "o.c // 10", "models": "o.m", "clients": "o.l"}.items())
query("achievements", f"""WITH o AS (SELECT sum(tokens) AS t, least((sum(tok_cache_read) * 1000 + sum(tok_input + tok_cache_read + tok_cache_write) // 2) // sum(tok_input + tok_cache_read + tok_cache_write), 1000) AS c, count(DISTINCT model_id) AS m, count(DISTINCT client) AS l FROM usage),
  d AS (SELECT DISTINCT local_date FROM usage), r AS (SELECT local_date, local_date - CAST(row_number() OVER (ORDER BY local_date) AS INT) AS g FROM d), i AS (SELECT count(*) AS n, max(local_date) AS l FROM r GROUP BY g),
  k AS (SELECT coalesce(max(CASE WHEN l IN (DATE '2024-01-30', DATE '2024-01-29') THEN n END), 0) AS n FROM i) {_LADDERS}""")(
    over(lambda u: details.achievements(rankings.overview(u), rankings.streaks(u, TODAY))))

# Every reason to reject a record.
_SPOILT = """b AS (SELECT input_seq, client, CASE WHEN input_seq % 83 = 0 THEN NULL ELSE model_id END AS model_id, CASE WHEN input_seq % 101 = 0 THEN ' ' ELSE session_id END AS session_id, CASE WHEN input_seq % 89 = 0 THEN NULL ELSE ts END AS ts,
  CASE WHEN input_seq % 97 = 0 THEN -1 - tok_input WHEN input_seq % 79 = 0 THEN 0 ELSE tok_input END AS tok_input, CASE WHEN input_seq % 79 = 0 THEN 0 ELSE tok_output END AS tok_output, CASE WHEN input_seq % 79 = 0 THEN 0 ELSE tok_cache_read END AS tok_cache_read,
  CASE WHEN input_seq % 79 = 0 THEN 0 ELSE tok_cache_write END AS tok_cache_write, CASE WHEN input_seq % 79 = 0 THEN 0 ELSE tok_reasoning END AS tok_reasoning, CASE WHEN input_seq % 73 = 0 THEN tok_cache_write + 1 ELSE 0 END AS tok_write_1h, CASE WHEN input_seq % 71 = 0 THEN -1 ELSE message_count END AS message_count FROM usage)"""
_REASON = "CASE WHEN coalesce(trim(model_id), '') = '' THEN 'missing-model' WHEN trim(session_id) = '' THEN 'missing-session' WHEN ts IS NULL THEN 'invalid-timestamp' WHEN tok_input < 0 OR tok_write_1h > tok_cache_write THEN 'invalid-usage' WHEN message_count < 0 THEN 'invalid-message-count' END"


def spoilt(u: DataFrame) -> DataFrame:
    """Records with something wrong for every reason, as in _SPOILT."""
    seq = F.col("input_seq")
    zero = {c: F.when(seq % 79 == 0, 0).otherwise(F.col(c)) for c in TOKENS}
    return u.withColumns({
        "tok_write_1h": F.when(seq % 73 == 0, F.col("tok_cache_write") + 1).otherwise(0), "model_id": F.when(seq % 83 != 0, F.col("model_id")), "session_id": F.when(seq % 101 == 0, F.lit(" ")).otherwise(F.col("session_id")), "ts": F.when(seq % 89 != 0, F.col("ts")),
        **zero, "tok_input": F.when(seq % 97 == 0, -1 - F.col("tok_input")).otherwise(zero["tok_input"]), "message_count": F.when(seq % 71 == 0, -1).otherwise(F.col("message_count"))})


query("acceptance", f"WITH {_SPOILT} SELECT input_seq, {_REASON} AS reason, {_REASON} IS NULL AND greatest({', '.join(TOKENS)}) > 0 AS accepted FROM b")(
    over(lambda u: quality.gate(spoilt(u), "tok_write_1h").select("input_seq", "reason", "accepted")))
query("health_summary", f"""WITH {_SPOILT}, r AS (SELECT client, {_REASON} AS reason, greatest({', '.join(TOKENS)}) > 0 AS used FROM b)
  SELECT client, coalesce(reason, CASE WHEN used THEN 'accepted' ELSE 'without-tokens' END) AS issue, count(*) AS records FROM r GROUP BY ALL""")(
    over(lambda u: quality.health(quality.gate(spoilt(u), "tok_write_1h"), "client")))
_MAXES = ", ".join(f"max({c}) AS {c}" for c in TOKENS if c != "tok_input")
query("dedup_merge_whole", f"""SELECT client, dedup_key, min(input_seq) AS input_seq, arg_min(model_id, input_seq) AS model_id, arg_min(session_id, input_seq) AS session_id, arg_min(ts, input_seq) AS ts,
    coalesce(max(tok_input) FILTER (WHERE input_seq % 3 = 0), max(tok_input)) AS tok_input, {_MAXES}, CASE WHEN count(DISTINCT provider_id) = 1 THEN min(provider_id) END AS billing_provider, count(DISTINCT provider_id) > 1 AS billing_conflicted FROM usage WHERE dedup_key IS NOT NULL GROUP BY client, dedup_key
  UNION ALL SELECT client, NULL, input_seq, model_id, session_id, ts, {', '.join(TOKENS)}, provider_id, false FROM usage WHERE dedup_key IS NULL""")(
    over(lambda u: quality.merged(u.withColumn("split", F.col("input_seq") % 3 == 0), "split")))
