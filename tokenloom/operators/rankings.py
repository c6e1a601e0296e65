"""Rankings, profiles, streaks and the activity calendar over daily and hourly facts."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import total


def best(df: DataFrame, key: str, by: list[str] = (), order: list[Column] | None = None) -> DataFrame:
    """Per group the row with the most tokens, then cost, then the smallest key: one aggregation, no sort."""
    order = order or [F.col("tokens"), F.col("cost_micros")]
    least = F.struct(*[(-c).alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("k"))
    return df.groupBy(*by).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), least).alias("_r")).select("_r.*")


def used(rows: DataFrame) -> DataFrame:
    """Rows with tokens: only those are ranked."""
    return rows.where("tokens > 0")


def grouped(usage: DataFrame, *keys: str) -> DataFrame:
    return usage.groupBy(*keys).agg(total("tokens"), total("cost_micros"))


def streaks(days: DataFrame, today: dt.date) -> DataFrame:
    """Longest run of consecutive active dates, and that which ends today or yesterday (gaps and islands).

    There is a row per date, so the global order is over as many rows as the calendar has days."""
    dates = days.select("local_date").distinct()
    run = dates.withColumn("_g", F.date_sub("local_date", F.row_number().over(Window.orderBy("local_date"))))
    islands = run.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.max("local_date").alias("last"))
    current = F.max(F.when(F.col("last").isin(today, today - dt.timedelta(days=1)), F.col("n")))
    return islands.agg(F.coalesce(current, F.lit(0)).alias("current_streak"), F.coalesce(F.max("n"), F.lit(0)).alias("longest_streak"))


def calendar(usage: DataFrame, today: dt.date) -> DataFrame:
    """The year's grid to today: week_idx, dow, date, tokens and a grade from 0 (none) to 5 (peak).

    Weeks start on Sunday.  Grades compare ln(tokens) of a day with the window's median, scaled by the median
    absolute deviation (or the median positive one); the largest day is the peak, as are all without a scale."""
    start = today - dt.timedelta(days=364 + (today.weekday() + 1) % 7)
    spine = usage.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(today))).alias("local_date"))
    days = usage.where(F.col("local_date").between(start, today)).groupBy("local_date").agg(total("tokens"), total("cost_micros"))
    grid = spine.join(days, "local_date", "left")
    grid = grid.select((F.datediff("local_date", F.lit(start)) / 7).cast("int").alias("week_idx"), (F.dayofweek("local_date") - 1).alias("dow"), "local_date", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("cost_micros", F.lit(0)) / 1e6).alias("cost"))
    positive = grid.where("tokens > 0").withColumn("l", F.ln("tokens"))
    center = positive.agg(F.median("l").alias("c"), F.max("tokens").alias("peak"))
    off = positive.crossJoin(F.broadcast(center)).withColumn("d", F.abs(F.col("l") - F.col("c")))  # one row
    scale = off.agg(F.first("c").alias("c"), F.first("peak").alias("peak"), F.median("d").alias("mad"), F.median(F.when(F.col("d") > 0, F.col("d"))).alias("pos"))
    joined = grid.crossJoin(F.broadcast(scale))
    s = F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("pos"))
    z = F.round((F.ln(F.when(F.col("tokens") > 0, F.col("tokens"))) - F.col("c")) / s, 9)
    grade = F.when(F.col("tokens") <= 0, 0).when(F.col("tokens") == F.col("peak"), 5).when(z.isNull(), 5).when(z < -1, 1).when(z < 0, 2).when(z < 1, 3).when(z < 2, 4).otherwise(5)
    return joined.select("week_idx", "dow", "local_date", "tokens", "cost", grade.alias("grade"))


def day_parts() -> Column:
    h = F.hour("local_hour")
    return F.when(h.between(5, 11), "Morning").when(h.between(12, 16), "Daytime").when(h.between(17, 21), "Evening").otherwise("Night")


def hour_intensity(usage: DataFrame) -> DataFrame:
    hours = usage.groupBy("local_hour").agg(total("tokens"))
    share = F.col("tokens") / F.max("tokens").over(Window.partitionBy(F.col("local_hour").cast("date")))
    level = F.when(F.col("tokens") <= 0, 0).when(share <= 0.25, 1).when(share <= 0.5, 2).when(share <= 0.75, 3).otherwise(4)
    return hours.select("local_hour", "tokens", level.alias("level"))


def top_and_others(usage: DataFrame, key: str, by: str, k: int = 3) -> DataFrame:
    """Per bucket the k largest keys and the rest as Others; as many rows per bucket as there are keys."""
    made = grouped(usage, by, key)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("tokens"), F.desc("cost_micros"), key))
    named = made.withColumn("_n", rank).withColumn("name", F.when(F.col("_n") <= k, F.col(key)).otherwise("Others"))
    return named.groupBy(by, "name").agg(F.sum("tokens").cast("bigint").alias("tokens"))


def cache_rate(read: Column, all_: Column) -> Column:
    """Tenths of a percent, rounded half up, at most 1000, in exact integers."""
    wide = lambda c: c.cast("decimal(30,0)")
    whole = F.when(all_ > 0, wide(all_))
    return F.coalesce(F.least(F.call_function("div", wide(read) * 1000 + F.call_function("div", whole, F.lit(2)), whole), F.lit(1000)), F.lit(0)).cast("bigint")


def overview(usage: DataFrame) -> DataFrame:
    days = usage.groupBy("local_date").agg(total("tokens"), total("cost_micros"))
    peaks = days.agg(F.sum((F.col("tokens") > 0).cast("bigint")).alias("active_days"), F.max("tokens").alias("peak_tokens"), (F.max("cost_micros") / 1e6).alias("peak_cost"))
    whole = usage.agg(total("tokens"), total("tok_cache_read"), total("tok_input"), total("tok_cache_write"), total("cost_micros"), F.count_distinct("model_id").alias("models"), F.count_distinct("client").alias("clients"), F.count_distinct("client", "session_id").alias("sessions"))
    prompt = F.col("tok_input") + F.col("tok_cache_read") + F.col("tok_cache_write")
    return whole.crossJoin(F.broadcast(peaks)).select("tokens", (F.col("cost_micros") / 1e6).alias("cost"), cache_rate(F.col("tok_cache_read"), prompt).alias("cache_rate"), "models", "clients", "sessions", "active_days", "peak_tokens", "peak_cost")
