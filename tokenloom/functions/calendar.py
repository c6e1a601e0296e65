"""Local dates and hours, date ranges and presets."""
from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def localize(df: DataFrame, ts: str, zone: str) -> DataFrame:
    """local_date and local_hour (wall clock) of a UTC time; an hour repeated by the clock change is one hour."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)
    return df.withColumns({"local_date": local.cast("date"), "local_hour": F.date_trunc("hour", local).cast("timestamp_ntz")})


def in_range(date: Column, since: dt.date | None = None, until: dt.date | None = None, year: int | None = None) -> Column:
    """Inclusive range on a local date; a record without date passes only where nothing is asked."""
    if since and until and since > until:
        raise ValueError("the range ends before it begins")
    out = F.lit(True)
    if since:
        out = out & (date >= F.lit(since))
    if until:
        out = out & (date <= F.lit(until))
    if year:
        out = out & date.between(F.lit(dt.date(year, 1, 1)), F.lit(dt.date(year, 12, 31)))
    return out


def preset(name: str, today: dt.date) -> tuple[dt.date, dt.date]:
    starts = {"today": today, "week": today - dt.timedelta(days=6), "month": today.replace(day=1), "year": today.replace(month=1, day=1)}
    return starts[name], today


def asked_range(today: dt.date, name: str | None = None, since: dt.date | None = None, until: dt.date | None = None, year: int | None = None) -> tuple[dt.date | None, dt.date | None]:
    """The range that is asked for by a preset, a year, or a first and last date; only one of the three may be."""
    if sum((name is not None, year is not None, since is not None or until is not None)) > 1:
        raise ValueError("a preset, a year and dates exclude each other")
    if name is not None:
        return preset(name, today)
    if year is not None:
        return dt.date(year, 1, 1), dt.date(year, 12, 31)
    if since and until and since > until:
        raise ValueError("the range ends before it begins")
    return since, until


def wall_to_epoch(wall: dt.datetime, zone: str) -> int | None:
    """Epoch seconds of a wall time: the earlier at a fold, none in a gap."""
    aware = wall.replace(tzinfo=ZoneInfo(zone), fold=0)
    back = aware.astimezone(dt.timezone.utc).astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    return int(aware.timestamp()) if back == wall else None


def decode_timestamp(value: Column) -> Column:
    """Epoch milliseconds of RFC 3339 text, seconds or milliseconds (from 1e12 on); none if not positive."""
    number = value.try_cast("double")
    ms = F.when(number >= 1e12, number).otherwise(number * 1000).cast("bigint")
    text = F.unix_millis(F.try_to_timestamp(value))
    found = F.coalesce(ms, text)
    return F.when(found > 0, found)
