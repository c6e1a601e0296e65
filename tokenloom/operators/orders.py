"""The orders in which views show their rows: a metric, its direction, and what decides between equals.

An order is a list of columns for orderBy, total over the rows of its view."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What decides between rows with an equal metric.
TIES = {
    "models": ["model_id", "workspace_label", "workspace_key", "providers", "clients"], "agents": ["agent", "client"], "detail": ["clients", "model_id", "providers"],
    "daily": ["local_date"], "hourly": ["local_hour"],
}
METRICS = {"cost": "cost", "tokens": "tokens"}


def order(view: str, by: str, descending: bool = True, columns: list[str] | None = None) -> list[Column]:
    """The order of a view by cost, tokens or date; columns: those that the rows have, for views whose keys vary.

    Models, agents and detail rows have no date: by date they follow their ties.  Days and hours do by date, in
    either direction, and by a metric equals go forward in time.  Periods keep their years together, the latest
    first, and equals go back in time."""
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    if view == "periods":
        return [way("start_date")] if by == "date" else [F.desc("section_year"), way(METRICS[by]), F.desc("start_date")]
    ties = [c for c in TIES[view] if columns is None or c in columns]
    if by == "date":
        return [way(ties[0])] if view in ("daily", "hourly") else [F.asc(c) for c in ties]
    return [way(METRICS[by]), *[F.asc(c) for c in ties]]


def default_order(view: str, columns: list[str] | None = None) -> list[Column]:
    """The order in which a view is first shown."""
    if view == "models":
        keys = ["model_id", "providers", "clients", "workspace_label", "workspace_key", "client", "provider_id", "machine"]
        return [F.desc("cost"), *[F.asc(c) for c in keys if columns is None or c in columns]]
    if view == "agents":
        return [F.desc("cost"), F.desc("tokens"), F.asc("agent"), F.asc("client")]
    if view == "sessions":
        return [F.desc("last_seen"), F.asc("client"), F.asc("session_id")]
    return [F.desc({"daily": "local_date", "hourly": "local_hour", "periods": "start_date"}[view])]


def ranked(rows: DataFrame, orders: dict[str, list[Column]], within: list[str] = ()) -> DataFrame:
    """rows with their place (from 1) in each order.  Without `within` a place is among all rows of the view, which
    has one row per model, day, hour or period; views that grow with the records are ranked within a bucket."""
    return rows.withColumns({name: F.row_number().over(Window.partitionBy(*within).orderBy(*columns)) for name, columns in orders.items()})


def share(rows: DataFrame, value: str = "tokens", within: list[str] = ()) -> DataFrame:
    """rows with share: each one's part of the whole, 0 where there is nothing."""
    whole = F.sum(value).over(Window.partitionBy(*within))
    return rows.withColumn("share", F.when(whole > 0, F.col(value) / whole).otherwise(F.lit(0.0)))
