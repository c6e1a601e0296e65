"""What people and programs are given: tables with a total, JSON rows, footprints, labels, fingerprints."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.adapter import TOKENS
from .facts import dollars, sums

TOTAL = "TOTAL"


def models_table(fine: DataFrame, key: str = "model_id") -> DataFrame:
    """A row per key and one of totals, in one pass; costs a million tokens are null where nothing was used.
    Dearest first, the total last."""
    made = fine.rollup(key).agg(*sums("tokens", "cost_micros", "message_count"), (F.grouping(key) == 1).alias("is_total"))
    rate = F.when(F.col("tokens") > 0, F.col("cost_micros") / F.col("tokens")).alias("cost_per_million")
    label = F.when(F.col("is_total"), TOTAL).otherwise(F.col(key)).alias("label")
    shown = made.select(label, "is_total", *TOKENS, "tokens", "message_count", dollars(), rate, (F.col("tok_output") + F.col("tok_reasoning")).alias("displayed_output"))
    return shown.orderBy("is_total", F.desc("cost"), "label")


def models_json(models: DataFrame) -> DataFrame:
    """Each model row as the JSON object of the public report; one text a row, so an export is text lines."""
    tokens = F.struct(
        F.col("tok_input").alias("input"), F.col("tok_output").alias("output"), F.col("tok_reasoning").alias("reasoning"), (F.col("tok_output") + F.col("tok_reasoning")).alias("displayedOutput"),
        F.col("tok_cache_read").alias("cacheRead"), F.col("tok_cache_write").alias("cacheWrite"), F.col("tokens").alias("total"),
    )
    row = F.struct(F.col("model_id").alias("modelId"), F.col("providers").alias("provider"), "clients", tokens.alias("tokens"), "cost", F.col("session_count").alias("sessionCount"))
    return models.select(F.to_json(row).alias("value"))


def _tokens(output: bool = True) -> Column:
    own = {"input": "tok_input", "output": "tok_output", "reasoning": "tok_reasoning"}
    shown = [(F.col("tok_output") + F.col("tok_reasoning")).alias("displayedOutput")] if output else []
    return F.struct(*[F.col(c).alias(n) for n, c in own.items()], *shown, F.col("tok_cache_read").alias("cacheRead"), F.col("tok_cache_write").alias("cacheWrite"), F.col("tokens").alias("total")).alias("tokens")


def _rows(df: DataFrame, order: list[str], row: Column) -> DataFrame:
    """One row with the list of row, in the order of these columns."""
    keyed = df.select(F.struct(*[F.expr(o) for o in order], row.alias("row")).alias("x"))
    return keyed.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"]).alias("rows"))


def models_report(models: DataFrame, grouping: str, health: DataFrame | None = None, agents: DataFrame | None = None, days: DataFrame | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """The report as one JSON text: groupBy, models (dearest first), totals, and health, agents, daily and metadata where given.

    models: refold() rows of the grouping; health: client, issue, records; agents and days: rows of facts with
    tokens.  One report is one value by nature: it has a row per model, agent and day, not per record."""
    more = [c for c in ("machine", F.col("workspace_key").alias("workspaceKey") if "workspace_key" in models.columns else None, F.col("workspace_label").alias("workspaceLabel") if "workspace_label" in models.columns else None) if c is not None and (not isinstance(c, str) or c in models.columns)]
    row = F.struct(F.col("model_id").alias("modelId"), F.col("providers").alias("provider"), F.split("clients", ", ").alias("clients"), _tokens(), "cost", F.col("session_count").alias("sessionCount"), *more)
    parts = {"models": _rows(models, ["-cost as o1", "model_id as o2", "providers as o3", "clients as o4"], row)}
    if agents is not None:
        parts["agents"] = _rows(agents, ["-cost as o1", "agent as o2", "client as o3"], F.struct("agent", "client", _tokens(False), "cost", F.col("message_count").alias("messageCount"), F.col("instances").alias("instanceCount")))
    if days is not None:
        parts["daily"] = _rows(days, ["local_date as o1"], F.struct(F.col("local_date").alias("date"), _tokens(False), F.col("message_count").alias("messageCount"), F.col("turn_count").alias("turnCount"), "cost"))
    if health is not None:
        parts["health"] = _rows(health, ["client as o1", "issue as o2"], F.struct("client", "issue", "records"))
    whole = models.agg(F.struct(F.coalesce(F.sum("tokens").cast("bigint"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost")).alias("totals"))
    for name, part in parts.items():  # a row each
        whole = whole.crossJoin(F.broadcast(part.select(F.col("rows").alias(name))))
    about = [F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()]).alias("metadata")] if metadata else []
    named = [c for c in ("agents", "daily", "health") if c in parts]
    return whole.select(F.to_json(F.struct(F.lit(grouping).alias("groupBy"), "models", "totals", *named, *about)).alias("value"))


def footprint(usage: DataFrame, clients: list[str]) -> DataFrame:
    """Sessions and records of every client asked for, those without any included."""
    asked = usage.sparkSession.createDataFrame([(c,) for c in clients], "client string")
    found = usage.where(F.col("client").isin(clients)).groupBy("client").agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("records"))
    return asked.join(found, "client", "left").na.fill(0, ["sessions", "records"])


def machine_label(path: Column, labels: dict[str, str], default: str = "local") -> Column:
    """The label of the folder with most parts that holds path, compared part by part; ties by the folder's name."""
    out = F.lit(default)
    for folder in sorted(labels, key=lambda p: (-len(p.strip("/").split("/")), p), reverse=True):
        bare = folder.rstrip("/")
        out = F.when((path == bare) | path.startswith(bare + "/"), labels[folder]).otherwise(out)
    return out


def inventory_fingerprint(inventory: DataFrame, *columns: str, by: str = "client") -> DataFrame:
    """A value per group that is equal for equal multisets of rows, whatever their order: the number of rows
    and the sum of their hashes, so that partitions add up and nothing is sorted or gathered."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    value = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    return inventory.groupBy(by).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(value).cast("string")).alias("fingerprint"))
