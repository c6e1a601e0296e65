"""From files to answers: records of all clients, named, gated, deduplicated and priced, as the usage that facts fold."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, names, providers
from ..operators import estimate, lookup, quality, reports
from ..sources import readers
from ..sources.settings import Settings, selected_clients
from .adapter import TOKENS

#: The model that a client writes where it doesn't know one: never priced.
UNPRICED = ["commandcode-model-unknown"]


def arrival(records: DataFrame) -> DataFrame:
    """records with input_seq in order of client, file and place in the file: one order over all files.

    It is a struct turned to text of fixed width, so that comparing it needs no sort of everything."""
    place = F.concat_ws("\u0001", "client", "input_path", F.lpad(F.col("input_seq").cast("string"), 20, "0"))
    return records.withColumn("input_seq", place)


def usage_from(spark: SparkSession, roots: dict[str, str], settings: Settings | None = None, rules: list[tuple[str, str]] = (), prices: DataFrame | None = None, merge_claude: bool = False) -> tuple[DataFrame, DataFrame]:
    """(usage, rejected): the records of clients under roots, ready for facts, and those that the gate rejected, with
    their reason.

    Records are read in one order; models get their canonical id (distinct spellings are looked at once) and
    providers theirs; the gate splits them; of records with one key the first stays (with merge_claude, claude's,
    which are written anew while a message grows, are merged instead); prices (scoped_catalog() rows of all catalogs)
    give a cost, or none.  An unpriced id costs nothing and is never complete."""
    settings = settings or Settings()
    wanted = selected_clients(settings.clients, sorted(roots))
    records = arrival(readers.read_all(spark, {c: roots[c] for c in wanted}, settings.zone))
    made = records.withColumnRenamed("model_id", "raw_model_id").withColumn("billing_provider", names.billing_provider(F.col("provider_id")))
    made = names.canonicalize(made, "raw_model_id", list(rules)) if rules else made.withColumn("model_id", F.col("raw_model_id"))
    spelled = made.select("provider_id", "model_id").distinct().select(F.col("provider_id").alias("_p"), F.col("model_id").alias("_m"), providers.finalized_provider(F.col("provider_id"), F.coalesce("model_id", F.lit(""))).alias("grouped"))
    made = made.join(spelled, F.col("provider_id").eqNullSafe(F.col("_p")) & F.col("model_id").eqNullSafe(F.col("_m")), "left").withColumn("provider_id", F.col("grouped")).drop("_p", "_m", "grouped", "raw_model_id")
    time = F.timestamp_millis("timestamp_ms").cast("timestamp_ntz")
    made = made.withColumns({"ts": time, "machine": reports.machine_label(F.col("input_path"), settings.machine_labels, settings.local_label), "service_tier": F.lit(None).cast("string"), "is_aggregate": F.lit(False), "tok_write_1h": F.coalesce("tok_write_1h", F.lit(0).cast("bigint")), "is_turn_start": F.coalesce("is_turn_start", F.lit(False))})
    made = calendar.localize(made, "ts", settings.zone)
    gated = quality.gate(made, "tok_write_1h")
    fit = gated.where("accepted").drop("reason", "accepted")
    merging, copied = merge_claude and "claude" in wanted, F.col("client") == "claude"
    kept = fit.where(~copied) if merging else fit
    kept = quality.first_wins(kept)
    if merging:
        kept = kept.unionByName(quality.merge_copies(fit.where(copied), "input_split", "tok_write_1h"))
    kept = kept.drop("input_split")
    kept = kept.withColumn("tokens", sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0])))
    if prices is None:
        priced = kept.withColumns({"cost": F.lit(0.0), "complete": F.lit(False), "pricing_error": F.lit(None).cast("string")})
    else:
        priced = lookup.with_prices(kept, prices, estimate.RATE_COLUMNS).withColumn("deepseek", lookup.is_deepseek_v4(F.col("model_id")))
        unpriced = F.col("model_id").isin(UNPRICED)
        priced = estimate.estimate(priced).withColumns({"cost": F.when(unpriced, 0.0).otherwise(F.col("cost")), "complete": F.col("complete") & ~unpriced})
        priced = priced.select(*kept.columns, "catalog", "key", "cost", "complete", "pricing_error")
    usage = priced.withColumn("cost_micros", F.round(F.col("cost") * 1e6).cast("bigint"))
    return usage, gated.where("reason is not null").select("client", "input_path", "input_seq", "reason")
