"""Price catalogs as rows: catalog, ordinal, key, model, owner and dollars per token of each bucket.

Each is one JSON document of some thousand models, so a file is one row of a task and its models are exploded.
A price that is missing, not a number or negative is null."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pricing import usable

#: Resold models whose list price isn't what is billed.
LEFT_OUT = "github_copilot/"
PER = 1e6


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.from_json("value", schema).alias("r"))


def _rows(df: DataFrame, catalog: str, ordinal: int, rates: dict[str, Column]) -> DataFrame:
    """key's last part is the model, the part before it the owner."""
    path = F.split("key", "/")
    owner = F.when(F.size(path) > 1, F.element_at(path, F.greatest(F.size(path) - 1, F.lit(1))))
    return df.select(F.lit(catalog).alias("catalog"), F.lit(ordinal).alias("ordinal"), "key", F.element_at(path, -1).alias("model"), owner.alias("owner"), *[usable(c.try_cast("double")).alias(k) for k, c in rates.items()])


def litellm(spark: SparkSession, path: str, ordinal: int = 0) -> DataFrame:
    """An object of rows by model key, in dollars a token."""
    fields = {"input": "input_cost_per_token", "output": "output_cost_per_token", "cache_read": "cache_read_input_token_cost", "cache_write": "cache_creation_input_token_cost", "input_above_128k": "input_cost_per_token_above_128k_tokens", "input_above_200k": "input_cost_per_token_above_200k_tokens"}
    row = ", ".join(f"{c}:string" for c in fields.values())
    rows = _document(spark, path, f"map<string, struct<{row}>>").select(F.explode("r").alias("name", "v")).withColumn("key", F.lower("name")).where(~F.col("key").startswith(LEFT_OUT))
    return _rows(rows, "litellm", ordinal, {k: F.col(f"v.{c}") for k, c in fields.items()})


def openrouter(spark: SparkSession, path: str, ordinal: int = 1) -> DataFrame:
    """A list of models with prices as text; a route priced -1 for prompt and completion varies and has no price."""
    fields = {"input": "prompt", "output": "completion", "cache_read": "input_cache_read", "cache_write": "input_cache_write"}
    row = ", ".join(f"{c}:string" for c in fields.values())
    rows = _document(spark, path, f"struct<data:array<struct<id:string, pricing:struct<{row}>>>>").select(F.explode("r.data").alias("v")).withColumn("key", F.lower("v.id"))
    varies = (F.col("v.pricing.prompt").try_cast("double") == -1) & (F.col("v.pricing.completion").try_cast("double") == -1)
    none = {c: F.lit(None) for c in ("input_above_128k", "input_above_200k")}
    return _rows(rows.where(~F.coalesce(varies, F.lit(False))), "openrouter", ordinal, {k: F.col(f"v.pricing.{c}") for k, c in fields.items()} | none)


def models_dev(spark: SparkSession, path: str, ordinal: int = 2) -> DataFrame:
    """Providers of models, in dollars a million tokens; a model needs both an input and an output price."""
    fields = ("input", "output", "cache_read", "cache_write")
    cost = ", ".join(f"{c}:double" for c in fields)
    rows = _document(spark, path, f"map<string, struct<models:map<string, struct<id:string, cost:struct<{cost}>>>>>").select(F.explode("r").alias("provider", "p"))
    rows = rows.select("provider", F.explode("p.models").alias("name", "v")).withColumn("key", F.lower(F.concat_ws("/", "provider", F.coalesce("v.id", "name"))))
    none = {c: F.lit(None) for c in ("input_above_128k", "input_above_200k")}
    made = _rows(rows, "models.dev", ordinal, {c: F.col(f"v.cost.{c}") / PER for c in fields} | none)
    return made.where("input is not null and output is not null")
