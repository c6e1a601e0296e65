"""Names: models (ordered mapping rules), providers, workspaces, agents, and numbers for display."""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a model id contains -> who made it, tried in this order.
MAKERS = [("claude", "anthropic"), ("gpt", "openai"), ("codex", "openai"), ("gemini", "google"), ("glm", "zai"), ("deepseek", "deepseek"), ("qwen", "alibaba"), ("kimi", "moonshot"), ("grok", "xai"), ("minimax", "minimax"), ("mistral", "mistral"), ("llama", "meta")]
DATE_TAIL = re.compile(r"-(?:\d{4}-\d{2}-\d{2}|\d{8}|\d{2}-\d{2}|\d{4})$")
FREE_TAIL = re.compile(r"(?:-free|:free| \(free\))$")
CONTEXT_TAIL = re.compile(r"\[1m\]$")


def terminal(model: str) -> str:
    """The last part of a routed id, trimmed, lower case, without the prefix custom:."""
    name = model.strip().removeprefix("custom:")
    return ([p for p in name.split("/") if p] or [""])[-1].strip().lower()


def normalize_model(model: str) -> str:
    """Terminal id with release dates, free tags and context tags taken off until none is left."""
    now, before = terminal(model), None
    while now != before:
        before = now
        for tail in (DATE_TAIL, FREE_TAIL, CONTEXT_TAIL):
            cut = tail.sub("", now)
            now = cut or now
    return re.sub(r"(?<=^claude-)([a-z]+)-(\d+)-(\d+)$", r"\1-\2.\3", now)


def wildcard(pattern: str, text: str) -> bool:
    """Whole-text match where only * is special; ASCII case doesn't matter."""
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), text, re.I | re.S | re.A) is not None


def canonical(raw: str, rules: list[tuple[str, str]]) -> str:
    """The model of the first rule that any spelling of raw matches, else the normalized id."""
    spellings = [raw.strip(), terminal(raw), normalize_model(raw)]
    for pattern, model in rules:
        if any(wildcard(pattern, s) for s in spellings):
            return model
    return normalize_model(raw)


def canonicalize(df: DataFrame, column: str, rules: list[tuple[str, str]]) -> DataFrame:
    """df with model_id.  Distinct spellings alone go through Python; the result is joined back."""
    @F.pandas_udf("string")
    def mapped(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: canonical(r, rules), na_action="ignore")

    spelled = df.select(column).where(F.col(column).isNotNull()).distinct()
    return df.drop("model_id").join(spelled.withColumn("model_id", mapped(column)), column, "left") if column != "model_id" else df.withColumnRenamed(column, "_raw").join(spelled.select(F.col(column).alias("_raw"), mapped(column).alias("model_id")), "_raw", "left").drop("_raw")


def maker(model: Column) -> Column:
    out = F.lit("unknown")
    for part, name in reversed(MAKERS):
        out = F.when(F.lower(model).contains(part), name).otherwise(out)
    return out


def billing_provider(value: Column) -> Column:
    name = F.lower(F.trim(value))
    return F.when((name != "") & (name != "unknown"), name)


def normalize_workspace(df: DataFrame, raw: str) -> DataFrame:
    """workspace_key with / as separator, once each (a leading // stays), drive in upper case, no / at the end;
    workspace_label is the last part."""
    slashed = F.regexp_replace(F.trim(raw), r"\\", "/")
    host = slashed.startswith("//")
    once = F.regexp_replace(slashed, "/+", "/")
    key = F.when(host, F.concat(F.lit("/"), once)).otherwise(once)
    made = df.withColumn("_k", F.regexp_replace(key, "(?<=.)/+$", ""))
    drive = F.when(F.col("_k").rlike("^[a-z]:"), F.concat(F.upper(F.substring("_k", 1, 1)), F.expr("substring(_k, 2)"))).otherwise(F.col("_k"))
    made = made.withColumn("workspace_key", F.when(drive != "", drive)).drop("_k")
    return made.withColumn("workspace_label", F.coalesce(F.regexp_extract("workspace_key", "[^/]+$", 0), F.lit("Unknown workspace")))


def agent_name(value: Column) -> Column:
    """Zero-width characters out, blanks one each, each word's first letter upper case; UI, UX and API stay whole."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(value, "[\u200b\u200c\u200d\ufeff]", ""), r"[\s_-]+", " "))
    word = lambda w: F.when(F.upper(w).isin("UI", "UX", "API"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**30)))
    return F.array_join(F.transform(F.split(plain, " "), word), " ")


def compact(value: Column) -> Column:
    """1234567 -> 1.2M."""
    return F.when(value >= 1e9, F.concat(F.format_string("%.1f", value / 1e9), F.lit("B"))).when(value >= 1e6, F.concat(F.format_string("%.1f", value / 1e6), F.lit("M"))).when(value >= 1e3, F.concat(F.format_string("%.1f", value / 1e3), F.lit("K"))).otherwise(value.cast("string"))


def cost_per_million(cost: Column, tokens: Column) -> Column:
    rate = cost * 1e6 / F.when(tokens > 0, tokens)
    return F.when(rate.isNull(), "—").when((rate > 0) & (rate < 0.01), "<$0.01").otherwise(F.concat(F.lit("$"), F.format_number(rate, 2)))
