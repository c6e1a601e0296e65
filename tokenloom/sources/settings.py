"""What a user sets: roots, labels, zone, clients, the order of price catalogs, model mappings and prices of their own."""
from __future__ import annotations

import json
import math
import os
import time
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import estimate

CATALOGS = ("LiteLLM", "OpenRouter", "Models.dev")
#: Age in seconds from which a price catalog is stale; it is used all the same.
FRESH = 3600
# Names of rates in a file of prices, by our column; those of a million tokens have per_million_tokens.
CUSTOM_RATES = {"input": "input_cost_per_token", "output": "output_cost_per_token", "read": "cache_read_input_token_cost", "write": "cache_creation_input_token_cost", "hour": "cache_creation_input_token_cost_above_1hr"}
NOTES = ("pricingSource", "source", "notes")


@dataclass(frozen=True)
class Settings:
    roots: dict[str, list[str]] = field(default_factory=dict)
    machine_labels: dict[str, str] = field(default_factory=dict)
    local_label: str = "local"
    zone: str = "UTC"
    clients: tuple[str, ...] | None = None
    price_order: tuple[str, ...] = CATALOGS

    def __post_init__(self) -> None:
        if not self.local_label.strip() or not all(label.strip() for label in self.machine_labels.values()):
            raise ValueError("a machine label is empty")
        for path in (*self.machine_labels, *(p for own in self.roots.values() for p in own)):
            if not path or not (path.startswith("/") or "://" in path):
                raise ValueError(f"not an absolute path: {path!r}")
        if sorted(self.price_order) != sorted(CATALOGS):
            raise ValueError(f"the order must name each of {', '.join(CATALOGS)} once")


def load_settings(path: str) -> Settings:
    """Settings of a JSON file; one that isn't there gives the defaults, an unknown name is an error."""
    if not os.path.exists(path):
        return Settings()
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    names = {"extraScanPaths": "roots", "machineLabels": "machine_labels", "localMachineLabel": "local_label", "timezone": "zone", "clients": "clients", "pricingOrder": "price_order"}
    if unknown := sorted(set(raw) - set(names)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    made = {names[k]: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}
    return Settings(**made)


def all_roots(defaults: dict[str, str], settings: Settings) -> dict[str, list[str]]:
    """Per client its default root and the added ones, each place once, whatever links lead to it."""
    out: dict[str, list[str]] = {}
    for client in sorted({*defaults, *settings.roots}):
        seen: dict[str, str] = {}
        for path in (*([defaults[client]] if client in defaults else []), *settings.roots.get(client, ())):
            seen.setdefault(path if "://" in path else os.path.realpath(path), path)
        out[client] = list(seen.values())
    return out


def selected_clients(wanted: list[str] | None, known: list[str]) -> list[str]:
    """The clients to answer for: all, or those asked for, which must be some and known."""
    if wanted is None:
        return sorted(known)
    if not wanted:
        raise ValueError("no client is selected")
    if strange := sorted(set(wanted) - set(known)):
        raise ValueError(f"unknown clients: {', '.join(strange)}")
    return sorted(set(wanted))


def load_mappings(path: str | None, bundled: list[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """Mapping rules (pattern, model) of a TOML file, in order, before the bundled ones unless include_defaults is false."""
    if path is None or not os.path.exists(path):
        return list(bundled)
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    rules = [(r["pattern"], r["model"]) for r in raw.get("rules", [])]
    return rules + (list(bundled) if raw.get("include_defaults", True) else [])


def _rates(entry: dict) -> dict[str, float]:
    """Dollars a token by column; raises where a rate is no finite number from 0 on, is unknown, or input and output both lack."""
    names = {}
    for column in estimate.RATE_COLUMNS:
        component = next(c for c in CUSTOM_RATES if column == c or column.startswith(f"{c}_"))
        above, tier = "", ""
        for part in column[len(component) :].split("_")[1:]:
            above, tier = (f"_above_{part}_tokens", tier) if part[0].isdigit() else (above, f"_{part}")
        base = CUSTOM_RATES[component]
        names[f"{base}{above}{tier}"] = (column, 1.0)
        million = base.replace("_per_token", "_per_million_tokens").replace("_token_cost", "_cost_per_million_tokens")
        names[f"{million}{above}{tier}"] = (column, 1e6)
    out: dict[str, float] = {}
    for name, value in entry.items():
        if name in NOTES:
            continue
        if name not in names:
            raise ValueError(f"unknown rate {name}")
        column, per = names[name]
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value < 0:
            raise ValueError(f"{name} must be a finite number from 0 on")
        out[column] = value / per
    if "input" not in out and "output" not in out:
        raise ValueError("input or output must have a rate")
    return out


def custom_prices(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The rows of a file of prices, for lookup.scoped_catalog(), and what was wrong with those left out.

    Of models that are one in lower case the last holds; a billing provider's model that is there twice is left out
    each time, and an unknown provider is no scope."""
    wrong: list[str] = []
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    found: dict[tuple[str, str | None], dict[str, float]] = {}
    for name, entry in raw.get("models", {}).items():
        try:
            found[name.lower(), None] = _rates(entry)
        except ValueError as error:
            wrong.append(f"{name}: {error}")
    scopes = [((e.get("model_id") or "").strip().lower(), (e.get("provider_id") or "").strip().lower(), e.get("pricing")) for e in raw.get("provider_overrides", [])]
    for model, provider, entry in scopes:
        twice = sum((m, p) == (model, provider) for m, p, _ in scopes) > 1
        if not model or provider in ("", "unknown") or twice or not isinstance(entry, dict):
            wrong.append(f"{provider}/{model}: " + ("there more than once" if twice else "needs a provider, a model and rates"))
            continue
        try:
            found[model, provider] = _rates(entry)
        except ValueError as error:
            wrong.append(f"{provider}/{model}: {error}")
    rows = [("Custom", 0, model, None, provider, [], *[rates.get(c) for c in estimate.RATE_COLUMNS]) for (model, provider), rates in found.items()]
    kinds = f"catalog string, ordinal int, key string, litellm_provider string, row_billing_provider string, {estimate.PERIODS}, " + ", ".join(f"{c} double" for c in estimate.RATE_COLUMNS)
    return spark.createDataFrame(rows, kinds), wrong


def staleness(path: str, now: float | None = None) -> str:
    """missing, fresh or stale: how old a catalog's file is."""
    if not os.path.exists(path):
        return "missing"
    return "fresh" if (time.time() if now is None else now) - os.path.getmtime(path) < FRESH else "stale"
