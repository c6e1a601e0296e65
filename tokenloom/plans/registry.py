"""Where queries and their SQL are put down."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapter import USAGE_SQL, usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, with_usage: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            text = sql.strip()
            if with_usage:
                text = f"WITH {USAGE_SQL}, {text[5:]}" if text.upper().startswith("WITH ") else f"WITH {USAGE_SQL} {text}"
            SQL[name] = text
        return f

    return add


def over(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: f(usage(spark, sf_dir))
