"""Queries with the SQL that an independent engine can check them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixtures import SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
_NEEDS = {"tree_small": ["tips_small"], "leaves_small": ["tips_small"]}


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to so many digits, without a negative zero."""
    return df.select(*[(F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def sql(tables: str, body: str, **ctes: str) -> str:
    """A statement over fixtures (by name, comma-separated) and further parts."""
    names: list[str] = []
    for t in filter(None, (x.strip() for x in tables.split(","))):
        names += [x for x in [*_NEEDS.get(t, []), t] if x not in names]
    parts = [f"{t} AS ({SQL[t]})" for t in names] + [f"{k} AS ({v})" for k, v in ctes.items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def r(expr: str, name: str) -> str:
    return f"ROUND({expr}, {DIGITS}) + 0 AS {name}"


def register(name: str, run: Query, oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, d: rounded(run(spark, d))
    if oracle:
        ORACLES[name] = oracle
