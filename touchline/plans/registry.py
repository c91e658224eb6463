"""Named queries and, where SQL can express them, their SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf: comparable(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Plain column types for comparison: integers as long, doubles rounded
    (never minus zero), dates and timestamps as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind in ("double", "float"):
            c = F.when(F.abs(c) < 0.5 * 10.0 ** -digits, F.lit(0.0)).otherwise(F.round(c, digits))
        elif kind == "date":
            c = c.cast("string")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        out.append(c.alias(name))
    return df.select(*out)


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of the rounding in :func:`comparable`."""
    half = f"{0.5 * 10.0 ** -digits:.{digits + 1}f}"
    return f"CASE WHEN abs({expr}) < {half} THEN 0.0 ELSE round({expr}, {digits}) END"
