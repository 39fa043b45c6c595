"""The registry: name -> (callable, SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` may name oracle views, prefixed when the SQL is handed out."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def fixed(c: Column | str, digits: int = 6) -> Column:
    """A double at a fixed number of decimals, as the SQL side casts it."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(f"decimal(24,{digits})").cast("double")


def fixed_sql(expr: str, digits: int = 6) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(24,{digits})) AS DOUBLE)"


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Dates as text and doubles at fixed decimals, for comparison by value."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if t == "date":
            c = c.cast("string")
        elif t == "double":
            c = fixed(c, digits)
        out.append(c.alias(f.name))
    return df.select(*out)
