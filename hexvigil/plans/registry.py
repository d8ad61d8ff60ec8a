"""Collects the runnable queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexvigil import bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)``; ``views`` are prepended to the oracle as CTEs."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = bridge.with_views(views, sql)
        return fn

    return register


def r6(col: Column | str) -> Column:
    """Six digits; the nudge sends exact ties the same way in both engines."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + F.lit(1e-9), 6)


def R(expr: str) -> str:
    return f"round(({expr}) + 1e-9, 6)"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})
