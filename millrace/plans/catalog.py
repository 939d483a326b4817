"""Registry of the runnable queries: one Spark callable each, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.semantics import col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The input tables of one folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None, digits: int = 4):
    """Register ``fn(tables) -> DataFrame``; doubles are rounded so both engines compare."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(fn(Tables(spark, folder)), digits)

        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    fixes = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            fixes[f.name] = F.round(col(f.name).cast("double"), digits) + F.lit(0.0)
    return df.withColumns(fixes) if fixes else df


def r(expression: str, digits: int = 4) -> str:
    """SQL: the same rounding, without negative zeros."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)
