"""Duplicate rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col, nested_to_text


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows; nested cells compare by their JSON text."""
    return nested_to_text(df).dropDuplicates()


def duplicates_table(df: DataFrame) -> DataFrame:
    """Total rows, rows beyond the first of their kind, and their share; counted before the shuffle."""
    plain = nested_to_text(df)
    sizes = plain.groupBy(*[col(c) for c in plain.columns]).agg(F.count(F.lit(1)).alias("__n"))
    out = sizes.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
    )
    return out.withColumn(
        "duplicate_pct", F.coalesce(F.try_divide(F.col("duplicate_rows") * 100.0, "total_rows"), F.lit(0.0))
    )


def duplicate_count(df: DataFrame) -> int:
    return duplicates_table(df).first()["duplicate_rows"]


def keep_one(df: DataFrame, subset: Sequence[str], order_by: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per ``subset`` value, the first or last by ``order_by``.

    ``min_by``/``max_by`` combine before the shuffle; a hot key never gathers in one task
    the way a ranked window would make it.
    """
    rank = F.struct(*[col(o) for o in order_by])
    row = F.struct(*[col(c) for c in df.columns])
    pick = F.min_by(row, rank) if keep == "first" else F.max_by(row, rank)
    return df.groupBy(*[col(s).alias(f"__key_{s}") for s in subset]).agg(pick.alias("__row")).select("__row.*")
