"""Order, limit, sample and split. Samples and splits depend on the rows, not on their placement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.operators.joins import small_side
from millrace.session import cut_lineage


def sort_by(df: DataFrame, column: str, ascending: bool = True, then: Sequence[str] = ()) -> DataFrame:
    key = col(column).asc() if ascending else col(column).desc()
    return df.orderBy(key, *[col(t) for t in then])


def first_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*[col(o) for o in order_by]).limit(n)


def top_groups(df: DataFrame, key: str, value: str | None, n: int) -> DataFrame:
    """The ``n`` largest keys by sum of ``value`` or by row count."""
    size = F.sum(col(value)) if value else F.count(F.lit(1))
    groups = df.where(col(key).isNotNull()).groupBy(col(key)).agg(size.alias("size"))
    return groups.orderBy(F.desc("size"), col(key)).limit(n)


def hash_order(key: Sequence[str], seed: int = 42) -> Column:
    return F.xxhash64(*[col(k) for k in key], F.lit(seed))


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all), the same ones for the same key columns and seed."""
    return df.orderBy(hash_order(key, seed), *[col(k) for k in key]).limit(n)


def split(df: DataFrame, test_share: float, key: Sequence[str], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test by hash of the row key; the test share is exact up to sampling error."""
    at = F.pmod(hash_order(key, seed), F.lit(1_000_000)) < int(test_share * 1_000_000)
    return df.where(~at), df.where(at)


def stratified_split(df: DataFrame, label: str, test_share: float, key: Sequence[str], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test with the test share rounded within each class; rows that share a key stay together.

    The test rows of a class are its first ones by hash of the key. The hash at which they end is found by counts of
    ever longer beginnings of it, so rows are neither sorted nor numbered, and the split itself is a filter.
    """
    rows = df.select(col(label).alias("__label"), hash_order(key, seed).alias("__h"))
    left = F.round(F.count(F.lit(1)) * F.lit(test_share)).cast("bigint")
    classes = cut_lineage(rows.groupBy("__label").agg(left.alias("__left")).where("__left > 0"))
    for bits in (52, 40, 0):  # 4,096 parts, then as many in the part where the test rows end, then single rows
        part = F.shiftright("__h", bits)
        counted = rows.groupBy("__label", part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
        upto = F.sum("__n").over(Window.partitionBy("__label").orderBy("__part"))
        counted = counted.withColumn("__before", upto - F.col("__n")).withColumnRenamed("__label", "__of")
        ends = counted.join(classes.select("__label", "__left"), F.col("__label").eqNullSafe(F.col("__of"))).where("__before < __left and __left <= __before + __n")
        classes = small_side(ends.select("__label", (F.col("__left") - F.col("__before")).alias("__left"), "__part"))
        wanted = classes.select(F.col("__label").alias("__of"), F.col("__part").alias("__end"))
        rows = rows.join(wanted, F.col("__label").eqNullSafe(F.col("__of")) & (part == F.col("__end"))).select("__label", "__h")
    both = df.join(wanted, col(label).eqNullSafe(F.col("__of")), "left")
    test = F.coalesce(hash_order(key, seed) <= F.col("__end"), F.lit(False))
    return both.where(~test).drop("__of", "__end"), both.where(test).drop("__of", "__end")


def with_folds(df: DataFrame, k: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Fold number 0..k-1 of each row, by hash of its key."""
    return df.withColumn("fold", F.pmod(hash_order(key, seed), F.lit(k)).cast("int"))
