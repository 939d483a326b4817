"""Full joins with heavy keys equal plain ones, and no task gets a key alone."""

import statistics

import pytest
from pyspark.sql import functions as F

from millrace.operators import joins


def bag(df):
    return sorted(map(repr, map(tuple, df.collect())))


def sides(spark, n, nulls=3):
    left = spark.range(n).select(F.col("id").alias("x"), F.when(F.col("id") % 2 == 1, F.col("id") % 211).alias("k"))
    right = spark.range(nulls + 300).select(F.col("id").alias("y"), F.when(F.col("id") >= nulls, F.col("id") - nulls).alias("k"))
    return left.repartition(5), right.repartition(3)


@pytest.mark.parametrize("nulls", [0, 3, 200])
def test_equals_a_plain_join(spark, nulls):
    left, right = sides(spark, 1200, nulls)
    want = left.join(right.withColumnRenamed("k", "r"), F.col("k").eqNullSafe(F.col("r")), "full")
    got = joins.merge(left, right, "k", "k", "outer")
    assert got.columns == ["x", "k", "y"]
    assert bag(got.select("x", "y", "k")) == bag(want.select("x", "y", F.coalesce("k", "r")))


def test_heavy_on_one_side_or_both(spark):
    left = spark.createDataFrame([(i, "a" if i < 50 else "b" if i < 90 else f"k{i}", {"m": i}) for i in range(100)], "x int, k string, extra map<string,int>")
    right = spark.createDataFrame([(i, "a" if i < 30 else "c" if i < 80 else f"k{i + 12}") for i in range(100)], "y int, other string")
    want = left.join(right, F.col("k") == F.col("other"), "full")
    got = joins.merge(left, right, "k", "other", "outer")
    text = lambda df: bag(df.withColumn("extra", F.to_json("extra")).select("x", "k", "extra", "y", "other"))
    assert text(got) == text(want) and got.count() == 50 * 30 + 40 + 50 + (10 + 20 - 8)


def test_empty_sides(spark):
    left, right = sides(spark, 400)
    for a, b in ((left, right.limit(0)), (left.limit(0), right), (left.limit(0), right.limit(0))):
        want = a.join(b.withColumnRenamed("k", "r"), F.col("k").eqNullSafe(F.col("r")), "full")
        assert bag(joins.merge(a, b, "k", "k", "outer").select("x", "y")) == bag(want.select("x", "y"))


def test_tasks_are_even(spark):
    """Half of all keys are null: the largest task of the result has at most three times the rows of the median."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = sides(spark, 40_000)
        out = joins.merge(left, right, "k", "k", "outer")
        # The rows of a heavy key with partners; the light ones and those without partners are dealt as ever.
        sizes = [r["count"] for r in out.where("k IS NULL").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 60_000 and len(sizes) >= 3 and max(sizes) <= 3 * statistics.median(sizes)
