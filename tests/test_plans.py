"""Physical plans: what must be pushed down, and what must not appear."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.operators import ordering, outliers, stats

FOLDER = "/root/testdata/sf0.001"
LAZY = [
    "p2_value_filter", "p4_range_filter", "j1_merge_outer", "j2_top_key_rows", "d2_duplicate_count", "d3_keep_first",
    "a22_grand_totals", "e4_frequency_encode", "h14_sankey", "h23_trend_line", "w4_interpolate", "o5_stratified_split",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_join(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["p4_range_filter"](spark, FOLDER))
    assert "GreaterThanOrEqual(o_totalprice" in text and "o_orderpriority" not in text.split("ReadSchema")[1]


def test_actions_stay_in_the_jvm(spark):
    line = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    text = plan(outliers.treat(line, ["l_quantity", "l_extendedprice"], "iqr", "cap"))
    assert "Python" not in text and "Exchange" not in text


def test_value_counts_combine_before_the_shuffle(spark):
    line = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    text = plan(stats.value_counts_long(line, line.columns))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text


def test_whole_table_order_is_cut(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    chunked, chunks = ordering.with_chunks(events, [], ["ts", "event_id"], 100)
    sizes = [r["count"] for r in chunked.groupBy(ordering.CHUNK).count().collect()]
    assert chunks == len(sizes) == 10 and max(sizes) < 300
    text = plan(ordering.forward_fill(events, ["value"], ["ts", "event_id"], rows_per_chunk=100))
    assert "SinglePartition" not in text.split("BroadcastExchange")[0]


def test_hot_partition_is_cut(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("g", F.lit("one"))
    chunked, _ = ordering.with_chunks(events, ["g"], ["ts", "event_id"], 100)
    assert chunked.select(ordering.CHUNK).distinct().count() == 10
