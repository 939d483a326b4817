from pyspark.sql import functions as F

from millrace.llm import exact

from .brute import exact_groups
from .conftest import as_bag, frame


def test_odd_rows(odd, odd_rows):
    assert as_bag(exact.groups(odd)) == exact_groups(odd_rows)


def test_buckets_are_dealt_again(spark, odd, odd_rows):
    hashed = odd.select(exact.content_hash().alias("text_sha256"), F.lit(1000).cast("long").alias("bytes"))
    first, again = exact.buckets(hashed.distinct(), limit=6000)
    assert first >= 1 and as_bag(exact.groups(odd, limit=600)) == exact_groups(odd_rows)
    _, again = exact.buckets(hashed.distinct(), limit=1500)
    assert again


def test_one_row_of_each_group_stays_with_its_columns(odd, odd_rows):
    kept = exact.keep_one(odd)
    assert kept.columns == odd.columns
    want = sorted((r[0] for r in exact_groups(odd_rows) if r[3]), key=repr)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == want


def test_hot_copies_and_ties(spark):
    rows = [(i % 50, "same text" if i % 3 else f"own {i}", "s") for i in range(900)]
    assert as_bag(exact.groups(frame(spark, rows).repartition(5))) == exact_groups(rows)


def test_empty_table(nothing):
    assert exact.groups(nothing).collect() == [] and exact.keep_one(nothing).collect() == []
