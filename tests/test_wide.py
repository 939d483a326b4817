"""One-hot and pivots beyond the widths that columns can take."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregate, encoding


def test_indicators_of_ten_thousand_categories(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 7 > 0, F.format_string("c%05d", F.col("id") % 10_000)).alias("c"))
    df = df.withColumn("c", F.when(F.col("id") % 3 == 0, F.lit("c00001")).otherwise(F.col("c")))  # a third of the rows
    n = df.select("c").where("c is not null").distinct().count()
    for drop, nulls in ((False, False), (True, True)):
        out = encoding.indicators(df, ["c"], drop_first=drop, null_category=nulls)
        assert out.columns == df.columns and out.count() == 20_000
        names = sorted(r["c"] for r in df.select("c").where("c is not null").distinct().collect())[int(drop) :]
        place = {v: i for i, v in enumerate(names)}
        before = {r["id"]: r["c"] for r in df.collect()}
        for row in out.collect():
            want = place.get(before[row["id"]], len(names) if nulls and before[row["id"]] is None else None)
            assert row["c"]["size"] == n - int(drop) + int(nulls)
            assert row["c"]["indices"] == ([] if want is None else [want])


def test_indicators_of_rows_not_fitted_and_vectors(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    rows = spark.createDataFrame([(1, "b", 9), (2, "z", 9), (3, None, 9), (4, "a", 9)], "id int, c string, code int")
    fitted = encoding.fit_indicators(train, ["c"])
    out = encoding.indicator_vectors(encoding.indicators(rows, ["c"], fitted), ["c"]).orderBy("id").collect()
    assert [r["c"].toArray().tolist() for r in out] == [[0, 1], [0, 0], [0, 0], [1, 0]]
    assert [r["code"] for r in out] == [9] * 4
    assert encoding.indicators(rows.where("false"), ["c"]).collect() == []


@pytest.mark.parametrize("how", ["mean", "sum", "count"])
def test_pages_make_the_pivot(spark, how):
    df = spark.createDataFrame([(i % 4 or None, f"k{i % 11}" if i % 13 else None, float(i)) for i in range(300)], "a int, b string, v double")
    whole = {r["a"]: r.asDict() for r in aggregate.pivot(df, "a", "b", "v", how).collect()}
    seen = {a: {"a": a} for a in whole}
    for page in range(4):
        for row in aggregate.pivot_page(df, "a", "b", "v", how, page, 4).collect():
            seen[row["a"]] |= row.asDict()
    assert seen == whole
    cells = {(r["row"], r["column"]): r["value"] for r in aggregate.pivot_long(df, "a", "b", "v", how).collect()}
    assert cells == {(a, b): v for a, row in whole.items() for b, v in row.items() if b != "a" and v is not None}
    assert aggregate.pivot_page(df, "a", "b", "v", how, 9, 4).columns == ["a"]
