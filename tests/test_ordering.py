"""Chunked windows must equal plain ones wherever the chunk borders fall."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import ordering as o
from millrace.operators import stats


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 400
    # one key holds more than a third of the rows
    key = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcdefgh"), n))
    v = rng.normal(size=n).round(3)
    v[rng.random(n) < 0.5] = np.nan
    pdf = pd.DataFrame({"g": key, "t": rng.permutation(n), "v": v, "w": rng.integers(0, 9, n).astype(float)})
    pdf.loc[pdf.g == "b", "v"] = np.nan
    return pdf


def load(spark, pdf):
    rows = [(r.g, int(r.t), None if np.isnan(r.v) else float(r.v), float(r.w)) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "g string, t bigint, v double, w double").repartition(4)


def series(df, name):
    return df.select("t", name).toPandas().sort_values("t")[name].astype(float).to_numpy()


@pytest.mark.parametrize("size", [None, 60])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_fills(spark, frame, size, by):
    df = load(spark, frame)
    srt = frame.sort_values("t")
    part = srt.groupby("g").v if by else srt.v
    for fill, want in (
        (o.forward_fill, part.ffill()),
        (o.backward_fill, part.bfill()),
        (o.interpolate, part.transform(lambda s: s.interpolate()) if by else srt.v.interpolate()),
    ):
        got = series(fill(df, ["v"], ["t"], by, size), "v")
        np.testing.assert_allclose(got, want.to_numpy(), atol=1e-9)


@pytest.mark.parametrize("fill", [o.backward_fill, o.interpolate])
def test_backward_is_one_pass(spark, fill):
    """No frame ends with the partition: Spark evaluates such a frame anew for each row, the square of a range's rows."""
    df = spark.range(400_000).select("id", F.when(F.col("id") % 1000 == 999, F.col("id").cast("double")).alias("v"))
    for size in (None, 150_000):
        out = fill(df, ["v"], ["id"], (), size)
        assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
        want = F.when(F.col("id") < 999, 999.0).otherwise(F.col("id")) if fill is o.interpolate else F.col("id") + 999 - F.col("id") % 1000
        if fill is o.backward_fill:
            assert out.where(~F.col("v").eqNullSafe(want.cast("double"))).isEmpty()


def test_backward_order_of_gaps_and_nan(spark):
    """Nulls come first and NaN last in the order, backward too."""
    rows = [(None, 1.0), (float("nan"), 5.0), (float("inf"), None), (0.0, None), (-1.0, 2.0)]
    df = spark.createDataFrame(rows, "t double, v double")
    for size in (None, 2):
        got = {str(r["t"]): r["v"] for r in o.backward_fill(df, ["v"], ["t"], (), size).collect()}
        assert got == {"None": 1.0, "-1.0": 2.0, "0.0": 5.0, "inf": 5.0, "nan": 5.0}


@pytest.mark.parametrize("size", [None, 60])
def test_position_sum_average(spark, frame, size):
    df = load(spark, frame)
    srt = frame.sort_values("t")
    assert list(series(o.with_position(df, ["t"], "p", size), "p")) == list(range(1, len(frame) + 1))
    np.testing.assert_allclose(series(o.running_sum(df, "w", ["t"], "s", size), "s"), srt.w.cumsum())
    for by, roll in (([], srt.w.rolling(30).mean()), (["g"], srt.groupby("g").w.transform(lambda s: s.rolling(30).mean()))):
        got = series(o.moving_average(df, "w", ["t"], (7, 30), by, size), "w_ma30")
        np.testing.assert_allclose(got, roll.to_numpy(), atol=1e-9)


@pytest.mark.parametrize("bins", [65536, 40])
def test_quantiles(spark, frame, monkeypatch, bins):
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    monkeypatch.setattr(stats, "BINS_PER_SCAN", bins)
    got = stats.exact_quantiles(load(spark, frame), ["v", "w"], probs)
    for c in ("v", "w"):
        np.testing.assert_allclose(got[c], frame[c].quantile(probs))


@pytest.mark.parametrize("bins", [65536, 2])
def test_quantiles_of_odd_values(spark, monkeypatch, bins):
    """NaN counts as null, infinities come first and last; doubles of any size end the search."""
    monkeypatch.setattr(stats, "BINS_PER_SCAN", bins)
    inf, nan = float("inf"), float("nan")
    columns = {
        "odd": [nan, inf, -inf, 1.0, 2.0, None, 3.0, inf],
        "huge": [-1.7e308, 1.7e308, 0.0, 1e300, -1e300, 5.0, None, nan],
        "tiny": [5e-324 * k for k in range(8)],
        "none": [nan, None] * 4,
        "ends": [inf, -inf] * 4,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    probs = [0.0, 0.2, 0.5, 1.0]
    got = stats.exact_quantiles(df, list(columns), probs)
    for c, values in columns.items():
        known = sorted(v for v in values if v is not None and v == v)
        for p, q in zip(probs, got[c]):
            at = (len(known) - 1) * p
            if not known:
                assert q is None
                continue
            low, high = known[int(at)], known[min(int(at) + 1, len(known) - 1)]
            want = low if low == high or at == int(at) else low + (high - low) * (at - int(at))
            assert q == want or (q != q and want != want), (c, p, q, want)


def test_grouped_quantiles_with_a_hot_group_and_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("hot", float(i % 700)) for i in range(3000)] + [("few", v) for v in (nan, inf, 1.0, 2.0, None)] + [(None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: r["m"] for r in stats.grouped_quantiles(df, ["g"], "v", {"m": 0.5}, rows_per_chunk=50).collect()}
    assert got == {"hot": float(np.median([i % 700 for i in range(3000)])), "few": 2.0, None: 4.0}


@pytest.mark.parametrize("size", [None, 20])
def test_grouped_quantiles(spark, frame, size):
    got = stats.grouped_quantiles(load(spark, frame), ["g"], "v", {"q1": 0.25, "m": 0.5}, rows_per_chunk=size).toPandas()
    want = frame.groupby("g").v.quantile([0.25, 0.5]).unstack().dropna()
    got = got.set_index("g").sort_index()
    np.testing.assert_allclose(got[["q1", "m"]].to_numpy(), want.to_numpy())


@pytest.fixture()
def small_tree(monkeypatch):
    monkeypatch.setattr(o, "MAX_CHUNKS", 8)


def test_tree_of_ranges(spark, frame, small_tree):
    """Three levels of ranges, of a few rows each, give what one range gives."""
    df = load(spark, frame)
    srt = frame.sort_values("t")
    chunked, bound = o.with_chunks(df, ["g"], ["t"], 4)
    numbers = [r[0] for r in chunked.orderBy("g", "t").select(o.CHUNK).collect()]
    assert numbers == sorted(numbers) and numbers[-1] < bound and len(set(numbers)) > 40
    test_fills(spark, frame, 4, ["g"])
    test_position_sum_average(spark, frame, 4)
    got = stats.grouped_quantiles(df, ["g"], "w", {"q": 0.3}, 3).toPandas().set_index("g").q
    np.testing.assert_allclose(got.sort_index(), frame.groupby("g").w.quantile(0.3).sort_index())


def test_fifty_thousand_ranges(spark):
    df = spark.range(0, 60_000, 1, 8).select(((F.col("id") * 7919) % 60_000).alias("t"), F.lit(1.0).alias("w"))
    assert -(-60_000 // 1) > 50_000 > o.MAX_CHUNKS
    out = o.running_sum(o.with_position(df, ["t"], "p", 1), "w", ["t"], "s", 1)
    assert out.where("p <> t + 1 OR s <> p").isEmpty() and out.count() == 60_000


def test_tree_with_ties_and_empty(spark, small_tree):
    same = spark.range(200).select(F.lit(1).alias("t"), F.col("id").alias("u"), F.lit(2.0).alias("w"))
    out = o.running_sum(same, "w", ["t", "u"], "s", 2)
    assert out.where("s <> 2 * (u + 1)").isEmpty() and out.count() == 200
    assert o.with_position(same.limit(0), ["u"], "p", 2).count() == 0
