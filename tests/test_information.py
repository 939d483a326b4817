"""Mutual information by neighbours against a plain version over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import neighbours, selection


def psi(n):
    """Of whole numbers: the harmonic numbers less Euler's constant."""
    steps = np.concatenate(([0.0], np.cumsum(1 / np.arange(1, np.max(n) + 1))))
    return steps[np.asarray(n, int) - 1] - np.euler_gamma


def plain(x, y, k, numbers):
    if numbers:
        x, y = (x - x.mean()) / (x.std() or 1), (y - y.mean()) / (y.std() or 1)
        same = np.ones((len(x), len(x)), bool)
    else:
        keep = np.array([(y == c).sum() > 1 for c in y])
        x, y = x[keep], y[keep]
        same = y[:, None] == y[None, :]
    dx = abs(x[:, None] - x[None, :])
    dy = abs(y[:, None] - y[None, :]) if numbers else np.zeros_like(dx)
    of = same.sum(1)
    kk = np.minimum(k, of - 1)
    r = np.array([np.sort(np.maximum(dx, dy)[i][same[i]])[kk[i]] for i in range(len(x))])
    near = lambda d, v: (d <= np.maximum(r - (abs(v) + r) * 1e-12, 0)[:, None]).sum(1)
    last = psi(near(dy, y)) if numbers else psi(of)
    return max(0.0, (psi(kk) - psi(near(dx, x)) - last).mean() + psi(len(x)))


def table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=2000)
    x[:600] = 0.25  # a third of the rows are copies
    z = x * 2 + rng.normal(size=2000)
    c = np.where(x + rng.normal(size=2000) > 0.3, 1, np.where(z > 1, 2, 3))
    c[-1], c[-3:-1] = 9, 8  # classes of one row and of two
    return spark.createDataFrame(list(zip(x.tolist(), z.round(1).tolist(), c.tolist())), "x double, z double, c int"), x, z.round(1), c


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FAN", 16)
    df, x, z, c = table(spark)
    got = {r["feature"]: r["score"] for r in selection.neighbour_information(df, ["x"], "c", "classification", 3, 200).collect()}
    assert got["x"] == pytest.approx(plain(x, c, 3, False), abs=1e-9)
    got = selection.neighbour_information(df, ["x"], "z", "regression", 4, 200).first()["score"]
    assert got == pytest.approx(plain(x, z, 4, True), abs=1e-9)
    assert got > 0.3


def test_gaps_and_small_tables(spark):
    rows = [(1.0, "a"), (2.0, "a"), (None, "a"), (float("nan"), "b"), (float("inf"), "b"), (5.0, "b"), (7.0, "b"), (3.0, None)]
    df = spark.createDataFrame(rows, "x double, c string")
    got = selection.neighbour_information(df, ["x"], "c", "classification").first()["score"]
    assert got == pytest.approx(plain(np.array([1.0, 2, 5, 7]), np.array(["a", "a", "b", "b"]), 3, False), abs=1e-9)
    for few in (df.where("false"), df.where("x = 1"), df.where("x in (1, 5)")):
        assert selection.neighbour_information(few, ["x"], "c", "classification").first()["score"] is None
    assert selection.neighbour_information(df.where("x = 1").withColumn("y", F.lit(2.0)), ["x"], "y", "regression").first()["score"] is None


def test_digamma(spark):
    got = spark.range(1, 300).select(selection._digamma(F.col("id").cast("double")).alias("p")).toPandas()["p"].to_numpy()
    np.testing.assert_allclose(got, psi(np.arange(1, 300)), atol=1e-11)
