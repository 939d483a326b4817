"""Nearest rows against brute force, with gaps, copies and small cells."""

import numpy as np
import pandas as pd
import pytest

from millrace.operators import neighbours


def brute_impute(x, k):
    out = x.copy()
    p = x.shape[1]
    for i in range(len(x)):
        for c in np.flatnonzero(np.isnan(x[i])):
            have = ~np.isnan(x[:, c])
            gap = x[have] - x[i]
            known = ~np.isnan(gap)
            shared = known.sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.where(shared > 0, np.sqrt(np.where(known, gap, 0) ** 2 @ np.ones(p) * (p / shared)), np.inf)
            v = x[have][:, c]
            order = sorted(range(len(v)), key=lambda j: (d[j], v[j]))
            order = [j for j in order if np.isfinite(d[j])][:k]
            out[i, c] = v[order].mean() if order else np.nanmean(x[:, c])
    return out


@pytest.mark.parametrize("cell_rows,block,chunk", [(None, 20000, 50000), (20, 20000, 50000), (20, 7, 5)])
def test_impute(spark, monkeypatch, cell_rows, block, chunk):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 3)).round(2)
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:80] = [0.5, np.nan, 1.0]  # a third of the rows are copies
    x[80:90] = [0.5, 2.0, 1.0]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got = neighbours.knn_impute(df, ["a", "b", "c"], 4, cell_rows).toPandas().sort_values("id")[["a", "b", "c"]].to_numpy()
    np.testing.assert_allclose(got, brute_impute(x, 4), atol=1e-9)


def test_predict(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 2)).round(3)
    y = np.where(x[:, 0] > 0, "up", "down")
    z = x.sum(1).round(3)
    df = spark.createDataFrame([(i, float(a), float(b), str(c), float(d)) for i, ((a, b), c, d) in enumerate(zip(x, y, z))],
                               "id int, a double, b double, y string, z double")
    train, rows = df.where("id < 200"), df.where("id >= 200")
    got = neighbours.knn_predict(train, rows, ["a", "b"], "y", 5, cell_rows=25).toPandas().set_index("id")
    num = neighbours.knn_predict(train, rows, ["a", "b"], "z", 5, "regression", cell_rows=25).toPandas().set_index("id")
    for i in range(200, 300):
        order = np.argsort(((x[:200] - x[i]) ** 2).sum(1), kind="stable")[:5]
        assert got.prediction[i] == pd.Series(y[order]).mode()[0]
        assert abs(num.prediction[i] - z[order].mean()) < 1e-9


@pytest.mark.parametrize("width,gaps,fan", [(7, 0.4, 4), (2, 0.02, 3), (3, 0.0, 1024)])
def test_levels_and_many_gap_patterns(spark, monkeypatch, width, gaps, fan):
    """A narrow tree has several levels; seven columns with gaps have over 65 patterns."""
    monkeypatch.setattr(neighbours, "FAN", fan)
    monkeypatch.setattr(neighbours, "CHUNK", 30)
    rng = np.random.default_rng(width)
    x = rng.normal(size=(400, width)).round(2)
    x[rng.random(x.shape) < gaps] = np.nan
    x[0, 0] = np.nan
    x[100:180] = x[99]  # copies
    names = [f"c{i}" for i in range(width)]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names))
    if gaps > 0.1:
        assert len({tuple(p) for p in np.isnan(x)}) > 65
    got = neighbours.knn_impute(df, names, 4, 40).toPandas().sort_values("id")[names].to_numpy()
    np.testing.assert_allclose(got, brute_impute(x, 4), atol=1e-9)


def test_cells_keep_their_size(spark, monkeypatch):
    """Cells hold at most about CELL_ROWS different donors on every level, but for copies of one x, which no cut tells apart."""
    monkeypatch.setattr(neighbours, "FAN", 5)
    from pyspark.sql import functions as F

    a = spark.range(3000).select(F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("x"), F.array(F.col("id").cast("double")).alias("values"))
    b = spark.range(500).select(F.array(F.lit(9.0), F.lit(9.0)).alias("x"), F.array(F.col("id").cast("double")).alias("values"))
    placed, levels = neighbours._partition(a.unionByName(b).withColumn("w", F.lit(1).cast("bigint")), 3500, 2, 1, 20)
    assert len(levels) >= 3
    assert placed.count() == 3500
    sizes = placed.groupBy("box", (F.col("x")[0] == 9.0).alias("copies")).count().collect()
    assert max(r["count"] for r in sizes if not r["copies"]) <= 40
    assert sum(r["count"] for r in sizes if r["copies"]) == 500


def test_boxes_bound_every_row():
    """No row of a box is nearer than its bound, whatever the gaps."""
    rng = np.random.default_rng(4)
    for turn in range(200):
        x = rng.normal(size=(6, 4)) + 1
        x[rng.random(x.shape) < 0.4] = np.nan
        q = rng.normal(size=(3, 4))
        q[rng.random(q.shape) < 0.3] = np.nan
        known = ~np.isnan(x)
        box = pd.DataFrame({"box": [1], "low": [np.fmin.reduce(x)], "high": [np.fmax.reduce(x)], "known": [known.sum(0)], "counts": [[6]], "kinds": [6]})
        bound, compares = neighbours._Boxes(box, 4).lower(q)
        for i, row in enumerate(q):
            gap = (x - row) ** 2
            shared = (~np.isnan(gap)).sum(1)
            d2 = np.array([np.nansum(g) * 4 / s if s else np.inf for g, s in zip(gap, shared)])
            assert bound[i, 0] <= d2.min() * (1 + 1e-12) or np.isinf(d2.min())
            assert not compares[i, 0] or (shared > 0).all()


def test_predict_without_training_rows(spark):
    rows = spark.createDataFrame([(1.0, "a")], "a double, y string")
    got = neighbours.knn_predict(rows.where("false"), rows, ["a"], "y", 3, "regression").collect()
    assert len(got) == 1 and got[0]["prediction"] is None
