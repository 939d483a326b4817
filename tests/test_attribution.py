"""Exact tree attribution against all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from millrace.models import attribution, supervised
from millrace.models.trees import Tree

NAMES = ["a", "b", "c", "d", "e", "f"]


def table(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(240, 6)).round(2)
    kind = rng.choice(["red", "green", "blue"], 240)
    y = np.where(x[:, 0] > 0, x[:, 1] * x[:, 2], x[:, 3]) + (kind == "red") + 0.1 * x[:, 4]
    rows = [(i, *map(float, r), str(k), float(v), "up" if v > 0.3 else "down" if v < -0.3 else "mid") for i, (r, k, v) in enumerate(zip(x, kind, y))]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in NAMES) + ", kind string, y double, g string")


def test_equals_all_subsets():
    rng = np.random.default_rng(3)
    tree, x = Tree(), rng.normal(size=(50, 6))
    for node in range(15):  # features come again on a path
        tree.split(node, int(rng.integers(0, 6)), float(rng.normal() / 2), True, [[float(rng.normal())], [float(rng.normal())]])
    share = np.ones(len(tree.feature))
    for node, f in enumerate(tree.feature):
        if f >= 0:
            share[tree.left[node]] = rng.choice([0.0, 0.3, 0.8])
            share[tree.left[node] + 1] = 1 - share[tree.left[node]]

    def value(row, known, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node][0]
        left = tree.left[node]
        if f in known:
            return value(row, known, left + (not row[f] <= tree.cut[node]))
        return sum(share[left + s] * value(row, known, left + s) for s in (0, 1))

    paths = [attribution._paths(tree, share, list(range(6)), 0)]
    got = attribution._contributions([attribution._packed(tree)], paths, 6, x)
    assert attribution._expected(paths) == pytest.approx(value(x[0], ()))
    for row, mine in zip(x, got):
        for i in range(6):
            others = [j for j in range(6) if j != i]
            want = sum(
                factorial(n) * factorial(5 - n) / factorial(6) * (value(row, {*s, i}) - value(row, set(s)))
                for n in range(6) for s in combinations(others, n)
            )
            assert mine[i] == pytest.approx(want, abs=1e-10)


@pytest.mark.parametrize("name,params", [("decision_tree", {}), ("random_forest", {"numTrees": 5}), ("gradient_boosting", {"maxIter": 5}), ("extra_trees", {"numTrees": 4}), ("newton_boosting", {"maxIter": 5})])
def test_numbers_add_up(spark, name, params):
    df = table(spark)
    trained = supervised.train(df, "y", name, "regression", [*NAMES, "kind"], params)
    got = attribution.tree_shapley(trained, df, ["id"]).toPandas()
    assert len(got) == 240 * 7 and set(got["feature"]) == {*NAMES, "kind"}
    sums = got.groupby("id")["contribution"].sum() + got["expected"].iloc[0]
    want = trained.predict(df).toPandas().set_index("id")["prediction"]
    np.testing.assert_allclose(sums.sort_index(), want.sort_index(), atol=1e-8)
    assert abs(got[got["feature"] == "kind"]["contribution"]).mean() > 0.05


@pytest.mark.parametrize("name", ["random_forest", "extra_trees"])
def test_classes_add_up(spark, name):
    df = table(spark)
    trained = supervised.train(df, "g", name, "classification", NAMES, {"numTrees": 4})
    got = attribution.tree_shapley(trained, df, ["id"], class_index=2).toPandas()
    sums = got.groupby("id")["contribution"].sum() + got["expected"].iloc[0]
    want = trained.predict(df).toPandas().set_index("id")["probability"].map(lambda p: p[2])
    np.testing.assert_allclose(sums.sort_index(), want.sort_index(), atol=1e-8)


def test_gaps_and_other_models(spark):
    df = table(spark)
    trained = supervised.train(df, "y", "decision_tree", "regression", ["a", "b"])
    rows = spark.createDataFrame([(1, None, 2.0), (2, 0.5, 0.1)], "id int, a double, b double")
    got = {(r["id"], r["feature"]): r["contribution"] for r in attribution.tree_shapley(trained, rows, ["id"], df).collect()}
    assert got[1, "a"] is None and got[1, "b"] is None and got[2, "a"] is not None
    assert attribution.tree_shapley(trained, rows.where("false"), ["id"], df).collect() == []
    with pytest.raises(ValueError):
        attribution.tree_shapley(supervised.train(df, "y", "linear_regression", "regression", ["a", "b"]), df, ["id"])
