"""Support vector machines, extra trees, second-order boosting and AdaBoost for numbers against plain versions."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.models import margin, special, supervised, trees


@pytest.fixture(scope="module")
def pdf():
    r = np.random.default_rng(4)
    n = 500
    a, b, c = r.normal(size=n), r.uniform(-2, 2, n), r.integers(0, 5, n).astype(float)
    y = 3 * a - 2 * b + np.where(c > 2, 4.0, 0.0) + r.normal(scale=0.3, size=n)
    kind = np.where(a + b > 1, "p", np.where(c > 2, "q", "r"))
    c[::17] = np.nan
    return pd.DataFrame({"id": range(n), "a": a, "b": b, "c": c, "y": y, "kind": kind, "two": np.where(a - b > 0, "u", "v")})


@pytest.fixture(scope="module")
def data(spark, pdf):
    return spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)], "id long, a double, b double, c double, y double, kind string, two string").repartition(3).cache()


def gap(x, y, fit, ridge, epsilon=None):
    """Duality gap of a fitted machine on features scaled as it does; the dual point comes from its rounded corner."""
    mean, spread = x.mean(axis=0), x.std(axis=0, ddof=1)
    z = (x - mean) / spread
    w = np.array(fit.weights[0]) * spread
    score = x @ np.array(fit.weights[0]) + fit.offsets[0]
    if epsilon is None:
        side, over, target = -y, 1 - y * score, np.ones(len(y))
    else:
        side, over = np.sign(score - y), np.abs(score - y) - epsilon
    delta = margin.WIDTHS[-1] * (1.0 if epsilon is None else y.std(ddof=1))
    alpha = np.clip(over / delta, 0, 1) / len(y)
    assert abs((alpha * side).sum()) < 1e-3
    dual_w = -(z * (alpha * side)[:, None]).sum(axis=0) / ridge
    primal = ridge / 2 * w @ w + np.maximum(over, 0).mean()
    gain = (alpha * target).sum() if epsilon is None else -(side * alpha * y).sum() - epsilon * alpha.sum()
    return primal - (gain - ridge / 2 * dual_w @ dual_w), primal


def test_two_classes_reach_the_optimum(data, pdf):
    fit = supervised.train(data, "two", "svm", "classification", ["a", "b"], {"regParam": 0.05}).model
    found, primal = gap(pdf[["a", "b"]].to_numpy(), np.where(pdf.two == "v", 1.0, -1.0), fit, 0.05)
    assert 0 <= found + 1e-9 and found < 1e-3 * (1 + primal) and fit.gap < 1e-3


def test_numbers_reach_the_optimum(data, pdf):
    fit = supervised.train(data, "y", "svr", "regression", ["a", "b"], {"regParam": 0.01, "epsilon": 0.2}).model
    found, primal = gap(pdf[["a", "b"]].to_numpy(), pdf.y.to_numpy(), fit, 0.01, 0.2)
    assert 0 <= found + 1e-6 and found < 2e-3 * (1 + primal)


def test_the_flat_zone_does_not_count(spark):
    """All points within epsilon of a line with no slope: nothing pulls at the weights."""
    df = spark.createDataFrame([(float(i % 7), 1.0 + 0.05 * (-1) ** i) for i in range(60)], "x double, y double")
    fit = supervised.train(df, "y", "svr", "regression", ["x"], {"epsilon": 0.2, "regParam": 0.1}).model
    assert abs(fit.weights[0][0]) < 1e-3 and abs(fit.offsets[0] - 1.0) < 0.16


def test_search_of_a_machine_ends(data):
    start = time.time()
    best, table = supervised.tune(data, "kind", "svm", ["id"], None, 3, task="classification", features=["a", "b", "two"])
    assert time.time() - start < 120 and table.count() == 3 and best.metrics["score"] > 0.6
    right = best.predict(data).where("prediction = kind").count()
    assert right > 300
    best, table = supervised.tune(data, "y", "svr", ["id"], {"C": [1.0, 10.0]}, 2, task="regression", features=["a", "b"])
    assert best.metrics["score"] > 0.6 and table.count() == 2


def test_extra_trees_stump_in_closed_form(spark):
    """One feature of two values: any cut between them is the same stump, whose leaves are the class shares."""
    rows = [(0.0, "n")] * 30 + [(0.0, "m")] * 10 + [(1.0, "m")] * 60
    df = spark.createDataFrame(rows, "x double, kind string")
    fit = supervised.train(df, "kind", "extra_trees", "classification", ["x"], {"numTrees": 5, "maxDepth": 1})
    got = {r["x"]: r for r in fit.predict(df).distinct().collect()}
    assert np.allclose(got[0.0]["probability"], [0.25, 0.75]) and got[0.0]["prediction"] == "n"
    assert np.allclose(got[1.0]["probability"], [1.0, 0.0])
    assert all(0 < t.cut[0] < 1 and len(t.feature) == 3 for t in fit.model.trees) and len({t.cut[0] for t in fit.model.trees}) == 5
    assert [tuple(r) for r in fit.importances().collect()] == [("x", 1.0)]


def plain_extra(x, y, classes, trees_, depth, seed, k):
    out = []
    for t in range(trees_):
        nodes, todo, made = {0: np.arange(len(y))}, [0], 1
        tree = {}
        for _ in range(depth):
            after = []
            for node in todo:
                rows = nodes[node]
                if trees._impurity(trees._counted(y[rows], classes).sum(axis=0), classes) <= 1e-12:
                    continue
                r = np.random.default_rng((seed, t, node))
                wanted, draws = r.permutation(x.shape[1])[:k], r.random(k)
                best, whole = None, trees._impurity(trees._counted(y[rows], classes).sum(axis=0), classes)
                for f, d in zip(wanted, draws):
                    low, high = x[rows, f].min(), x[rows, f].max()
                    if high <= low:
                        continue
                    cut = low + (high - low) * d
                    parts = [rows[x[rows, f] <= cut], rows[x[rows, f] > cut]]
                    if min(map(len, parts)) < 1:
                        continue
                    loss = sum(trees._impurity(trees._counted(y[p], classes).sum(axis=0), classes) for p in parts)
                    if best is None or loss < best[0] - 1e-9 * (1 + abs(whole - best[0])):
                        best = (loss, f, cut, parts)
                if best:
                    tree[node] = (best[1], best[2], made)
                    for p in best[3]:
                        nodes[made] = p
                        after.append(made)
                        made += 1
            todo = after
        out.append(tree)
    return out


@pytest.mark.parametrize("target, classes", [("kind", 3), ("y", 0)])
def test_extra_trees_equal_plain_ones(data, pdf, target, classes):
    params = {"numTrees": 4, "maxDepth": 4, "tries": 2}
    fit = supervised.train(data, target, "extra_trees", "classification" if classes else "regression", ["a", "b"], params).model
    y = pdf[target].map({"p": 0.0, "q": 1.0, "r": 2.0}).to_numpy() if classes else pdf.y.to_numpy()
    want = plain_extra(pdf[["a", "b"]].to_numpy(), y, classes, 4, 4, 43, 2)
    for tree, plain in zip(fit.trees, want):
        assert {n: (f, tree.left[n]) for n, f in enumerate(tree.feature) if f >= 0} == {n: (f, at) for n, (f, _, at) in plain.items()}
        assert all(abs(tree.cut[n] - c) < 1e-9 for n, (_, c, _) in plain.items())


def test_extra_trees_for_texts_are_saved(data, tmp_path):
    fit = supervised.train(data, "kind", "extra_trees", "classification", ["a", "b", "two"], {"numTrees": 10, "maxDepth": 6})
    assert {r["feature"] for r in fit.importances().collect()} == {"a", "b", "two"}
    got = fit.predict(data).select("id", "prediction")
    supervised.save_model(fit, str(tmp_path / "m"))
    assert supervised.score_saved(str(tmp_path / "m"), data).select("id", "prediction").exceptAll(got).isEmpty()
    assert fit.predict(data).where("prediction = kind").count() > 320


def plain_boost(x, y, classes, rounds, depth, step, bins):
    """Histogram boosting of one table in plain numpy, every node built on its own."""
    link = "number" if not classes else "logistic" if classes == 2 else "softmax"
    k = classes if classes > 2 else 1
    edges = [np.unique(np.nanquantile(x[:, f], [i / bins for i in range(1, bins)])) for f in range(x.shape[1])]
    most = max(map(len, edges)) + 1
    binned = np.stack([np.where(np.isnan(x[:, f]), most, np.searchsorted(edges[f], x[:, f])) for f in range(x.shape[1])], axis=1)
    scores = np.zeros((len(y), k))
    if link == "number":
        scores += y.mean()
    elif link == "logistic":
        scores += np.log(y.mean() / (1 - y.mean()))
    for _ in range(rounds):
        g, h = trees.slopes(scores, y, link)
        add = np.zeros_like(scores)
        for i in range(k):
            todo = [(np.arange(len(y)), 0)]
            while todo:
                rows, level = todo.pop()
                best = None
                if level < depth:
                    hist = np.zeros((x.shape[1], most + 1, 2))
                    for f in range(x.shape[1]):
                        np.add.at(hist[f], binned[rows, f], np.stack([g[rows, i], h[rows, i]], axis=1))
                    best = trees.best_split(hist, 1.0, 0.0, 1.0)
                if best is None:
                    add[rows, i] = -step * g[rows, i].sum() / (h[rows, i].sum() + 1.0)
                    continue
                _, f, b, gap_left = best
                left = np.where(binned[rows, f] == most, gap_left, binned[rows, f] <= b)
                todo += [(rows[left], level + 1), (rows[~left], level + 1)]
        scores += add
    return scores


@pytest.mark.parametrize("target, classes", [("y", 0), ("two", 2), ("kind", 3)])
def test_boosting_equals_a_plain_version(data, pdf, target, classes):
    """Numbers, two classes and three in one model, with gaps in a feature, and scores written half way."""
    params = {"maxIter": 10, "maxDepth": 3, "stepSize": 0.3, "maxBins": 16}
    fit = supervised.train(data, target, "xgboost", "classification" if classes else "regression", ["a", "b", "c"], params)
    names = sorted(pdf[target].unique()) if classes else []
    y = pdf[target].map({v: float(i) for i, v in enumerate(names)}).to_numpy() if classes else pdf.y.to_numpy()
    want = plain_boost(pdf[["a", "b", "c"]].to_numpy(), y, classes, 10, 3, 0.3, 16)
    rows = {r["id"]: r["raw"] for r in data.select("id", fit.model.raw().alias("raw")).collect()}
    np.testing.assert_allclose([rows[i] for i in pdf.id], want, atol=1e-6)
    told = fit.predict(data)
    assert told.where("prediction IS NULL").isEmpty()
    if classes:
        assert told.where(F.col("prediction") == F.col(target)).count() > 450


def test_adaboost_for_numbers(data, pdf):
    """The trees' weights follow the rule, and the prediction is the weighted median of theirs."""
    fit = supervised.train(data, "y", "adaboost", "regression", ["a", "b"], {"rounds": 5, "depth": 2})
    model = fit.model
    rows = model.assembler.transform(data)
    votes = np.stack([[r["prediction"] for r in t.transform(rows).orderBy("id").collect()] for t in model.trees], axis=1)
    y, w = pdf.y.to_numpy(), np.ones(len(pdf))
    for i, weight in enumerate(model.weights):
        off = np.abs(votes[:, i] - y)
        share = off / off.max()
        error = (w * share).sum() / w.sum()
        assert abs(weight - np.log((1 - error) / error)) < 1e-6
        w = w * (error / (1 - error)) ** (1 - share)
        w /= w.mean()
    weights = np.array(model.weights)
    order = np.argsort(votes, axis=1, kind="stable")
    reached = np.cumsum(weights[order], axis=1) >= weights.sum() / 2
    want = votes[np.arange(len(y)), order[np.arange(len(y)), reached.argmax(axis=1)]]
    got = [r["prediction"] for r in fit.predict(data).orderBy("id").collect()]
    np.testing.assert_allclose(got, want)


def test_rows_without_signal(spark):
    """Constant features, one class, an empty table for scoring."""
    df = spark.createDataFrame([(1.0, "m", 2.0)] * 20, "x double, kind string, y double")
    for name in ("extra_trees", "xgboost"):
        fit = supervised.train(df, "y", name, "regression", ["x"])
        assert {r["prediction"] for r in fit.predict(df).collect()} == {2.0} and fit.predict(df.limit(0)).count() == 0
    assert isinstance(special.fit("adaboost", df.withColumn("__label", F.col("y")), ["x"], None, {}), special.Median)
