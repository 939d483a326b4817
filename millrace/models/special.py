"""Classifiers and regressors without a built-in estimator: LDA, QDA, AdaBoost, KNN, Bayesian ridge, and those of ``margin`` and ``trees``."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.models.linear import LinearFit, bayesian_ridge
from millrace.models.margin import fit_many
from millrace.models.trees import fit_extra_trees, fit_newton_boosting
from millrace.operators.stats import moments
from millrace.session import cut_lineage


@dataclass
class Discriminant:
    """Gaussian classes: a score per class as an expression, the largest wins."""

    features: tuple[str, ...]
    means: np.ndarray
    inverses: np.ndarray
    constants: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        scores = []
        for mean, inverse, constant in zip(self.means, self.inverses, self.constants):
            gaps = [col(f).cast("double") - F.lit(float(m)) for f, m in zip(self.features, mean)]
            form = F.lit(0.0)
            for i, a in enumerate(gaps):
                for j, b in enumerate(gaps):
                    form = form + a * b * F.lit(float(inverse[i, j]))
            scores.append(F.lit(float(constant)) - form / 2)
        out = df.withColumn("__scores", F.array(*scores))
        top = F.array_max("__scores")
        # log-sum-exp keeps the shares finite
        total = F.aggregate("__scores", F.lit(0.0), lambda a, s: a + F.exp(s - top))
        return out.withColumns(
            {
                "probability": F.transform("__scores", lambda s: F.exp(s - top) / total),
                "prediction": (F.array_position("__scores", top) - 1).cast("double"),
            }
        ).drop("__scores")


def fit_discriminant(data: DataFrame, features: Sequence[str], classes: int, quadratic: bool) -> Discriminant:
    """Class means and (pooled or own) covariances from one grouped aggregate of centred products."""
    features = list(features)
    m = moments(data, features, ["mean"])
    c = [col(f).cast("double") - F.lit(m[f]["mean"]) for f in features]
    p = len(features)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(x).alias(f"s{i}") for i, x in enumerate(c)]
    aggs += [F.sum(c[i] * c[j]).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)]
    rows = {int(r["__label"]): r for r in data.dropna(subset=features).groupBy("__label").agg(*aggs).collect()}
    centre = np.array([m[f]["mean"] for f in features])
    n = np.array([rows[k]["n"] for k in range(classes)], dtype=float)
    means, scatter = [], []
    for k in range(classes):
        s = np.array([rows[k][f"s{i}"] for i in range(p)])
        q = np.array([[rows[k][f"q{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        means.append(centre + s / n[k])
        scatter.append(q - np.outer(s, s) / n[k])
    prior = np.log(n / n.sum())
    if quadratic:
        covs = [s / max(n[k] - 1, 1) for k, s in enumerate(scatter)]
    else:
        covs = [sum(scatter) / n.sum()] * classes
    inverses = np.array([np.linalg.pinv(v) for v in covs])
    logdet = np.array([np.sum(np.log(np.maximum(np.linalg.eigvalsh(v), 1e-300))) for v in covs])
    return Discriminant(tuple(features), np.array(means), inverses, prior - logdet / 2)


@dataclass
class Boosted:
    """Weighted vote of shallow trees (SAMME, Zhu et al. 2009)."""

    assembler: PipelineModel
    trees: list
    weights: list[float]
    classes: int

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.assembler.transform(df)
        votes = []
        for i, (tree, weight) in enumerate(zip(self.trees, self.weights)):
            name = f"__vote{i}"
            tree = tree.copy().setPredictionCol(name).setProbabilityCol("").setRawPredictionCol("")
            out = tree.transform(out)
            votes.append((name, weight))
        scores = []
        for k in range(self.classes):
            total = F.lit(0.0)
            for name, weight in votes:
                total = total + F.when(F.col(name) == k, F.lit(weight)).otherwise(0.0)
            scores.append(total)
        out = out.withColumn("__scores", F.array(*scores))
        total = sum(w for _, w in votes) or 1.0
        return out.withColumns(
            {
                "probability": F.transform("__scores", lambda s: s / F.lit(total)),
                "prediction": (F.array_position("__scores", F.array_max("__scores")) - 1).cast("double"),
            }
        ).drop("__scores", "__features", *[n for n, _ in votes])


def fit_adaboost(data: DataFrame, features: Sequence[str], classes: int, rounds: int = 20, depth: int = 1, rate: float = 1.0) -> Boosted:
    assembler = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="keep")]).fit(data)
    rows = cut_lineage(assembler.transform(data).select("__features", "__label", F.lit(1.0).alias("__w")))
    trees, weights = [], []
    for i in range(rounds):
        tree = DecisionTreeClassifier(featuresCol="__features", labelCol="__label", weightCol="__w", maxDepth=depth, seed=42 + i).fit(rows)
        scored = tree.transform(rows).select("__features", "__label", "__w", (F.col("prediction") != F.col("__label")).alias("__miss"))
        got = scored.agg(F.sum(F.when(F.col("__miss"), F.col("__w")).otherwise(0.0)).alias("e"), F.sum("__w").alias("t")).first()
        error = got["e"] / got["t"]
        if error >= 1 - 1 / classes:
            break
        weight = rate * (math.log((1 - error) / max(error, 1e-10)) + math.log(classes - 1))
        trees.append(tree)
        weights.append(weight)
        if error <= 1e-10:
            break
        scale = got["t"] - got["e"] + got["e"] * math.exp(weight)
        # weights keep the mean 1, so the numbers stay in range
        factor = F.when(F.col("__miss"), F.lit(math.exp(weight))).otherwise(F.lit(1.0)) * F.lit(got["t"] / scale)
        rows = scored.withColumn("__w", F.col("__w") * factor).drop("__miss")
        if i % 5 == 4:
            rows = cut_lineage(rows)
    return Boosted(assembler, trees, weights, classes)


@dataclass
class Median:
    """Weighted median of shallow trees' predictions (AdaBoost.R2, Drucker 1997)."""

    assembler: PipelineModel
    trees: list
    weights: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.assembler.transform(df)
        votes = []
        for i, (tree, weight) in enumerate(zip(self.trees, self.weights)):
            out = tree.copy().setPredictionCol(f"__vote{i}").transform(out)
            votes.append(F.struct(F.col(f"__vote{i}").alias("p"), F.lit(float(weight)).alias("w")))
        half = sum(self.weights) / 2
        # The first of the sorted predictions at which half of the weight is reached.
        start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("p"))

        def step(seen, vote):
            total = seen["w"] + vote["w"]
            return F.struct(total.alias("w"), F.when(seen["p"].isNull() & (total >= F.lit(half * (1 - 1e-12))), vote["p"]).otherwise(seen["p"]).alias("p"))

        out = out.withColumn("__votes", F.sort_array(F.array(*votes)))
        out = out.withColumn("prediction", F.aggregate("__votes", start, step)["p"])
        return out.drop("__votes", "__features", *[f"__vote{i}" for i in range(len(self.trees))])


def fit_adaboost_numbers(data: DataFrame, features: Sequence[str], rounds: int = 20, depth: int = 3, rate: float = 1.0, loss: str = "linear", **_) -> Median:
    """Trees on rows whose weights grow with their share of the largest error; ``loss`` is linear, square or exponential."""
    assembler = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="keep")]).fit(data)
    rows = cut_lineage(assembler.transform(data).select("__features", "__label", F.lit(1.0).alias("__w")))
    trees, weights = [], []
    for i in range(rounds):
        tree = DecisionTreeRegressor(featuresCol="__features", labelCol="__label", weightCol="__w", maxDepth=depth, seed=42 + i).fit(rows)
        scored = tree.transform(rows).select("__features", "__label", "__w", F.abs(F.col("prediction") - F.col("__label")).alias("__off"))
        most = scored.agg(F.max("__off")).first()[0]
        if not most:
            return Median(assembler, [*trees, tree], [*weights, 1.0] if not trees else [*weights, max(weights) * 30])
        share = F.col("__off") / F.lit(float(most))
        lost = {"linear": share, "square": share * share, "exponential": 1 - F.exp(-share)}[loss]
        got = scored.agg(F.sum(F.col("__w") * lost).alias("e"), F.sum("__w").alias("t")).first()
        error = got["e"] / got["t"]
        if error >= 0.5:
            if not trees:
                trees, weights = [tree], [1.0]
            break
        beta = error / (1 - error)
        trees.append(tree)
        weights.append(rate * math.log(1 / beta))
        rows = scored.withColumn("__w", F.col("__w") * F.pow(F.lit(beta), (1 - lost) * F.lit(rate)))
        total = rows.agg(F.sum("__w"), F.count(F.lit(1))).first()
        # weights keep the mean 1, so the numbers stay in range
        rows = rows.withColumn("__w", F.col("__w") * F.lit(total[1] / total[0])).drop("__off")
        if i % 5 == 4:
            rows = cut_lineage(rows)
    return Median(assembler, trees, weights)


@dataclass
class Nearest:
    train: DataFrame
    features: tuple[str, ...]
    k: int
    labels: list[str] | None

    def transform(self, df: DataFrame) -> DataFrame:
        from millrace.operators.neighbours import knn_predict

        task = "classification" if self.labels else "regression"
        target = "__class" if self.labels else "__label"
        out = knn_predict(self.train, df, self.features, target, self.k, task)
        if not self.labels:
            return out
        names = F.array(*[F.lit(v) for v in self.labels])
        return out.withColumn("prediction", (F.array_position(names, F.col("prediction")) - 1).cast("double"))


@dataclass
class LinearModel:
    fit: LinearFit

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.fit.predict())


def fit(algorithm: str, data: DataFrame, features: Sequence[str], labels: list[str] | None, params: dict):
    if algorithm in ("lda", "qda"):
        return fit_discriminant(data, features, len(labels), algorithm == "qda")
    if algorithm == "adaboost":
        return fit_adaboost(data, features, len(labels), **params) if labels else fit_adaboost_numbers(data, features, **params)
    if algorithm in ("svm", "svr"):
        if (algorithm == "svm") != bool(labels):
            raise ValueError(f"{algorithm} does not do {'classification' if labels else 'regression'}")
        return fit_many(data, features, len(labels or []), [params])[0]
    if algorithm == "extra_trees":
        return fit_extra_trees(data, features, len(labels or []), **params)
    if algorithm == "newton_boosting":
        return fit_newton_boosting(data, features, len(labels or []), **params)
    if algorithm == "bayesian_ridge":
        return LinearModel(bayesian_ridge(data, features, "__label"))
    if algorithm == "knn":
        train = data.select(*[col(f) for f in features], "__label")
        if labels:
            names = F.array(*[F.lit(v) for v in labels])
            train = train.withColumn("__class", F.get(names, F.col("__label").cast("int")))
        return Nearest(train, tuple(features), params.get("k", 5), labels)
    raise ValueError(f"unknown algorithm {algorithm!r}")
