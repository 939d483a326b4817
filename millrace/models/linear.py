"""Closed-form linear models: one aggregate gives sums of products, the driver solves a p x p system."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.operators.missing import with_nulls
from millrace.operators.stats import aggregate_in_jobs, moments
from millrace.session import cut_lineage


@dataclass(frozen=True)
class LinearFit:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    alpha: float
    lambda_: float

    def predict(self) -> Column:
        out = F.lit(self.intercept)
        for f, w in zip(self.features, self.weights):
            out = out + col(f).cast("double") * F.lit(w)
        return out


def centred_products(df: DataFrame, features: Sequence[str], target: str, where: Column | None = None):
    """Count, means, centred X'X and X'y, and y'y over complete rows, from two aggregates.

    Centring first keeps the sums small, so no digits are lost to large means.
    """
    names = [*features, target]
    data = (df.where(where) if where is not None else df).select(*[col(n).cast("double").alias(n) for n in names]).dropna()
    m = moments(data, names, ["mean"])
    n = m[""]["rows"]
    means = np.array([m[c]["mean"] or 0.0 for c in names])
    c = {name: col(name) - F.lit(float(mean)) for name, mean in zip(names, means)}
    exprs = []
    for i, a in enumerate(names):
        for j in range(i, len(names)):
            exprs.append(F.sum(c[a] * c[names[j]]).alias(f"s{i}_{j}"))
    got = aggregate_in_jobs(data, exprs)
    p = len(names)
    s = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            s[i, j] = s[j, i] = got[f"s{i}_{j}"] or 0.0
    return n, means, s[:-1, :-1], s[:-1, -1], s[-1, -1]


def solve_bayesian(n, means, xx, xy, yy, features, max_iter=300, tol=1e-3) -> LinearFit:
    """Evidence maximisation for ridge regression (MacKay 1992) with weak gamma priors."""
    # Shape and rate of both priors.
    a1 = a2 = l1 = l2 = 1e-6
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0.0)
    rotated = vectors.T @ xy
    alpha = 1.0 / (yy / max(n, 1) + np.finfo(float).eps)
    lam = 1.0
    w = np.zeros(len(xy))
    for i in range(max_iter):
        new = vectors @ (rotated / (values + lam / alpha))
        rss = max(yy - 2 * new @ xy + new @ xx @ new, 0.0)
        gamma = float(np.sum(alpha * values / (lam + alpha * values)))
        lam = (gamma + 2 * l1) / (float(new @ new) + 2 * l2)
        alpha = (n - gamma + 2 * a1) / (rss + 2 * a2)
        if i and np.abs(new - w).sum() < tol:
            w = new
            break
        w = new
    w = vectors @ (rotated / (values + lam / alpha))
    intercept = float(means[-1] - w @ means[:-1])
    return LinearFit(tuple(features), tuple(float(v) for v in w), intercept, float(alpha), float(lam))


def bayesian_ridge(df: DataFrame, features: Sequence[str], target: str, where: Column | None = None) -> LinearFit:
    return solve_bayesian(*centred_products(df, features, target, where), features)


def ordinary(df: DataFrame, features: Sequence[str], target: str, ridge: float = 0.0) -> LinearFit:
    """Least squares (or ridge with penalty ``ridge``) with intercept."""
    n, means, xx, xy, yy = centred_products(df, features, target)
    w = np.linalg.lstsq(xx + ridge * np.eye(len(xy)), xy, rcond=None)[0]
    return LinearFit(tuple(features), tuple(float(v) for v in w), float(means[-1] - w @ means[:-1]), 0.0, ridge)


def iterative_impute(df: DataFrame, columns: Sequence[str], max_iter: int = 10, tol: float = 1e-3) -> DataFrame:
    """Chained regressions: fill with means, then predict each column with gaps from the others, in rounds.

    Columns go from fewest to most gaps. A round ends early once no filled value moves by more than
    ``tol`` of the largest value. The round's table is checkpointed, so the plan does not grow.
    """
    columns = list(columns)
    gaps, nulls, _ = with_nulls(df.select(*[col(c) for c in columns]))
    order = sorted(gaps, key=lambda c: nulls[c])
    m = moments(df, columns, ["mean", "max_abs"])
    reach = tol * max((float(m[c]["max_abs"] or 0.0) for c in columns), default=0.0)
    flags = {f"__gap_{c}": col(c).isNull() for c in order}
    out = df.withColumns(flags).withColumns(
        {c: F.coalesce(col(c).cast("double"), F.lit(m[c]["mean"])) for c in columns}
    )
    for _ in range(max_iter if len(columns) > 1 else 0):
        out = cut_lineage(out.withColumns({f"__old_{c}": col(c) for c in order}))
        for c in order:
            fit = bayesian_ridge(out, [f for f in columns if f != c], c, ~col(f"__gap_{c}"))
            out = out.withColumn(c, F.when(col(f"__gap_{c}"), fit.predict()).otherwise(col(c)))
        moved = [F.max(F.abs(col(c) - col(f"__old_{c}"))) for c in order]
        out = cut_lineage(out)
        step = out.agg(F.greatest(*moved, F.lit(0.0)).alias("d")).first()["d"] if moved else 0.0
        out = out.drop(*[f"__old_{c}" for c in order])
        if step is None or step < reach:
            break
    return out.drop(*flags)
