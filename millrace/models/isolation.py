"""Isolation forest (Liu, Ting and Zhou 2008) on DataFrames.

Trees need small samples by definition (256 rows each), so growing is a fixed-size job, one tree
per group; scoring is a pandas UDF over all rows with the trees in the closure (at most 511 nodes each).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import clip, col, numeric_columns
from millrace.operators.stats import exact_quantiles
from millrace.session import cut_lineage

TREES = 100
SAMPLE = 256
NODES = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"


def path_length(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow_tree(x: np.ndarray, seed: int) -> tuple[list, list, list, list, list]:
    rng = np.random.default_rng(seed)
    top = math.ceil(math.log2(max(len(x), 2)))
    feature, cut, left, right, depth = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        at = len(feature)
        for a, v in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (depth, level + path_length(len(rows)))):
            a.append(v)
        varying = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
        if level >= top or not len(varying):
            return at
        f = int(rng.choice(varying))
        c = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        below = rows[:, f] < c
        if not below.any():
            below = rows[:, f] <= rows[:, f].min()
        feature[at], cut[at] = f, c
        left[at] = node(rows[below], level + 1)
        right[at] = node(rows[~below], level + 1)
        return at

    node(x, 0)
    return feature, cut, left, right, depth


@dataclass(frozen=True)
class Forest:
    features: tuple[str, ...]
    trees: tuple
    sample: int

    def score(self) -> Column:
        """Anomaly score in (0, 1), near 1 for isolated rows; null if a feature is missing."""
        trees = [tuple(np.array(a) for a in t) for t in self.trees]
        norm = path_length(self.sample) or 1.0

        @F.pandas_udf("double")
        def run(*parts: pd.Series) -> pd.Series:
            x = np.column_stack([p.to_numpy(dtype=float) for p in parts])
            total = np.zeros(len(x))
            for feature, cut, left, right, depth in trees:
                at = np.zeros(len(x), dtype=np.int64)
                while True:
                    inner = np.flatnonzero(feature[at] >= 0)
                    if not len(inner):
                        break
                    here = at[inner]
                    low = x[inner, feature[here]] < cut[here]
                    at[inner] = np.where(low, left[here], right[here])
                total += depth[at]
            out = 2.0 ** (-total / len(trees) / norm)
            return pd.Series(np.where(np.isnan(x).any(1), np.nan, out))

        return run(*[col(f).cast("double") for f in self.features])


def fit_forest(df: DataFrame, features: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> Forest:
    features = list(features)
    data = df.select(*[col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).dropna()
    rows = data.count()
    if not rows:
        raise ValueError("no complete rows to grow a forest on")
    # about four times what the trees take in all; then every tree draws from these rows
    pool = cut_lineage(data.sample(fraction=min(1.0, 4.0 * trees * sample / rows), seed=seed))
    pool = pool.withColumn("__id", F.monotonically_increasing_id())
    size = min(sample, rows)
    share = min(1.0, (sample + 6 * math.sqrt(sample) + 10) / max(pool.count(), 1))
    dealt = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    draw = F.pmod(F.xxhash64("__id", "tree", F.lit(seed)), F.lit(1 << 30))
    dealt = dealt.withColumn("__draw", draw).where(F.col("__draw") <= F.lit(int(share * (1 << 30))))
    names = [f"x{i}" for i in range(len(features))]

    def grow(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.nsmallest(size, "__draw")[names].to_numpy(dtype=float)
        feature, cut, left, right, depth = _grow_tree(x, seed * 100_003 + int(key[0]))
        return pd.DataFrame({"tree": [int(key[0])], "feature": [feature], "cut": [cut], "left": [left], "right": [right], "depth": [depth]})

    grown = dealt.groupBy("tree").applyInPandas(grow, NODES).orderBy("tree").collect()
    packed = tuple((r["feature"], r["cut"], r["left"], r["right"], r["depth"]) for r in grown)
    return Forest(tuple(features), packed, size)


def score_rows(df: DataFrame, features: Sequence[str], contamination: float = 0.1, seed: int = 42) -> tuple[DataFrame, float]:
    """Rows with ``anomaly_score``, and the score above which the given share of them lies."""
    forest = fit_forest(df, features, seed=seed)
    scores = cut_lineage(df.select(forest.score().alias("anomaly_score")))
    limit = exact_quantiles(scores, ["anomaly_score"], [1 - contamination])["anomaly_score"][0]
    return df.withColumn("anomaly_score", forest.score()), limit


def detect(df: DataFrame, features: Sequence[str], contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """``anomaly_score`` and ``is_anomaly``; rows with a missing feature are never anomalies."""
    scored, limit = score_rows(df, features, contamination, seed)
    return scored.withColumn("is_anomaly", F.coalesce(F.col("anomaly_score") > F.lit(limit), F.lit(False)))


def clip_isolated(df: DataFrame, columns: Sequence[str] | None = None, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Per numeric column: values its own forest isolates are clipped to the 5 % and 95 % quantiles."""
    columns = list(columns if columns is not None else numeric_columns(df))
    if not columns:
        return df
    forests = {f"__score_{c}": fit_forest(df, [c], seed=seed) for c in columns if df.where(col(c).isNotNull()).limit(1).count()}
    scores = cut_lineage(df.select(*[f.score().alias(n) for n, f in forests.items()])) if forests else df
    limits = exact_quantiles(scores, list(forests), [1 - contamination])
    caps = exact_quantiles(df, columns, [0.05, 0.95])
    scored = df.withColumns({n: f.score() for n, f in forests.items()})
    fixed = {}
    for c in columns:
        name = f"__score_{c}"
        if name in forests:
            low, high = caps[c]
            bounded = clip(col(c).cast("double"), low, high)
            fixed[c] = F.when(col(name) > F.lit(limits[name][0]), bounded).otherwise(col(c).cast("double"))
    return scored.withColumns(fixed).drop(*forests)
