"""Scalers: one aggregate for all columns, then one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col, numeric_columns, small_table, text_columns
from millrace.operators.outliers import range_facts
from millrace.operators.stats import exact_quantiles, moments, value_facts

MAX_QUANTILES = 1000


@dataclass(frozen=True)
class Scaler:
    """Affine map ``(x - shift) / scale`` of a column, or a table of reference quantiles."""

    column: str
    method: str
    shift: float = 0.0
    scale: float = 1.0
    quantiles: tuple[float, ...] = ()

    def apply(self) -> Column:
        x = col(self.column).cast("double")
        if self.quantiles:
            return quantile_map(x, self.quantiles, self.method == "quantile_normal")
        return (x - F.lit(float(self.shift))) / F.lit(float(self.scale))


def _or_one(v) -> float:
    return float(v) if v else 1.0


def fit(df: DataFrame, columns: Sequence[str], method: str) -> dict[str, Scaler]:
    """standard, minmax, robust, maxabs, quantile_uniform or quantile_normal."""
    columns = list(columns)
    if method == "standard":
        m = moments(df, columns, ["mean", "std_pop"])
        return {c: Scaler(c, method, m[c]["mean"] or 0.0, _or_one(m[c]["std_pop"])) for c in columns}
    if method == "minmax":
        m = moments(df, columns, ["min", "max"])
        return {
            c: Scaler(c, method, float(m[c]["min"] or 0), _or_one((m[c]["max"] or 0) - (m[c]["min"] or 0))) for c in columns
        }
    if method == "robust":
        q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        return {c: Scaler(c, method, q[c][1] or 0.0, _or_one((q[c][2] or 0) - (q[c][0] or 0))) for c in columns}
    if method == "maxabs":
        m = moments(df, columns, ["max_abs"])
        return {c: Scaler(c, method, 0.0, _or_one(m[c]["max_abs"])) for c in columns}
    if method in ("quantile_uniform", "quantile_normal"):
        n = df.count()
        size = max(2, min(MAX_QUANTILES, n))
        q = exact_quantiles(df, columns, [i / (size - 1) for i in range(size)])
        return {c: Scaler(c, method, quantiles=tuple(q[c])) for c in columns if q[c][0] is not None}
    raise ValueError(f"unknown scaler {method!r}")


def transform(df: DataFrame, scalers: dict[str, Scaler]) -> DataFrame:
    return df.withColumns({c: s.apply() for c, s in scalers.items()}) if scalers else df


def scale(df: DataFrame, columns: Sequence[str], method: str) -> DataFrame:
    """Apply one scaler to chosen columns in place."""
    if method == "normalize":
        return row_normalise(df, columns)
    return transform(df, fit(df, columns, method))


def row_normalise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide each row by its Euclidean length over ``columns``; an all-zero row stays."""
    squares = [col(c).cast("double") * col(c).cast("double") for c in columns]
    total = squares[0]
    for s in squares[1:]:
        total = total + s
    length = F.sqrt(total)
    return df.withColumns(
        {c: F.when(length == 0, col(c).cast("double")).otherwise(col(c) / length) for c in columns}
    )


def quantile_map(x: Column, quantiles: Sequence[float], normal: bool) -> Column:
    """Share of values below ``x`` by interpolation in the quantile table, or its normal score.

    A flat stretch of the table gives its middle: the mean of the interpolation from both sides.
    """
    q = np.array(quantiles, dtype=float)
    ref = np.linspace(0.0, 1.0, len(q))

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        v = values.to_numpy(dtype=float)
        u = 0.5 * (np.interp(v, q, ref) - np.interp(-v, -q[::-1], -ref[::-1]))
        u = np.where(v <= q[0], 0.0, np.where(v >= q[-1], 1.0, u))
        return pd.Series(normal_quantile(u) if normal else u)

    return run(x)


def normal_quantile(u: np.ndarray) -> np.ndarray:
    """Inverse standard normal, clipped 1e-7 from the ends (Acklam's rational approximation)."""
    # Coefficients of the approximation, highest power first.
    a = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
    b = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
    c = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
    d = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
    p = np.clip(u, 1e-7, 1 - 1e-7)
    q = p - 0.5
    middle = q * np.polyval(a, q * q) / np.polyval(b, q * q)
    t = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    tail = np.polyval(c, t) / np.polyval(d, t)
    return np.where(p < 0.02425, tail, np.where(p > 1 - 0.02425, -tail, middle))


def recommend_scalers(df: DataFrame) -> DataFrame:
    """Per numeric column: quantile if very skewed, robust if it has outliers, none if in [0, 1], else standard."""
    columns = numeric_columns(df)
    m = moments(df, columns, ["count", "skew", "min", "max"])
    far = range_facts(df, columns, m[""]["rows"])
    rows = []
    for c in columns:
        f = m[c]
        if not f["count"]:
            continue
        # Without spread between the quartiles every other value lies outside the fences.
        outliers = far[c]["outliers"] > 0 or (far[c]["iqr"] == 0 and f["min"] != f["max"])
        if f["skew"] is not None and abs(f["skew"]) > 2:
            choice = "QuantileTransformer"
        elif outliers:
            choice = "RobustScaler"
        elif f["min"] >= 0 and f["max"] <= 1:
            choice = "None"
        else:
            choice = "StandardScaler"
        rows.append((c, "numeric", choice))
    return small_table(df.sparkSession, rows, "column string, type string, recommended string")


def recommend_encoders(df: DataFrame) -> DataFrame:
    """Per text or boolean column: one-hot up to 10 values, ordinal up to 50, else target encoding."""
    columns = text_columns(df, booleans=True)
    seen = value_facts(df, columns)
    pick = lambda n: "OneHotEncoder" if n <= 10 else "OrdinalEncoder" if n <= 50 else "TargetEncoder"
    rows = [(c, "categorical", pick(seen[c]["unique"])) for c in columns]
    return small_table(df.sparkSession, rows, "column string, type string, recommended string")


def apply_recommended(df: DataFrame, target: str | None = None) -> DataFrame:
    """Apply both recommendations; without a target, target encoding falls back to labels."""
    from millrace.operators import encoding

    out = df
    choice = {r["column"]: r["recommended"] for r in recommend_scalers(df).collect()}
    names = {"QuantileTransformer": "quantile_uniform", "RobustScaler": "robust", "StandardScaler": "standard"}
    fitted: dict[str, Scaler] = {}
    for label, method in names.items():
        columns = [c for c, r in choice.items() if r == label and c != target]
        if columns:
            fitted.update(fit(df, columns, method))
    coder = {r["column"]: r["recommended"] for r in recommend_encoders(df).collect() if r["column"] != target}
    wide = [c for c, r in coder.items() if r == "TargetEncoder"]
    if target and wide:
        out = encoding.target_encode(out, wide, target)
    out = transform(out, fitted)
    ordinal = [c for c, r in coder.items() if r == "OrdinalEncoder"]
    if ordinal:
        out = encoding.ordinal_encode(out, ordinal)
    if wide and not target:
        out = encoding.label_encode(out, wide)
    hot = [c for c, r in coder.items() if r == "OneHotEncoder"]
    return encoding.one_hot(out, hot) if hot else out


def compare_scalers(df: DataFrame, column: str, methods=("standard", "minmax", "robust", "maxabs")) -> DataFrame:
    """Mean, std, min and max of a column as it is and under several scalers, in one aggregate."""
    versions = {"original": col(column).cast("double")}
    for m in methods:
        versions[m] = fit(df, [column], m)[column].apply()
    rows = [
        F.struct(
            F.lit(m).alias("method"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
        )
        for m, v in versions.items()
    ]
    return df.agg(F.array(*rows).alias("r")).selectExpr("inline(r)")
