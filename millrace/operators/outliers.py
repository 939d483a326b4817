"""Outliers: a fitted detector (bounds or a test) times an action."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import clip, col, numeric_columns, small_table
from millrace.operators.aggregate import median_absolute_deviation
from millrace.operators.stats import aggregate_in_jobs, exact_quantiles, moments


@dataclass(frozen=True)
class Detector:
    """What ``fit`` learned about one column; ``low``/``high`` also serve as caps."""

    column: str
    method: str
    low: float | None = None
    high: float | None = None
    centre: float | None = None
    scale: float | None = None
    limit: float | None = None

    def flag(self) -> Column:
        """True for outliers, false otherwise; a null value is never an outlier."""
        x = col(self.column)
        if self.scale is not None or self.limit is not None:
            if not self.scale:
                return F.lit(False)
            hit = F.abs((x - F.lit(self.centre)) / F.lit(self.scale)) > F.lit(self.limit)
        elif self.low is None:
            return F.lit(False)
        else:
            hit = (x < F.lit(self.low)) | (x > F.lit(self.high))
        return F.coalesce(hit, F.lit(False))


#: Default parameters per method.
DEFAULT = {"iqr": 1.5, "zscore": 3.0, "std": 3.0, "modified_z": 3.5, "percentile": (5.0, 95.0)}


def fit(df: DataFrame, columns: Sequence[str], method: str, param=None, ddof: int = 0) -> dict[str, Detector]:
    """Fit one detector per column, all of them on the input table."""
    columns = list(columns)
    param = DEFAULT.get(method) if param is None else param
    out = {}
    if method == "iqr":
        for c, (q1, q3) in exact_quantiles(df, columns, [0.25, 0.75]).items():
            known = q1 is not None
            out[c] = Detector(c, method, q1 - param * (q3 - q1) if known else None, q3 + param * (q3 - q1) if known else None)
    elif method == "percentile":
        for c, (low, high) in exact_quantiles(df, columns, [param[0] / 100, param[1] / 100]).items():
            out[c] = Detector(c, method, low, high)
    elif method in ("zscore", "std"):
        spread = "std" if ddof == 1 or method == "std" else "std_pop"
        m = moments(df, columns, ["mean", spread])
        for c in columns:
            mean, s = m[c]["mean"], m[c][spread]
            if method == "std":
                known = mean is not None and s is not None
                out[c] = Detector(c, method, mean - param * s if known else None, mean + param * s if known else None)
            else:
                out[c] = Detector(c, method, centre=mean, scale=s or 0.0, limit=param)
    elif method == "modified_z":
        for c, (middle, mad) in median_absolute_deviation(df, columns).items():
            # 0.6745 is the 75 % point of the standard normal, which makes the MAD comparable to a std
            out[c] = Detector(c, method, centre=middle, scale=(mad / 0.6745) if mad else 0.0, limit=param)
    else:
        raise ValueError(f"unknown method {method!r}")
    return out


def with_caps(df: DataFrame, detectors: dict[str, Detector], style: str = "percentile") -> dict[str, Detector]:
    """Give detectors without bounds the caps their action needs: p5/p95, or mean +- 3 std (``sigma``)."""
    from dataclasses import replace

    need = [c for c, d in detectors.items() if d.low is None]
    if not need:
        return detectors
    if style == "sigma":
        m = moments(df, need, ["mean", "std"])
        caps = {c: (m[c]["mean"] - 3 * m[c]["std"], m[c]["mean"] + 3 * m[c]["std"]) for c in need}
    else:
        caps = exact_quantiles(df, need, [0.05, 0.95])
    return {c: replace(d, low=caps[c][0], high=caps[c][1]) if c in need else d for c, d in detectors.items()}


def remove(df: DataFrame, detectors: dict[str, Detector]) -> DataFrame:
    out = df
    for d in detectors.values():
        out = out.where(~d.flag())
    return out


def cap(df: DataFrame, detectors: dict[str, Detector]) -> DataFrame:
    for d in detectors.values():
        if d.low is None and d.method in ("zscore", "modified_z"):
            raise ValueError(f"{d.method} has no bounds; see with_caps")
    return df.withColumns({c: clip(col(c), d.low, d.high) for c, d in detectors.items()})


def mark(df: DataFrame, detectors: dict[str, Detector], suffix: str = "_outlier") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": d.flag() for c, d in detectors.items()})


def log_transform(df: DataFrame, columns: Sequence[str], positive_only: bool = False) -> DataFrame:
    """log(1 + x), shifted to start at 1 if the minimum is not positive (or skipped, if asked)."""
    low = moments(df, columns, ["min"])
    out = {}
    for c in columns:
        least = low[c]["min"]
        if least is None or (least <= 0 and positive_only):
            continue
        out[c] = F.log1p(col(c)) if least > 0 else F.log1p(col(c) - F.lit(least) + 1)
    return df.withColumns(out) if out else df


def treat(df: DataFrame, columns: Sequence[str], method: str, action: str, param=None, caps: str = "percentile"):
    """Detector times action on several columns, with statistics of the input table."""
    if action == "log":
        return log_transform(df, columns)
    detectors = fit(df, columns, method, param)
    if action == "remove":
        return remove(df, detectors)
    if action == "cap":
        return cap(df, with_caps(df, detectors, caps))
    if action == "mark":
        return mark(df, detectors)
    raise ValueError(f"unknown action {action!r}")


def report(df: DataFrame, columns: Sequence[str], method: str, param=None) -> DataFrame:
    """Per column: bounds (where the method has them), flagged rows and their share of the values."""
    detectors = fit(df, columns, method, param)
    exprs = []
    for i, c in enumerate(columns):
        exprs += [F.count_if(detectors[c].flag()).alias(f"f{i}"), F.count(col(c)).alias(f"n{i}")]
    got = aggregate_in_jobs(df, exprs)
    rows = [(c, method, detectors[c].low, detectors[c].high, got[f"f{i}"], got[f"n{i}"]) for i, c in enumerate(columns)]
    out = small_table(
        df.sparkSession, rows, "column string, method string, low double, high double, outliers bigint, `values` bigint"
    )
    return out.withColumn("outlier_pct", F.coalesce(F.try_divide(F.col("outliers") * 100.0, "values"), F.lit(0.0)))


def wide_cap(df: DataFrame, factor: float = 3.0) -> DataFrame:
    """Cap every numeric column that varies between its quartiles at ``factor`` IQRs."""
    detectors = fit(df, numeric_columns(df), "iqr", factor)
    return cap(df, {c: d for c, d in detectors.items() if d.low is not None and d.high > d.low})


def range_facts(df: DataFrame, columns: Sequence[str], rows: int | None = None) -> dict[str, dict]:
    """Outlier counts at 1.5 IQR and far values at 5 IQR; both are zero without spread."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.75])
    exprs, spread = [], {}
    for i, c in enumerate(columns):
        q1, q3 = quartiles[c]
        spread[c] = (q3 - q1) if q1 is not None else 0.0
        for name, m in (("o", 1.5), ("f", 5.0)):
            if spread[c] > 0:
                out = (col(c) < F.lit(q1 - m * spread[c])) | (col(c) > F.lit(q3 + m * spread[c]))
                exprs.append(F.count_if(out).alias(f"{name}{i}"))
    got = aggregate_in_jobs(df, exprs) if exprs else {}
    return {
        c: {"outliers": got.get(f"o{i}", 0), "far": got.get(f"f{i}", 0), "iqr": spread[c]} for i, c in enumerate(columns)
    }
