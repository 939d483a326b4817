"""Missing values: ``fit_*`` runs one aggregate, filling is a projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col, numeric_columns
from millrace.operators.aggregate import null_profile
from millrace.operators.project import complete_rows
from millrace.operators.stats import exact_quantiles, modes, moments

UNKNOWN = "Unknown"


def fill(df: DataFrame, values: dict) -> DataFrame:
    """Put a fitted value where a column is null; works on batches and streams alike."""
    use = {c: F.coalesce(col(c), F.lit(v)) for c, v in values.items() if v is not None}
    return df.withColumns(use) if use else df


def fit_mean(df: DataFrame, columns: Sequence[str] | None = None) -> dict:
    columns = list(columns if columns is not None else numeric_columns(df))
    m = moments(df, columns, ["mean"])
    return {c: m[c]["mean"] for c in columns}


def fit_median(df: DataFrame, columns: Sequence[str] | None = None) -> dict:
    columns = list(columns if columns is not None else numeric_columns(df))
    return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}


def fit_mode(df: DataFrame, columns: Sequence[str] | None = None) -> dict:
    """Most frequent value, or ``Unknown`` for a text column without any value."""
    columns = list(columns if columns is not None else df.columns)
    found = modes(df, columns)
    texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return {c: UNKNOWN if v is None and c in texts else v for c, v in found.items()}


def fill_constant(df: DataFrame, columns: Sequence[str], value) -> DataFrame:
    numbers = set(numeric_columns(df))
    if any(c in numbers for c in columns):
        float(value)  # a numeric column takes numbers only
    values = {c: (float(value) if c in numbers else str(value)) for c in columns}
    return fill(df, values)


def fill_expression(df: DataFrame, column: str, expression: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(col(column), F.expr(expression)))


def with_nulls(df: DataFrame) -> tuple[list[str], dict, int]:
    m = moments(df, df.columns, ["count"])
    rows = m[""]["rows"]
    return [c for c in df.columns if m[c]["count"] < rows], {c: rows - m[c]["count"] for c in df.columns}, rows


def fit_median_or_mode(df: DataFrame) -> dict:
    """Median for numbers, mode or ``Unknown`` for the rest, for the columns that have gaps."""
    gaps, _, rows = with_nulls(df)
    numbers = [c for c in gaps if c in set(numeric_columns(df))]
    values = fit_median(df, numbers) if numbers else {}
    others = [c for c in gaps if c not in values]
    return {**values, **(fit_mode(df, others) if others else {})}


def fit_smart(df: DataFrame, auto_detect: bool = True) -> dict:
    """Mode for text; for numbers the median if |skewness| > 1 (or always, without detection), else the mean."""
    gaps, _, _ = with_nulls(df)
    numbers = [c for c in gaps if c in set(numeric_columns(df))]
    values = {}
    if numbers:
        m = moments(df, numbers, ["mean", "skew"])
        middle = exact_quantiles(df, numbers, [0.5])
        for c in numbers:
            skewed = not auto_detect or (m[c]["skew"] is not None and abs(m[c]["skew"]) > 1)
            values[c] = middle[c][0] if skewed else m[c]["mean"]
    others = [c for c in gaps if c not in values]
    return {**values, **(fit_mode(df, others) if others else {})}


def missing_summary(df: DataFrame) -> DataFrame:
    """Columns with gaps: count and percentage, worst first."""
    return (
        null_profile(df)
        .where(F.col("nulls") > 0)
        .select("column", F.col("nulls").alias("missing"), F.col("null_pct").alias("missing_pct"))
        .orderBy(F.desc("missing"), "column")
    )


def handle_missing(df: DataFrame, strategy: str) -> DataFrame:
    """Whole-table strategies: drop, mean, median or mode."""
    if strategy == "drop":
        return complete_rows(df)
    fit = {"mean": fit_mean, "median": fit_median, "mode": fit_mode}[strategy]
    return fill(df, fit(df))


def model_policy(df: DataFrame, policy: str) -> DataFrame:
    """What modeling does about gaps: ``drop`` rows, ``impute`` mean and mode, or ``keep``."""
    if policy == "drop":
        return complete_rows(df)
    if policy == "keep":
        return df
    numbers = numeric_columns(df)
    others = [c for c in df.columns if c not in numbers]
    return fill(df, {**fit_mean(df, numbers), **fit_mode(df, others)})


def too_empty(df: DataFrame, share: float = 0.5) -> list[str]:
    _, nulls, rows = with_nulls(df)
    return [c for c in df.columns if rows and nulls[c] / rows > share]


def smart_missing(df: DataFrame) -> DataFrame:
    """Drop columns more than half empty, impute numbers from their nearest rows, fill the rest by mode."""
    from millrace.operators.neighbours import knn_impute

    out = df.drop(*too_empty(df))
    gaps, _, rows = with_nulls(out)
    numbers = numeric_columns(out)
    short = [c for c in gaps if c in numbers]
    others = [c for c in gaps if c not in numbers]
    if others:
        out = fill(out, fit_mode(out, others))
    if short and len(numbers) > 1:
        out = knn_impute(out, numbers, k=max(1, min(5, rows // 2)))
    elif short:
        out = fill(out, fit_median(out, short))
    return out
