"""Grouped and whole-table aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.semantics import (
    col,
    numeric_columns,
    small_table,
    text_columns,
)
from millrace.operators.stats import (
    aggregate_in_jobs,
    exact_quantiles,
    grouped_quantiles,
    moments,
    value_facts,
)


def group_aggregate(df: DataFrame, keys: Sequence[str], value: str | None, how: str, name: str = "value") -> DataFrame:
    """Group by one or two keys with count, sum, mean or median; rows with a null key are left out."""
    kept = df.dropna(subset=list(keys))
    if how == "median":
        return grouped_quantiles(kept, keys, value, {name: 0.5})
    target = col(value) if value else F.lit(1)
    agg = {
        "count": F.count(target),
        "sum": F.coalesce(F.sum(target), F.lit(0)),
        "mean": F.avg(target),
        "min": F.min(target),
        "max": F.max(target),
    }[how]
    return kept.groupBy(*[col(k) for k in keys]).agg(agg.alias(name))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts of the non-null values, most frequent first (ties by value)."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column)).agg(F.count(F.lit(1)).alias("count"))
    ordered = counts.orderBy(F.desc("count"), col(column))
    return ordered.limit(top) if top else ordered


def _cells(value: str, how: str):
    return {"mean": F.avg, "sum": F.sum, "count": F.count}[how](col(value))


def _places(df: DataFrame, column: str) -> DataFrame:
    """(__name, place): the different values of a column as text, in order from 1."""
    from millrace.operators.ordering import with_position

    names = df.select(col(column).cast("string").alias("__name")).where("__name is not null").distinct()
    return with_position(names, ["__name"], "place")


def pivot_long(df: DataFrame, row: str, column: str, value: str, how: str = "mean") -> DataFrame:
    """The filled cells of a pivot of any width: row, column (as text), place (of the column, from 1) and value."""
    from millrace.operators.joins import small_side

    known = df.where(col(row).isNotNull() & col(column).isNotNull())
    cells = known.groupBy(col(row).alias("row"), col(column).cast("string").alias("column")).agg(_cells(value, how).alias("value"))
    places = small_side(_places(known, column))
    return cells.join(places, F.col("column") == F.col("__name")).select("row", "column", F.col("place").cast("bigint").alias("place"), "value")


def pivot_page(df: DataFrame, row: str, column: str, value: str, how: str = "mean", page: int = 0, width: int = 200) -> DataFrame:
    """One page of a pivot of any width: all rows, and ``width`` of its columns in order from column ``page * width`` on."""
    known = df.where(col(row).isNotNull())
    some = _places(known, column).where((F.col("place") > page * width) & (F.col("place") <= (page + 1) * width))
    names = sorted(r["__name"] for r in some.select("__name").collect())  # at most ``width``
    name = F.when(col(column).cast("string").isin(names), col(column).cast("string")).alias("__column")
    cells = known.select(col(row), name, col(value).alias("__cell"))
    return cells.groupBy(col(row)).pivot("__column", names).agg(_cells("__cell", how)) if names else cells.select(col(row)).distinct()


def pivot(df: DataFrame, row: str, column: str, value: str, how: str = "mean", limit: int = 200) -> DataFrame:
    """``row`` x ``column`` table of an aggregate; the column values are read first, and are limited.

    :func:`pivot_long` and :func:`pivot_page` have no limit.
    """
    found = df.select(col(column).cast("string").alias("v")).where("v is not null").distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column!r} has more than {limit} values; use pivot_long or pivot_page")
    names = sorted(r["v"] for r in found)
    return df.where(col(row).isNotNull()).groupBy(col(row)).pivot(column, names).agg(_cells(value, how))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: non-null, null and distinct counts, null % and unique % of all rows."""
    columns = list(columns or df.columns)
    facts = moments(df, columns, ["count"])
    rows = facts[""]["rows"]
    seen = value_facts(df, columns)
    table = [(c, facts[c]["count"], rows - facts[c]["count"], seen[c]["unique"], rows) for c in columns]
    out = small_table(
        df.sparkSession, table, "column string, non_null bigint, nulls bigint, `unique` bigint, total bigint"
    )
    share = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, "total"), F.lit(0.0))
    return out.withColumns({"null_pct": share("nulls"), "unique_pct": share("unique")})


DESCRIBE = ["count", "mean", "std", "min", "max"]


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column."""
    columns = list(columns or numeric_columns(df))
    m = moments(df, columns, DESCRIBE)
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    table = [
        (c, m[c]["count"], m[c]["mean"], m[c]["std"], _float(m[c]["min"]), *q[c], _float(m[c]["max"])) for c in columns
    ]
    return small_table(
        df.sparkSession,
        table,
        "column string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double",
    )


def _float(v):
    return None if v is None else float(v)


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values, mode, its frequency, and missing values per text column."""
    columns = list(columns or text_columns(df, booleans=True))
    counts = moments(df, columns, ["count"])
    rows = counts[""]["rows"]
    seen = value_facts(df, columns)
    table = [
        (c, counts[c]["count"], seen[c]["unique"], seen[c]["top"], seen[c]["freq"], rows - counts[c]["count"], rows)
        for c in columns
    ]
    out = small_table(
        df.sparkSession,
        table,
        "column string, count bigint, `unique` bigint, top string, freq bigint, missing bigint, total bigint",
    )
    pct = F.coalesce(F.try_divide(F.col("missing") * 100.0, "total"), F.lit(0.0))
    return out.withColumn("missing_pct", pct).drop("total")


def describe_all(df: DataFrame) -> DataFrame:
    """Numeric and categorical description in one table; what does not apply is null."""
    parts = []
    if numeric_columns(df):
        parts.append(describe(df))
    if text_columns(df, booleans=True):
        parts.append(categorical_summary(df).drop("missing", "missing_pct"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def distribution(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, median, std, skewness and kurtosis per numeric column."""
    columns = list(columns or numeric_columns(df))
    m = moments(df, columns, ["mean", "std", "skew", "kurt"])
    q = exact_quantiles(df, columns, [0.5])
    table = [(c, m[c]["mean"], q[c][0], m[c]["std"], m[c]["skew"], m[c]["kurt"]) for c in columns]
    return small_table(
        df.sparkSession, table, "column string, mean double, median double, std double, skewness double, kurtosis double"
    )


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    q = exact_quantiles(df, columns, probs)
    table = [(c, float(p), v) for c in columns for p, v in zip(probs, q[c])]
    return small_table(df.sparkSession, table, "column string, p double, value double")


def median_absolute_deviation(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """``{column: (median, mad)}``: one pass for the medians, one for the deviations."""
    medians = exact_quantiles(df, columns, [0.5])
    known = [c for c in columns if medians[c][0] is not None]
    deviations = df.select(*[F.abs(col(c) - F.lit(medians[c][0])).alias(c) for c in known])
    mads = exact_quantiles(deviations, known, [0.5]) if known else {}
    return {c: (medians[c][0], mads.get(c, [None])[0]) for c in columns}


def mad_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    found = median_absolute_deviation(df, columns)
    return small_table(
        df.sparkSession, [(c, *found[c]) for c in columns], "column string, median double, mad double"
    )


def entropy(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shannon entropy (bits) of the value shares and its balance against the maximum."""
    seen = value_facts(df, columns)
    table = [(c, seen[c]["unique"], seen[c]["entropy"]) for c in columns]
    out = small_table(df.sparkSession, table, "column string, `unique` bigint, entropy double")
    balance = F.when(F.col("unique") > 1, F.col("entropy") / F.log2("unique")).otherwise(F.lit(1.0))
    return out.withColumn("balance", balance)


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair (pairwise complete), long form, both halves and diagonal."""
    columns = list(columns or numeric_columns(df))
    r = correlation_map(df, columns)
    table = [(a, b, r[a, b]) for a in columns for b in columns]
    return small_table(df.sparkSession, table, "a string, b string, r double")


def _pair_corr(a: Column, b: Column) -> Column:
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.corr(a, b))


def correlation_map(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float | None]:
    pairs = list(combinations(range(len(columns)), 2))
    exprs = [_pair_corr(col(columns[i]), col(columns[j])).alias(f"r{i}_{j}") for i, j in pairs]
    exprs += [F.when(F.min(col(c)) < F.max(col(c)), F.lit(1.0)).alias(f"r{i}_{i}") for i, c in enumerate(columns)]
    got = aggregate_in_jobs(df, exprs)
    out = {(c, c): got[f"r{i}_{i}"] for i, c in enumerate(columns)}
    for i, j in pairs:
        out[columns[i], columns[j]] = out[columns[j], columns[i]] = got[f"r{i}_{j}"]
    return out


def correlated_pairs(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.8) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    r = correlation_map(df, columns)
    table = [(a, b, r[a, b]) for a, b in combinations(columns, 2) if r[a, b] is not None]
    return small_table(df.sparkSession, table, "a string, b string, r double").where(F.abs("r") > threshold)


def target_correlations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """|correlation| of every feature with the target, strongest first."""
    exprs = [F.abs(_pair_corr(col(f), col(target))).alias(f"r{i}") for i, f in enumerate(features)]
    got = aggregate_in_jobs(df, exprs)
    table = [(f, got[f"r{i}"]) for i, f in enumerate(features)]
    return small_table(df.sparkSession, table, "feature string, score double").orderBy(F.desc_nulls_last("score"), "feature")


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """Sums of products over rows complete in ``columns``; p x p numbers reach the driver."""
    complete = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).dropna()
    p = len(columns)
    exprs = [F.count(F.lit(1)).alias("n")]
    exprs += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    got = aggregate_in_jobs(complete, exprs)
    gram = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            gram[i, j] = gram[j, i] = got[f"g{i}_{j}"] or 0.0
    return gram, got["n"]


def variance_inflation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """VIF per numeric column on complete rows, without intercept; empty below ten rows."""
    columns = list(columns or numeric_columns(df))
    gram, n = gram_matrix(df, columns)
    table = []
    if n >= 10 and columns:
        scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
        unit = gram / np.outer(scale, scale)
        inverse = np.linalg.pinv(unit) if np.linalg.matrix_rank(unit) < len(columns) else np.linalg.inv(unit)
        singular = np.linalg.matrix_rank(unit) < len(columns)
        for i, c in enumerate(columns):
            table.append((c, float("inf") if singular and inverse[i, i] <= 0 else float(unit[i, i] * inverse[i, i])))
    out = small_table(df.sparkSession, table, "feature string, vif double")
    status = F.when(F.col("vif") > 10, "High").when(F.col("vif") > 5, "Moderate").otherwise("Low")
    return out.withColumn("status", status)


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Rows and percentage per class of a target."""
    rows = df.count()
    counts = df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("class"))
    return counts.agg(
        F.count(F.lit(1)).alias("count"), F.round(F.count(F.lit(1)) / F.lit(rows) * 100, 2).alias("percentage")
    )


def imbalance(df: DataFrame, target: str) -> DataFrame:
    """Largest class over smallest class, with its band."""
    counts = class_balance(df, target)
    ratio = counts.agg(
        F.count(F.lit(1)).alias("classes"), F.try_divide(F.max("count"), F.min("count")).cast("double").alias("ratio")
    )
    band = F.when(F.col("ratio") > 5, "significant").when(F.col("ratio") > 2, "moderate").otherwise("balanced")
    return ratio.withColumn("band", band)


def quality_indicators(df: DataFrame) -> DataFrame:
    """Completeness, uniqueness and type consistency in percent, with bands."""
    from millrace.operators.dedup import duplicate_count

    counts = moments(df, df.columns, ["count"])
    rows, width = counts[""]["rows"], len(df.columns)
    cells = rows * width
    filled = sum(counts[c]["count"] for c in df.columns)
    dup = duplicate_count(df)
    complete = 100.0 * filled / cells if cells else 0.0
    repeated = 100.0 * dup / rows if rows else 0.0
    mixed = mixed_text_columns(df)
    consistent = 100.0 * (width - mixed) / width if width else 100.0
    band = lambda v: "excellent" if v >= 95 else "good" if v >= 80 else "needs attention"
    table = [
        ("completeness", complete, band(complete)),
        ("uniqueness", 100.0 - repeated, "no duplicates" if dup == 0 else "low duplicates" if repeated < 5 else "high duplicates"),
        ("type_consistency", consistent, band(consistent)),
    ]
    return small_table(df.sparkSession, table, "indicator string, value double, band string")


def mixed_type_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text column: how many values read as numbers and how many do not."""
    from millrace.functions.semantics import to_number

    columns = list(columns or text_columns(df))
    exprs = [F.count(to_number(col(c))).alias(f"n{i}") for i, c in enumerate(columns)]
    exprs += [F.count(col(c)).alias(f"t{i}") for i, c in enumerate(columns)]
    got = aggregate_in_jobs(df, exprs) if columns else {}
    table = [(c, got[f"n{i}"], got[f"t{i}"] - got[f"n{i}"]) for i, c in enumerate(columns)]
    out = small_table(df.sparkSession, table, "column string, numeric_values bigint, text_values bigint")
    return out.withColumn("mixed", (F.col("numeric_values") > 0) & (F.col("text_values") > 0))


def mixed_text_columns(df: DataFrame) -> int:
    return mixed_type_shares(df).where("mixed").count() if text_columns(df) else 0


def grand_totals(df: DataFrame) -> DataFrame:
    """Cells, null cells and the null rate of the whole table."""
    nulls = [F.count_if(col(c).isNull()) for c in df.columns]
    total = nulls[0]
    for n in nulls[1:]:
        total = total + n
    cells = F.count(F.lit(1)) * F.lit(len(df.columns))
    out = df.agg(cells.cast("bigint").alias("total_cells"), total.cast("bigint").alias("null_cells"))
    return out.withColumn("null_rate", F.coalesce(F.try_divide(F.col("null_cells") * 100.0, "total_cells"), F.lit(0.0)))


def kpi(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and maximum per column, one row each."""
    aggs = [F.struct(F.lit(c).alias("kpi"), F.avg(col(c)).alias("mean"), F.max(col(c)).cast("double").alias("max")) for c in columns]
    return df.agg(F.array(*aggs).alias("k")).selectExpr("inline(k)")


def group_means(df: DataFrame, columns: Sequence[str], category: str | None = None, top: int = 5) -> DataFrame:
    """Mean of several columns for the first ``top`` categories (by name), plus the axis maximum."""
    means = [F.avg(col(c)).alias(c) for c in columns]
    if category is None:
        out = df.agg(*means)
    else:
        out = df.where(col(category).isNotNull()).groupBy(col(category)).agg(*means).orderBy(col(category)).limit(top)
    peak = F.greatest(*[col(c) for c in columns]) if len(columns) > 1 else col(columns[0])
    # at most ``top`` rows are left here
    return out.withColumn("axis_max", F.max(peak).over(Window.partitionBy(F.lit(0))))


def flag_statistics(df: DataFrame, column: str, flag: Column) -> DataFrame:
    """Count, mean, median and std of a column for flagged and other rows."""
    marked = df.where(col(column).isNotNull()).select(
        F.when(flag, "outlier").otherwise("normal").alias("group"), col(column).alias("v")
    )
    basics = marked.groupBy("group").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")
    )
    return basics.join(grouped_quantiles(marked, ["group"], "v", {"median": 0.5}), "group")


def before_after(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, std, min and max of columns before and after a transform."""
    parts = []
    for label, frame in (("before", before), ("after", after)):
        rows = [
            F.struct(
                F.lit(label).alias("stage"),
                F.lit(c).alias("column"),
                F.avg(col(c)).alias("mean"),
                F.stddev_samp(col(c)).alias("std"),
                F.min(col(c)).cast("double").alias("min"),
                F.max(col(c)).cast("double").alias("max"),
            )
            for c in columns
        ]
        parts.append(frame.agg(F.array(*rows).alias("r")).selectExpr("inline(r)"))
    return parts[0].unionByName(parts[1])
