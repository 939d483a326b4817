"""Encoders and feature construction."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col, small_table
from millrace.operators.joins import small_side
from millrace.operators.ordering import with_position
from millrace.operators.stats import moments, value_facts
from millrace.session import cut_lineage

#: One-hot makes one column per category, so the number of categories is limited.
MAX_CATEGORIES = 200
NULL_LABEL = "nan"


def categories(df: DataFrame, column: str, most: int | None = None) -> list[str]:
    """Sorted distinct values as text; with ``most``, refuses columns with more than so many of them."""
    values = df.select(col(column).cast("string").alias("v")).where("v is not null").distinct()
    found = (values if most is None else values.limit(most + 1)).collect()
    if most is not None and len(found) > most:
        raise ValueError(f"{column!r} has more than {most} categories; use indicators or another encoder")
    return sorted(r["v"] for r in found)


def one_hot(
    df: DataFrame, columns: Sequence[str], drop_first: bool = False, null_category: bool = False, known: dict | None = None
) -> DataFrame:
    """One 0/1 column ``<column>_<category>`` per category; a null row is all zeros unless it is a category."""
    new: dict[str, Column] = {}
    for c in columns:
        names = list(known[c]) if known else categories(df, c, MAX_CATEGORIES)
        names = names[1:] if drop_first else names
        text = col(c).cast("string")
        for v in names:
            new[f"{c}_{v}"] = F.coalesce(text == F.lit(v), F.lit(False)).cast("int")
        if null_category:
            new[f"{c}_{NULL_LABEL}"] = col(c).isNull().cast("int")
    return df.withColumns(new).drop(*columns) if new else df


def fit_indicators(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """(value, code) of each column: its categories as text in order, from 0. Tables, so their number has no limit."""
    return {c: cut_lineage(codes(df, c)) for c in columns}


def indicators(
    df: DataFrame, columns: Sequence[str], fitted: dict[str, DataFrame] | None = None, drop_first: bool = False, null_category: bool = False
) -> DataFrame:
    """One-hot for any number of categories: each column becomes a sparse vector, struct(size, indices, values).

    The vector has a place for each category of the fitted table, but for the first if ``drop_first``, and a last one for
    nulls if ``null_category``. A null, a category that was not fitted and a dropped one are all zeros otherwise. Categories
    are found by a join, so no column is made for them; rows and other columns stay as they are.
    """
    fitted = fitted or fit_indicators(df, columns)
    out, skip = df, int(drop_first)
    for c in columns:
        known = max(fitted[c].count() - skip, 0)
        table = fitted[c].select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        out = out.withColumn("__text", col(c).cast("string")).join(small_side(table), F.col("__text") == F.col("__value"), "left")
        at = F.when(F.col("__code") >= skip, F.col("__code") - skip)
        at = F.when(F.col("__text").isNull(), F.lit(known)).otherwise(at) if null_category else at
        hit = F.when(at.isNull(), F.array().cast("array<int>")).otherwise(F.array(at.cast("int")))
        ones = F.when(at.isNull(), F.array().cast("array<double>")).otherwise(F.array(F.lit(1.0)))
        vector = F.struct(F.lit(known + int(null_category)).alias("size"), hit.alias("indices"), ones.alias("values"))
        out = out.withColumn(c, vector).drop("__text", "__value", "__code")
    return out.select(*[col(c) for c in df.columns])


def indicator_vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The sparse structs of :func:`indicators` as vectors for a model, made by the JVM's own encoder."""
    from pyspark.ml.feature import OneHotEncoder

    out = df
    for c in columns:
        size = (df.select(col(c)["size"].alias("n")).first() or [0])[0]
        # The encoder drops its last place, which stands for no category at all.
        place = F.coalesce(F.get(col(c)["indices"], F.lit(0)), F.lit(size)).cast("double")
        nominal = {"ml_attr": {"type": "nominal", "num_vals": size + 1}}
        out = out.withColumn("__place", place).withColumn("__place", F.col("__place").alias("__place", metadata=nominal))
        model = OneHotEncoder(inputCol="__place", outputCol="__vector", dropLast=True).fit(out)
        out = model.transform(out).withColumn(c, F.col("__vector")).drop("__place", "__vector")
    return out.select(*[col(c) for c in df.columns])


def codes(df: DataFrame, column: str, null_label: str | None = None) -> DataFrame:
    """``(value, code)``: position of each distinct value in sorted order, from 0."""
    text = col(column).cast("string")
    text = F.coalesce(text, F.lit(null_label)) if null_label else text
    values = df.select(text.alias("value")).where("value is not null").distinct()
    return with_position(values, ["value"], "code").select("value", (F.col("code") - 1).cast("int").alias("code"))


def _coded(df: DataFrame, columns: Sequence[str], null_label: str | None) -> DataFrame:
    out = df
    for c in columns:
        table = codes(df, c, null_label).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        text = col(c).cast("string")
        text = F.coalesce(text, F.lit(null_label)) if null_label else text
        out = out.withColumn("__text", text).join(small_side(table), F.col("__text") == F.col("__value"), "left")
        out = out.withColumn(c, F.col("__code")).drop("__text", "__value", "__code")
    return out


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted codes of the text values, a null counting as the text ``nan``."""
    return _coded(df, columns, NULL_LABEL)


def ordinal_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted codes; null stays null."""
    return _coded(df, columns, None)


def frequency_encode(df: DataFrame, columns: Sequence[str], share: bool = True) -> DataFrame:
    """``<column>_freq``: share of all non-null values, or the plain count."""
    out = df
    for c in columns:
        counts = df.where(col(c).isNotNull()).groupBy(col(c).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
        if share:
            total = moments(df, [c], ["count"])[c]["count"]
            counts = counts.withColumn("__n", F.col("__n") / F.lit(float(total or 1)))
        out = out.join(small_side(counts), col(c) == F.col("__value"), "left")
        out = out.withColumn(f"{c}_freq", F.col("__n")).drop("__value", "__n")
    return out


def binary_encode(df: DataFrame, column: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """1 where a two-valued column equals its first value (by ``order_by``, else the smaller value)."""
    seen = value_facts(df, [column])[column]["unique"]
    if seen != 2:
        raise ValueError(f"{column!r} has {seen} values, not 2")
    known = df.where(col(column).isNotNull())
    pick = F.min_by(col(column), F.struct(*[col(o) for o in order_by])) if order_by else F.min(col(column))
    first = known.agg(pick.alias("v")).first()["v"]
    return df.withColumn(column, F.coalesce(col(column) == F.lit(first), F.lit(False)).cast("int"))


def target_encode(df: DataFrame, columns: Sequence[str], target: str, smoothing: float = 10.0, least: int = 20) -> DataFrame:
    """Mean target per category, drawn to the overall mean where a category has few rows.

    The weight of a category with n rows is 1 / (1 + exp(-(n - least) / smoothing)); a category
    of one row, or one not seen, gets the overall mean.
    """
    overall = moments(df, [target], ["mean"])[target]["mean"]
    out = df
    for c in columns:
        groups = df.where(col(c).isNotNull()).groupBy(col(c).alias("__value"))
        stats = groups.agg(F.avg(col(target)).alias("__mean"), F.count(col(target)).alias("__n"))
        weight = 1 / (1 + F.exp(-(F.col("__n") - least) / F.lit(float(smoothing))))
        mixed = F.lit(overall) * (1 - weight) + F.col("__mean") * weight
        table = stats.select("__value", F.when(F.col("__n") > 1, mixed).otherwise(F.lit(overall)).alias("__code"))
        out = out.join(small_side(table), col(c) == F.col("__value"), "left")
        out = out.withColumn(c, F.coalesce("__code", F.lit(overall))).drop("__value", "__code")
    return out


ENCODERS = {
    "one_hot": one_hot,
    "label": label_encode,
    "ordinal": ordinal_encode,
    "frequency": frequency_encode,
}


def encode(df: DataFrame, columns: Sequence[str], method: str, target: str | None = None, **options) -> DataFrame:
    """Apply one encoder to chosen columns."""
    if method == "target":
        return target_encode(df, columns, target, **options)
    if method == "binary":
        out = df
        for c in columns:
            out = binary_encode(out, c, **options)
        return out
    return ENCODERS[method](df, columns, **options)


def encoding_summary(df: DataFrame, columns: Sequence[str], method: str, target: str | None = None) -> DataFrame:
    """Per column: method, distinct values before, columns added, and the target used."""
    seen = value_facts(df, columns)
    added = {"one_hot": lambda n: n, "frequency": lambda n: 1}.get(method, lambda n: 1)
    rows = [(c, method, seen[c]["unique"], added(seen[c]["unique"]), target) for c in columns]
    return small_table(
        df.sparkSession, rows, "column string, method string, original_unique bigint, new_columns bigint, target string"
    )


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """All products of the columns up to ``degree``, without the constant, added beside them."""
    new = {}
    for d in range(2, degree + 1):
        for combo in combinations_with_replacement(columns, d):
            powers = {c: combo.count(c) for c in dict.fromkeys(combo)}
            name = " ".join(c if k == 1 else f"{c}^{k}" for c, k in powers.items())
            value = col(combo[0]).cast("double")
            for c in combo[1:]:
                value = value * col(c)
            new[name] = value
    return df.withColumns(new)


def cut_equal(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``<column>_binned``: number of the equal-width, right-closed bin, from 0."""
    m = moments(df, [column], ["min", "max"])[column]
    name = f"{column}_binned"
    if m["min"] is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    low, high = float(m["min"]), float(m["max"])
    if low == high:  # the only value sits in the middle of a widened range
        return df.withColumn(name, F.when(col(column).isNotNull(), F.lit(-(-bins // 2) - 1)).cast("int"))
    width = (high - low) / bins
    at = F.ceil((col(column) - F.lit(low)) / F.lit(width)).cast("int") - 1
    return df.withColumn(name, F.when(at < 0, 0).when(at > bins - 1, bins - 1).otherwise(at))


def cut_edges(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str], name: str) -> DataFrame:
    """Right-closed bins with given edges and labels; outside values are null."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((col(column) > F.lit(low)) & (col(column) <= F.lit(high)), F.lit(label)).otherwise(out)
    return df.withColumn(name, out)
