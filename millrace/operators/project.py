"""Column choice and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import column_groups, col, numeric_columns, small_table
from millrace.operators.stats import moments

#: Column-name keywords of the automatic fixes.
AMOUNT_WORDS = ["quantity", "price", "amount", "cost", "sales"]
COUNT_WORDS = ["quantity", "price"]
DATE_WORDS = ["date"]


def type_groups(df: DataFrame) -> DataFrame:
    rows = [(kind, c) for kind, names in column_groups(df).items() for c in names]
    return small_table(df.sparkSession, rows, "kind string, column string")


def named_like(columns: Sequence[str], words: Sequence[str]) -> list[str]:
    return [c for c in columns if any(w in c.lower() for w in words)]


def keep_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(col(column).isin(list(values)))


def offered_values(df: DataFrame, column: str, limit: int = 100) -> DataFrame:
    """The values a picker offers, smallest first; one more than ``limit`` shows there are more."""
    return df.select(col(column)).where(col(column).isNotNull()).distinct().orderBy(col(column)).limit(limit)


def search_text(df: DataFrame, column: str, text: str) -> DataFrame:
    """Case-insensitive substring search on the value as text."""
    return df.where(F.lower(col(column).cast("string")).contains(text.lower()))


def keep_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Inclusive range; an open end keeps every non-null value."""
    kept = df.where(col(column).isNotNull())
    if low is not None:
        kept = kept.where(col(column) >= F.lit(low))
    if high is not None:
        kept = kept.where(col(column) <= F.lit(high))
    return kept


def complete_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(subset) if subset else None)


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop columns without any value, then rows without any value."""
    counts = moments(df, df.columns, ["count"])
    empty = [c for c in df.columns if counts[c]["count"] == 0 and counts[""]["rows"] > 0]
    return df.drop(*empty).dropna("all")


def drop_zero_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a zero in quantity- or price-named columns, unless half of the rows are zero.

    Columns are decided in turn on what the ones before them left, which one aggregate
    can answer: the count for column i is taken under the filters chosen so far.
    """
    columns = list(columns if columns is not None else named_like(numeric_columns(df), COUNT_WORDS))
    kept = df
    for c in columns:
        got = kept.agg(F.count_if(col(c) == 0).alias("z"), F.count(F.lit(1)).alias("n")).first()
        if 0 < got["z"] < got["n"] * 0.5:
            kept = kept.where(col(c).isNull() | (col(c) != 0))
    return kept


def features_and_target(df: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
    return df.select(*[col(f) for f in features], *([col(target)] if target else []))


# --- user expressions and the named presets ------------------------------------------------


def derive(df: DataFrame, name: str, expression: str) -> DataFrame:
    """A new column from a SQL expression; no program text is executed."""
    return df.withColumn(name, F.expr(expression))


def z_normalised(df: DataFrame, column: str, name: str) -> DataFrame:
    m = moments(df, [column], ["mean", "std"])[column]
    return df.withColumn(name, (col(column) - F.lit(m["mean"])) / F.nullif(F.lit(m["std"]), F.lit(0.0)))


def above_median(df: DataFrame, column: str, name: str) -> DataFrame:
    from millrace.operators.stats import exact_quantiles

    middle = exact_quantiles(df, [column], [0.5])[column][0]
    return df.withColumn(name, F.coalesce(col(column) > F.lit(middle), F.lit(False)).cast("int"))


def year_of(df: DataFrame, column: str, name: str) -> DataFrame:
    from millrace.functions.semantics import to_moment

    return df.withColumn(name, F.year(to_moment(col(column))))


def joined_text(df: DataFrame, columns: Sequence[str], name: str, sep: str = " ") -> DataFrame:
    """Text of several columns with a separator; null if any part is null."""
    parts = []
    for i, c in enumerate(columns):
        parts += ([F.lit(sep)] if i else []) + [col(c).cast("string")]
    return df.withColumn(name, F.concat(*parts))
