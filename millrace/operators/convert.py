"""Type conversion: explicit, automatic, and storage-saving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.semantics import (
    ISO_DATE_PREFIX,
    col,
    collapse_blanks,
    dtype_name,
    small_table,
    strip,
    text_columns,
    title_case,
    to_flag,
    to_moment,
    to_number,
)
from millrace.operators.project import DATE_WORDS, named_like
from millrace.operators.stats import aggregate_in_jobs, value_facts


def cast_to(c: Column, target: str, source: T.DataType) -> Column:
    """A value as int64, float64, object, category, datetime or bool; what does not parse is null."""
    numeric = isinstance(source, (T.NumericType, T.BooleanType))
    if target == "int64":
        number = c.cast("double") if numeric else to_number(c)
        return number.try_cast("bigint")
    if target == "float64":
        return c.cast("double") if numeric else to_number(c)
    if target in ("object", "category"):
        return c.cast("string")
    if target == "datetime":
        return c.cast("timestamp_ntz") if dtype_name(source) == "datetime64[ns]" else to_moment(c)
    if target == "bool":
        return (c != 0) if isinstance(source, T.NumericType) else to_flag(c)
    raise ValueError(f"unknown target type {target!r}")


def convert(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    return df.withColumns({c: cast_to(col(c), target, df.schema[c].dataType) for c in columns})


def conversion_report(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Per column: share of rows with a value after the conversion, and how many newly failed."""
    exprs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        exprs.append(F.count(col(c)).alias(f"b{i}"))
        exprs.append(F.count(cast_to(col(c), target, df.schema[c].dataType)).alias(f"a{i}"))
    got = aggregate_in_jobs(df, exprs)
    rows = [
        (c, dtype_name(df.schema[c].dataType), target, got[f"a{i}"], got[f"b{i}"] - got[f"a{i}"], got["rows"])
        for i, c in enumerate(columns)
    ]
    out = small_table(
        df.sparkSession,
        rows,
        "column string, from_type string, to_type string, converted bigint, failed bigint, total bigint",
    )
    pct = F.coalesce(F.try_divide(F.col("converted") * 100.0, "total"), F.lit(0.0))
    return out.withColumns({"success_pct": pct, "success": F.col("failed") == 0}).drop("total")


def parse_counts(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, dict], int]:
    """Per text column: values, values that read as numbers, as dates, and with an ISO date prefix."""
    exprs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        exprs += [
            F.count(col(c)).alias(f"v{i}"),
            F.count(to_number(col(c))).alias(f"n{i}"),
            F.count(to_moment(col(c))).alias(f"d{i}"),
            F.count_if(col(c).rlike(ISO_DATE_PREFIX)).alias(f"p{i}"),
        ]
    got = aggregate_in_jobs(df, exprs)
    facts = {
        c: {"values": got[f"v{i}"], "numbers": got[f"n{i}"], "dates": got[f"d{i}"], "iso": got[f"p{i}"]}
        for i, c in enumerate(columns)
    }
    return facts, got["rows"]


def auto_types(df: DataFrame, rule: str = "share") -> dict[str, str]:
    """Which text columns to convert, and to what.

    ``share``: number if more than 80 % of rows parse, else date if more than 50 % start like one.
    ``loss``:  number if at most 30 % of rows are missing afterwards, else date if more than 50 % parse.
    ``number``: the first half of ``share`` only.
    """
    columns = text_columns(df)
    facts, rows = parse_counts(df, columns)
    chosen = {}
    for c in columns:
        f = facts[c]
        if not rows:
            continue
        if rule == "loss":
            if (rows - f["numbers"]) / rows <= 0.3:
                chosen[c] = "float64"
            elif f["dates"] / rows > 0.5:
                chosen[c] = "datetime"
        elif f["numbers"] / rows > 0.8:
            chosen[c] = "float64"
        elif rule == "share" and f["iso"] > rows * 0.5:
            chosen[c] = "datetime"
    return chosen


def apply_types(df: DataFrame, chosen: dict[str, str]) -> DataFrame:
    casts = {c: cast_to(col(c), t, df.schema[c].dataType) for c, t in chosen.items()}
    return df.withColumns(casts) if casts else df


def auto_convert(df: DataFrame, rule: str = "share") -> DataFrame:
    return apply_types(df, auto_types(df, rule))


def convert_date_columns(df: DataFrame) -> DataFrame:
    """Every column with ``date`` in its name becomes a timestamp."""
    return convert(df, named_like(df.columns, DATE_WORDS), "datetime")


def numeric_candidates(df: DataFrame) -> DataFrame:
    """Text columns with their share of values that read as numbers; candidates have any."""
    columns = text_columns(df)
    facts, _ = parse_counts(df, columns)
    rows = [(c, facts[c]["numbers"], facts[c]["values"]) for c in columns]
    out = small_table(df.sparkSession, rows, "column string, numbers bigint, `values` bigint")
    return out.withColumn("candidate", F.col("numbers") > 0)


def clean_text(df: DataFrame, columns: Sequence[str] | None = None, blanks: bool = True, title_below: int | None = 50):
    """Strip, collapse blanks, and title-case columns with few distinct values."""
    columns = list(columns if columns is not None else text_columns(df))
    step = {c: collapse_blanks(strip(col(c))) if blanks else strip(col(c)) for c in columns}
    if not step:
        return df
    out = df.withColumns(step)
    if title_below is not None:
        seen = value_facts(out, columns)
        few = [c for c in columns if seen[c]["unique"] < title_below]
        if few:
            out = out.withColumns({c: title_case(col(c)) for c in few})
    return out


_INTEGER_STEPS = [("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31)]
_WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


def storage_plan(df: DataFrame) -> DataFrame:
    """Smallest type that holds every value of a column, dictionary candidates, and bytes before and after."""
    integers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType))]
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    texts = text_columns(df)
    exprs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(integers):
        exprs += [F.min(col(c)).alias(f"lo{i}"), F.max(col(c)).alias(f"hi{i}")]
    for i, c in enumerate(doubles):
        rounded = col(c).cast("float").cast("double")
        close = F.abs(rounded - col(c)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(col(c))
        exprs.append(F.coalesce(F.bool_and(close), F.lit(True)).alias(f"f{i}"))
    for i, c in enumerate(texts):
        exprs.append(F.coalesce(F.sum(F.octet_length(col(c))), F.lit(0)).alias(f"b{i}"))
    got = aggregate_in_jobs(df, exprs)
    rows = got["rows"]
    seen = value_facts(df, texts)
    plan = []
    for i, c in enumerate(integers):
        now = df.schema[c].dataType.simpleString()
        low, high = got[f"lo{i}"], got[f"hi{i}"]
        best = now
        if low is not None:
            fits = [t for t, limit in _INTEGER_STEPS if -limit <= low and high < limit and _WIDTH[t] < _WIDTH[now]]
            best = fits[0] if fits else now
        plan.append((c, now, best, rows * _WIDTH[now], rows * _WIDTH[best]))
    for i, c in enumerate(doubles):
        best = "float" if got[f"f{i}"] else "double"
        plan.append((c, "double", best, rows * 8, rows * _WIDTH[best]))
    for i, c in enumerate(texts):
        size = got[f"b{i}"]
        coded = rows and seen[c]["unique"] / rows < 0.5
        width = 1 if seen[c]["unique"] < 2**7 else 2 if seen[c]["unique"] < 2**15 else 4
        after = round(size / max(rows, 1) * seen[c]["unique"]) + rows * width if coded else size
        plan.append((c, "string", "category" if coded else "string", size, min(size, after)))
    return small_table(
        df.sparkSession, plan, "column string, type string, best string, bytes_before bigint, bytes_after bigint"
    )


def shrink(df: DataFrame) -> DataFrame:
    """Cast numbers to the smallest type of ``storage_plan`` (Parquet encodes the text dictionaries)."""
    narrower = {r["column"]: r["best"] for r in storage_plan(df).collect() if r["best"] in _WIDTH}
    return df.withColumns({c: col(c).cast(t) for c, t in narrower.items()}) if narrower else df
