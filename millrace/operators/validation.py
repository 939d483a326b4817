"""Column and table validation, profiles, audits and recommendations.

Facts about all columns come from four scans whatever the number of columns: moments and
parse counts, value counts (one shuffle), quartiles, and counts beyond the quartile fences.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import (
    FALSE_WORDS,
    TRUE_WORDS,
    col,
    dtype_name,
    nested_to_text,
    numeric_columns,
    sample_kurtosis,
    sample_skewness,
    small_table,
    text_columns,
    to_moment,
    to_number,
)
from millrace.operators.aggregate import correlated_pairs, imbalance, variance_inflation
from millrace.operators.dedup import duplicates_table
from millrace.operators.outliers import range_facts
from millrace.operators.stats import aggregate_in_jobs, at_once, value_facts

#: Column-name keywords of likely targets.
TARGET_WORDS = ["target", "label", "class", "outcome", "result", "prediction"]


def column_facts(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, dict], int]:
    """Everything the rules below need to know, per column."""
    numbers = set(numeric_columns(df))
    texts = set(text_columns(df))
    exprs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        x = col(c)
        exprs.append(F.count(x).alias(f"count{i}"))
        if c in numbers:
            exprs += [sample_skewness(x).alias(f"skew{i}"), sample_kurtosis(x).alias(f"kurt{i}")]
        elif c in texts:
            exprs += [
                F.count(to_number(x)).alias(f"numbers{i}"),
                F.count(to_moment(x)).alias(f"dates{i}"),
                F.count_if(F.lower(x).isin(TRUE_WORDS + FALSE_WORDS)).alias(f"flags{i}"),
            ]
    got, seen, far = at_once(
        lambda: aggregate_in_jobs(df, exprs),
        lambda: value_facts(df, columns),
        lambda: range_facts(df, [c for c in columns if c in numbers]),
    )
    rows = got["rows"]
    facts = {}
    for i, c in enumerate(columns):
        facts[c] = {
            "dtype": dtype_name(df.schema[c].dataType),
            "count": got[f"count{i}"],
            "skew": got.get(f"skew{i}"),
            "kurt": got.get(f"kurt{i}"),
            "numbers": got.get(f"numbers{i}"),
            "dates": got.get(f"dates{i}"),
            "flags": got.get(f"flags{i}"),
            **{k: seen[c][k] for k in ("unique", "top", "freq", "entropy")},
            **far.get(c, {"outliers": 0, "far": 0, "iqr": 0.0}),
        }
    return facts, rows


def inferred_type(f: dict, compat: bool = True) -> str:
    """Type a column's values suggest. ``compat`` reads every number, flag and date column as float64."""
    if f["count"] == 0:
        return f["dtype"]
    if f["numbers"] is None:
        return "float64" if compat else f["dtype"]
    for key, kind in (("numbers", "float64"), ("dates", "datetime64[ns]"), ("flags", "bool")):
        if f[key] == f["count"]:
            return kind
    return "object"


def _health(f: dict) -> float:
    """Closeness to normal for numbers, evenness of the value shares for the rest; 0 to 100."""
    if f["count"] == 0:
        return 0.0
    if f["dtype"] in ("int64", "float64"):
        if f["count"] < 3:
            return 50.0
        skew, kurt = f["skew"], f["kurt"]
        by_skew = max(0.0, 100 - abs(skew) * 10)
        by_kurt = max(0.0, 100 - abs(kurt) * 5) if kurt is not None else 0.0
        return (by_skew + by_kurt) / 2
    return 100.0 if f["unique"] == 1 else f["entropy"] / math.log2(f["unique"]) * 100


VALIDATION_FACTS = (
    "column string, data_type string, inferred_type string, total_count bigint, non_null_count bigint, "
    "unique_count bigint, valid_range boolean, outlier_count bigint, distribution_health double"
)


def _validation_from(df: DataFrame, facts: dict, rows: int, compat: bool) -> DataFrame:
    table = [
        (
            c,
            f["dtype"],
            inferred_type(f, compat),
            rows,
            f["count"],
            f["unique"],
            f["count"] == 0 or f["far"] / f["count"] <= 0.05,
            f["outliers"],
            float(_health(f)),
        )
        for c, f in facts.items()
    ]
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a) * 100.0, b), F.lit(0.0))
    out = small_table(df.sparkSession, table, VALIDATION_FACTS)
    out = out.withColumns(
        {
            "null_count": F.col("total_count") - F.col("non_null_count"),
            "completeness_pct": share("non_null_count", "total_count"),
            "uniqueness_pct": share("unique_count", "non_null_count"),
            "type_consistency": F.col("data_type") == F.col("inferred_type"),
            "outlier_impact": share("outlier_count", "non_null_count"),
        }
    )
    validity = (
        F.col("completeness_pct") * 0.3
        + (100 - F.col("outlier_impact")) * 0.2
        + F.when(F.col("type_consistency"), 100).otherwise(50) * 0.2
        + F.when(F.col("valid_range"), 100).otherwise(0) * 0.1
        + F.col("distribution_health") * 0.2
    )
    out = out.withColumn("validity_score", validity)
    overall = F.col("completeness_pct") * 0.4 + F.col("uniqueness_pct") * 0.2 + F.col("validity_score") * 0.4
    return out.withColumn("overall_score", overall)


def validate_columns(df: DataFrame, columns: Sequence[str] | None = None, compat: bool = True) -> DataFrame:
    """One quality record per column."""
    df = nested_to_text(df)
    facts, rows = column_facts(df, list(columns or df.columns))
    return _validation_from(df, facts, rows, compat)


def type_inference(df: DataFrame, compat: bool = True) -> DataFrame:
    df = nested_to_text(df)
    return validate_columns(df, compat=compat).select("column", "data_type", "inferred_type", "type_consistency")


def distribution_health(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return validate_columns(df, columns).select("column", "distribution_health")


def range_checks(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Outliers by the quartile fences, and whether at most 5 % lie beyond the wide ones."""
    return validate_columns(df, columns or numeric_columns(df)).select("column", "outlier_count", "valid_range")


def cardinality_health(df: DataFrame) -> DataFrame:
    """Per column: score of its distinct share; the table's health is their mean."""
    df = nested_to_text(df)
    seen = value_facts(df, df.columns)
    rows = df.count()
    numbers = set(numeric_columns(df))
    table = [(c, c in numbers, seen[c]["unique"], rows) for c in df.columns]
    out = small_table(df.sparkSession, table, "column string, numeric boolean, `unique` bigint, total bigint")
    out = out.withColumn("unique_ratio", F.coalesce(F.try_divide(F.col("unique"), "total"), F.lit(0.0)))
    u = F.col("unique_ratio")
    number = F.when(u.between(0.7, 0.95), 100).when(u < 0.1, 30).when(u > 0.99, 70).otherwise(80)
    other = F.when(u.between(0.01, 0.1), 100).when(u > 0.8, 30).otherwise(70)
    return out.withColumn("score", F.when(F.col("numeric"), number).otherwise(other)).select(
        "column", "unique_ratio", "score"
    )


def potential_targets(df: DataFrame) -> DataFrame:
    """Columns that look like a label: by name, two values, or two to ten values."""
    df = nested_to_text(df)
    seen = value_facts(df, df.columns)
    rows = []
    for f in df.schema.fields:
        n, kind = seen[f.name]["unique"], dtype_name(f.dataType)
        if any(w in f.name.lower() for w in TARGET_WORDS):
            rows.append((f.name, n, "name"))
        elif n == 2 and kind in ("int64", "float64", "object", "bool"):
            rows.append((f.name, n, "binary"))
        elif 2 <= n <= 10 and kind in ("object", "int64"):
            rows.append((f.name, n, "few values"))
    return small_table(df.sparkSession, rows, "column string, `unique` bigint, reason string")


def robustness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean column score, columns of high (>= 80) and low (< 60) quality."""
    return validate_columns(df, columns).agg(
        F.avg("overall_score").alias("overall_robustness"),
        F.count_if(F.col("overall_score") >= 80).alias("high_quality_columns"),
        F.count_if(F.col("overall_score") < 60).alias("low_quality_columns"),
    )


def robustness_breakdown(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return validate_columns(df, columns).select(
        "column", "completeness_pct", "uniqueness_pct", "validity_score", "overall_score"
    )


def _issues(*rules) -> F.Column:
    """Rows of the rules that hold, from ``(condition, struct)`` pairs."""
    rows = F.array(*[F.when(condition, row) for condition, row in rules])
    return F.explode(F.filter(rows, lambda r: r.isNotNull()))


def _advice(priority, title, description, action, impact):
    text = lambda v: v if isinstance(v, F.Column) else F.lit(v)
    return F.struct(
        text(priority).alias("priority"),
        text(title).alias("title"),
        text(description).alias("description"),
        text(action).alias("action"),
        text(impact).alias("impact"),
    )


def recommendations_from(validated: DataFrame) -> DataFrame:
    """Advice per column from its validation record."""
    c = F.col("column")
    gaps = F.format_string("%d of %d values missing", "null_count", "total_count")
    rules = [
        (
            F.col("completeness_pct") < 50,
            _advice("High", F.concat(F.lit("Mostly missing: "), c), gaps, "drop the column or repair its collection",
                    "models stop depending on an empty column"),
        ),
        (
            (F.col("completeness_pct") >= 50) & (F.col("completeness_pct") < 80),
            _advice("Medium", F.concat(F.lit("Gaps: "), c), gaps, "impute the missing values", "the column can be kept"),
        ),
        (
            F.col("outlier_impact") > 10,
            _advice("Medium", F.concat(F.lit("Outliers: "), c), F.format_string("%d outliers", "outlier_count"),
                    "remove or cap beyond the quartile fences", "more stable models"),
        ),
        (
            ~F.col("type_consistency"),
            _advice("Medium", F.concat(F.lit("Type: "), c),
                    F.concat(F.lit("stored as "), F.col("data_type"), F.lit(", looks like "), F.col("inferred_type")),
                    "convert the column", "right operations for the type"),
        ),
        (
            (F.col("data_type") == "object") & (F.col("uniqueness_pct") > 80) & (F.col("unique_count") > 50),
            _advice("Low", F.concat(F.lit("Many values: "), c), F.format_string("%d distinct values", "unique_count"),
                    "treat as identifier or group rare values", "smaller and more general models"),
        ),
    ]
    return validated.select("column", _issues(*rules).alias("r")).select("column", "r.*")


def column_recommendations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return recommendations_from(validate_columns(df, columns))


def column_issues(df: DataFrame, columns: Sequence[str] | None = None, records: DataFrame | None = None) -> DataFrame:
    """Issues shown on a column's page: gaps, outliers, type, cardinality. ``records`` of the columns need no scan."""
    issue = lambda kind, n: F.struct(F.lit(kind).alias("issue"), n.cast("bigint").alias("affected"))
    rules = [
        (F.col("completeness_pct") < 95, issue("missing", F.col("null_count"))),
        (F.col("outlier_impact") > 5, issue("outliers", F.col("outlier_count"))),
        (~F.col("type_consistency"), issue("type", F.col("non_null_count"))),
        ((F.col("data_type") == "object") & (F.col("uniqueness_pct") > 90), issue("cardinality", F.col("unique_count"))),
    ]
    records = validate_columns(df, columns) if records is None else records
    return records.select("column", _issues(*rules).alias("r")).select("column", "r.*")


def byte_estimate(df: DataFrame) -> F.Column:
    """Aggregate: bytes of the rows by type width, text by its length."""
    parts = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        width = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}.get(kind, 8)
        x = col(f.name)
        parts.append(F.coalesce(F.octet_length(x), F.lit(0)) if kind == "string" else F.lit(width))
    return F.coalesce(F.sum(reduce(lambda a, b: a + b, parts)), F.lit(0)).cast("bigint")


def profile(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, duplicate rows, types and missing share per column, in one row."""
    plain = nested_to_text(df)
    missing = [F.count_if(col(c).isNull()) for c in plain.columns]
    rows = F.count(F.lit(1))
    per_column = F.map_from_arrays(
        F.array(*[F.lit(c) for c in plain.columns]),
        F.array(*[F.coalesce(F.try_divide(m * 100.0, rows), F.lit(0.0)) for m in missing]),
    )
    kinds: dict[str, int] = {}
    for f in df.schema.fields:
        kinds[dtype_name(f.dataType)] = kinds.get(dtype_name(f.dataType), 0) + 1
    types = F.create_map(*[F.lit(v).cast("bigint") if isinstance(v, int) else F.lit(v) for k in kinds.items() for v in k])
    out = plain.agg(
        rows.alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        reduce(lambda a, b: a + b, missing).cast("bigint").alias("missing_values"),
        byte_estimate(plain).alias("bytes"),
        per_column.alias("missing_by_column"),
    )
    dup = duplicates_table(plain).first()["duplicate_rows"]
    return out.withColumns({"data_types": types, "duplicate_rows": F.lit(dup).cast("bigint")})


def quality_score(df: DataFrame) -> DataFrame:
    """100 - 2 x missing % - 3 x duplicate %, within 0..100, with its band."""
    p = profile(df).select("total_rows", "total_columns", "missing_values", "duplicate_rows")
    cells = F.col("total_rows") * F.col("total_columns")
    out = p.withColumns(
        {
            "missing_pct": F.coalesce(F.try_divide(F.col("missing_values") * 100.0, cells), F.lit(0.0)),
            "duplicate_pct": F.coalesce(F.try_divide(F.col("duplicate_rows") * 100.0, "total_rows"), F.lit(0.0)),
        }
    )
    raw = 100 - F.col("missing_pct") * 2 - F.col("duplicate_pct") * 3
    out = out.withColumn("quality_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))
    band = F.when(F.col("quality_score") >= 90, "excellent").when(F.col("quality_score") >= 70, "good").otherwise("fair")
    return out.withColumn("band", band)


def quality_report(df: DataFrame) -> DataFrame:
    """Score with grade, overview, duplicates and alerts in one row."""
    s = quality_score(df)
    q = F.col("quality_score")
    grade = F.when(q >= 90, "A").when(q >= 80, "B").when(q >= 70, "C").when(q >= 60, "D").otherwise("F")
    alert = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("message"))
    alerts = F.filter(
        F.array(
            F.when(F.col("missing_pct") > 5, alert("missing", F.format_string("%.1f%% of cells missing", "missing_pct"))),
            F.when(F.col("duplicate_rows") > 0, alert("duplicates", F.format_string("%d duplicate rows", "duplicate_rows"))),
        ),
        lambda a: a.isNotNull(),
    )
    return s.select(
        F.struct(q.alias("overall"), grade.alias("grade")).alias("quality_score"),
        F.struct(
            F.col("total_rows").alias("n_rows"),
            F.col("total_columns").alias("n_columns"),
            F.col("missing_pct").alias("missing_percentage"),
        ).alias("overview"),
        F.struct(F.col("duplicate_rows").alias("n_duplicates")).alias("duplicates"),
        alerts.alias("alerts"),
    )


def quality_overview(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: rows, columns, missing %, duplicates."""
    parts = [
        quality_score(t).select(F.lit(n).alias("dataset"), "total_rows", "total_columns", "missing_pct", "duplicate_rows")
        for n, t in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def platform_totals(tables: dict[str, DataFrame], models: int = 0, operations: int = 0) -> DataFrame:
    """Datasets, models, operations, and rows and columns over all datasets."""
    parts = [
        t.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(t.columns)).cast("bigint"))
        for t in tables.values()
    ]
    return reduce(DataFrame.unionByName, parts).agg(
        F.count(F.lit(1)).alias("datasets"),
        F.lit(models).cast("bigint").alias("models"),
        F.lit(operations).cast("bigint").alias("operations"),
        F.sum("rows").alias("total_rows"),
        F.sum("columns").alias("total_columns"),
    )


def dataset_recommendations(df: DataFrame) -> DataFrame:
    """Advice on the table: null rate, duplicates, size, and unbalanced two-valued targets."""
    p = profile(df)
    cells = F.col("total_rows") * F.col("total_columns")
    null_rate = F.coalesce(F.try_divide(F.col("missing_values") * 100.0, cells), F.lit(0.0))
    dup_rate = F.coalesce(F.try_divide(F.col("duplicate_rows") * 100.0, "total_rows"), F.lit(0.0))
    rules = [
        (
            null_rate > 20,
            _advice("High", "Many missing cells", F.format_string("%.1f%% of cells missing", null_rate),
                    "find the cause, then impute", "usable data"),
        ),
        (
            F.col("duplicate_rows") > 0,
            _advice(F.when(dup_rate > 10, "High").otherwise("Medium"), "Duplicate rows",
                    F.format_string("%d duplicate rows", "duplicate_rows"), "drop duplicates", "no leakage between splits"),
        ),
        (
            F.col("bytes") > 100 * 1024 * 1024,
            _advice("Low", "Large table", F.format_string("%d bytes", "bytes"), "use narrower types", "less memory"),
        ),
    ]
    out = p.select(_issues(*rules).alias("r")).select("r.*")
    for t in potential_targets(df).where(F.col("unique") == 2).collect():
        ratio = imbalance(nested_to_text(df), t["column"])
        rule = (
            F.col("ratio") > 5,
            _advice("Medium", f"Unbalanced classes in {t['column']}", F.format_string("ratio %.1f to 1", "ratio"),
                    "resample or weight the classes", "better results on the small class"),
        )
        out = out.unionByName(ratio.select(_issues(rule).alias("r")).select("r.*"))
    return out


PRIORITIES = ["High", "Medium", "Low"]


def _rank(priority="priority"):
    p = F.col(priority)
    return F.when(p == "High", 0).when(p == "Medium", 1).otherwise(2)


def all_recommendations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Column and table advice together, most urgent first."""
    both = column_recommendations(df, columns).drop("column").unionByName(dataset_recommendations(df))
    return both.orderBy(_rank(), "title")


def priority_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return all_recommendations(df, columns).groupBy("priority").agg(F.count(F.lit(1)).alias("count"))


def audit(df: DataFrame) -> DataFrame:
    """Audit items: gaps above 20 %, duplicates, text that holds numbers, more than 5 % outliers."""
    plain = nested_to_text(df)
    facts, rows = column_facts(plain, plain.columns)
    dup = duplicates_table(plain).first()["duplicate_rows"]
    items = []
    for c, f in facts.items():
        gap = (rows - f["count"]) / rows * 100 if rows else 0.0
        if gap > 20:
            items.append(("High", "missing", c, rows - f["count"], "impute the gaps or leave the column out"))
        if f["numbers"]:
            items.append(("Medium", "numeric text", c, f["numbers"], "convert the column to numbers"))
        if f["dtype"] in ("int64", "float64") and f["outliers"] > rows * 0.05:
            items.append(("Medium", "outliers", c, f["outliers"], "remove or cap beyond the quartile fences"))
    if dup:
        priority = "High" if dup / rows * 100 > 10 else "Medium"
        items.append((priority, "duplicates", None, dup, "drop duplicate rows"))
    return small_table(
        df.sparkSession, items, "priority string, issue string, column string, affected bigint, recommendation string"
    )


def insights(df: DataFrame, name: str = "dataset") -> DataFrame:
    """Report facts as (section, metric, value): summary, overview, insights."""
    s = quality_score(df)
    kinds = {"numeric": len(numeric_columns(df)), "categorical": len(text_columns(df))}
    number = lambda c: c.cast("double")
    fact = lambda section, metric, value: F.struct(
        F.lit(section).alias("section"), F.lit(metric).alias("metric"), value.alias("value")
    )
    facts = [
        (F.lit(True), fact("summary", "total_records", number(F.col("total_rows")))),
        (F.lit(True), fact("summary", "total_features", number(F.col("total_columns")))),
        (F.lit(True), fact("summary", "completeness_pct", 100 - F.col("missing_pct"))),
        (F.lit(True), fact("overview", "missing_values", number(F.col("missing_values")))),
        (F.lit(True), fact("overview", "duplicate_rows", number(F.col("duplicate_rows")))),
        (F.lit(True), fact("insight", "numeric_features", F.lit(float(kinds["numeric"])))),
        (F.lit(True), fact("insight", "categorical_features", F.lit(float(kinds["categorical"])))),
        (F.col("missing_pct") > 5, fact("insight", "impute_missing_pct", F.col("missing_pct"))),
        (F.col("duplicate_rows") > 0, fact("insight", "deduplicate_rows", number(F.col("duplicate_rows")))),
    ]
    return s.select(_issues(*facts).alias("r")).select(F.lit(name).alias("dataset"), "r.*")


def sample_values(df: DataFrame, n: int = 3) -> DataFrame:
    """Per column: type, non-null count and the ``n`` smallest distinct values as text."""
    plain = nested_to_text(df)
    texts = {c: col(c).cast("string") for c in plain.columns}
    counts = aggregate_in_jobs(plain, [F.count(x).alias(f"n{i}") for i, x in enumerate(texts.values())])
    # n scans for all columns, without a shuffle: each finds the least value above the last one
    found: dict[str, list] = {c: [] for c in texts}
    for _ in range(n):
        exprs = []
        for i, (c, x) in enumerate(texts.items()):
            above = F.when(x > F.lit(found[c][-1]), x) if found[c] else x
            if not found[c] or found[c][-1] is not None:
                exprs.append(F.min(above).alias(f"v{i}"))
        got = aggregate_in_jobs(plain, exprs) if exprs else {}
        for i, c in enumerate(texts):
            if f"v{i}" in got:
                found[c].append(got[f"v{i}"])
    rows = [
        (f.name, dtype_name(f.dataType), counts[f"n{i}"], [v for v in found[f.name] if v is not None])
        for i, f in enumerate(df.schema.fields)
    ]
    return small_table(
        df.sparkSession, rows, "column string, data_type string, non_null bigint, samples array<string>"
    )


def next_steps(df: DataFrame) -> DataFrame:
    """Suggested charts, models and the score band for a cleaned table."""
    numbers, texts = numeric_columns(df), text_columns(df)
    rows = []
    if numbers:
        rows.append(("chart", f"histogram of {numbers[0]}"))
        if len(numbers) >= 2:
            rows.append(("chart", f"scatter of {numbers[0]} and {numbers[1]}"))
        if texts:
            rows.append(("chart", f"bar chart of {texts[0]}"))
    if len(numbers) >= 2:
        rows.append(("model", "random forest"))
        rows.append(("model", "automatic model search"))
    score = quality_score(df).select(F.lit("quality").alias("topic"), F.col("band").alias("advice"))
    return small_table(df.sparkSession, rows, "topic string, advice string").unionByName(score)


def recommend_charts(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """Up to five chart types for one or two columns, best first."""
    unique = value_facts(nested_to_text(df), [x])[x]["unique"]
    numbers = set(numeric_columns(df)) | set(f.name for f in df.schema.fields if f.dataType.simpleString() == "boolean")
    offers = []
    if unique < 20 or dtype_name(df.schema[x].dataType) == "object":
        offers += [("Bar Chart", 95, "comparing categories"), ("Pie Chart", 85, "parts of a whole")]
        if unique <= 10:
            offers.append(("Donut Chart", 80, "parts of a whole"))
    if x in numbers and y in numbers:
        offers += [("Scatter Plot", 95, "correlation"), ("Line Chart", 90, "trend")]
    if x in numbers and not y:
        offers += [("Histogram", 95, "distribution"), ("Box Plot", 90, "quartiles and outliers"), ("Violin Plot", 85, "distribution")]
    offers = sorted(offers, key=lambda o: -o[1])[:5]
    rows = [(i + 1, *o) for i, o in enumerate(offers)]
    return small_table(df.sparkSession, rows, "rank int, chart string, score int, best_for string")


def column_detail(df: DataFrame, column: str) -> DataFrame:
    """Everything about one column as (part, label, value): record, histogram or top values, issues."""
    from millrace.operators.aggregate import value_counts
    from millrace.operators.charts import histogram

    record = validate_columns(df, [column])
    fields = ["total_count", "non_null_count", "unique_count", "completeness_pct", "validity_score", "overall_score"]
    pairs = F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).cast("double").alias("value")) for n in fields])
    parts = [record.select(F.lit("record").alias("part"), F.inline(pairs))]
    if column in numeric_columns(df):
        bars = histogram(df, column, 30).select(F.col("bin").cast("string").alias("label"), F.col("count").cast("double").alias("value"))
        parts.append(bars.select(F.lit("histogram").alias("part"), "label", "value"))
    else:
        top = value_counts(df, column, 10)
        parts.append(
            top.select(F.lit("top").alias("part"), col(column).cast("string").alias("label"), F.col("count").cast("double").alias("value"))
        )
    issues = column_issues(df, [column], record)
    parts.append(issues.select(F.lit("issue").alias("part"), F.col("issue").alias("label"), F.col("affected").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def validate_dataset(df: DataFrame, target: str | None = None) -> DataFrame:
    """Table checks as (check, subject, value, status): nulls, duplicates, cardinality, balance, VIF, correlation."""
    s = quality_score(df)
    band = lambda v, good, fair: F.when(v <= good, "ok").when(v <= fair, "warn").otherwise("bad")
    parts = [
        s.select(F.lit("null_rate").alias("check"), F.lit("table").alias("subject"), F.col("missing_pct").alias("value"),
                 band(F.col("missing_pct"), 5, 20).alias("status")),
        s.select(F.lit("duplicate_rate").alias("check"), F.lit("table").alias("subject"), F.col("duplicate_pct").alias("value"),
                 band(F.col("duplicate_pct"), 0, 10).alias("status")),
    ]
    health = cardinality_health(df).agg(F.avg("score").alias("value"))
    parts.append(
        health.select(F.lit("cardinality").alias("check"), F.lit("table").alias("subject"), "value",
                      F.when(F.col("value") >= 80, "ok").when(F.col("value") >= 60, "warn").otherwise("bad").alias("status"))
    )
    if target:
        parts.append(
            imbalance(df, target).select(F.lit("imbalance").alias("check"), F.lit(target).alias("subject"),
                                         F.col("ratio").alias("value"), F.col("band").alias("status"))
        )
    numbers = numeric_columns(df)
    if len(numbers) > 1:
        parts.append(
            variance_inflation(df, numbers).select(F.lit("vif").alias("check"), F.col("feature").alias("subject"),
                                                   F.col("vif").alias("value"), F.lower("status").alias("status"))
        )
        parts.append(
            correlated_pairs(df, numbers).select(F.lit("correlation").alias("check"), F.concat_ws("~", "a", "b").alias("subject"),
                                                 F.col("r").alias("value"), F.lit("high").alias("status"))
        )
    return reduce(DataFrame.unionByName, parts)
