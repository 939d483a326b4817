"""Chart data: the aggregated table behind each chart. Rows with a null x (or y) do not count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col, numeric_columns, text_columns
from millrace.operators.aggregate import (
    correlations,
    group_aggregate,
    group_means,
    kpi,
    pivot,
    value_counts,
)
from millrace.operators.joins import keep_top_keys, small_side
from millrace.operators.ordering import moving_average, running_sum, with_position
from millrace.operators.project import keep_range, keep_values, search_text
from millrace.operators.sampling import sample_rows
from millrace.operators.stats import grouped_quantiles, moments
from millrace.session import cut_lineage


def bar(df: DataFrame, x: str, y: str | None = None, how: str = "count") -> DataFrame:
    """Aggregate of y per x, or value counts."""
    if y is None or how == "count":
        return group_aggregate(df, [x], y, "count")
    return group_aggregate(df.dropna(subset=[y]), [x], y, how)


def grouped_bar(df: DataFrame, x: str, color: str, y: str | None = None, how: str = "count") -> DataFrame:
    return group_aggregate(df, [x, color], y, how)


def lollipop(df: DataFrame, x: str, y: str) -> DataFrame:
    return group_aggregate(df, [x], y, "sum").orderBy(F.desc("value"), x)


def pie(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """Sum of y (or rows) per x, and its share of the total."""
    parts = group_aggregate(df, [x], y, "sum" if y else "count")
    total = parts.agg(F.sum("value").alias("t")).first()["t"]
    return parts.withColumn("share", F.try_divide(F.col("value").cast("double"), F.lit(float(total or 0))))


def histogram(df: DataFrame, column: str, bins: int = 30, color: str | None = None) -> DataFrame:
    """Equal-width bins over the value range, empty bins left out; the last bin is closed."""
    m = moments(df, [column], ["min", "max"])[column]
    known = df.where(col(column).isNotNull())
    low = float(m["min"]) if m["min"] is not None else 0.0
    width = (float(m["max"] or 0.0) - low) / bins or 1.0
    at = F.least(F.floor((col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    keys = [at.alias("bin")] + ([col(color)] if color else [])
    out = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return out.withColumns({"low": F.lit(low) + F.col("bin") * width, "high": F.lit(low) + (F.col("bin") + 1) * width})


def line(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """The points in x order."""
    names = [x, y] + ([color] if color else [])
    return df.dropna(subset=[x, y]).select(*[col(n) for n in names]).orderBy(*[col(n) for n in names])


def line_buckets(df: DataFrame, x: str, y: str, unit: str = "day") -> DataFrame:
    """Mean of y per time bucket, for more points than a line can show."""
    points = df.dropna(subset=[x, y])
    return points.groupBy(F.date_trunc(unit, col(x)).cast("timestamp_ntz").alias(x)).agg(
        F.avg(col(y)).alias("mean"), F.count(F.lit(1)).alias("points")
    )


def scatter(df: DataFrame, columns: Sequence[str], limit: int | None = None, key: Sequence[str] = ()) -> DataFrame:
    """The points of two or three columns (and a size); with ``limit``, a repeatable sample of them."""
    points = df.dropna(subset=list(columns))
    if limit is not None:
        points = sample_rows(points, limit, key)
    return points.select(*[col(c) for c in dict.fromkeys([*key, *columns])])


def box(df: DataFrame, y: str, color: str | None = None) -> DataFrame:
    """Quartiles, whiskers (last values inside 1.5 IQR) and the number of outliers, per group."""
    key = color or "__all"
    data = df.where(col(y).isNotNull())
    data = data.where(col(color).isNotNull()) if color else data.withColumn(key, F.lit("all"))
    quartiles = grouped_quantiles(data, [key], y, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    both = data.select(col(key), col(y).cast("double").alias("__y")).join(small_side(quartiles), key)
    span = 1.5 * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - span, F.col("q3") + span
    inside = F.when(F.col("__y").between(low, high), F.col("__y"))
    out = both.groupBy(key, "q1", "median", "q3").agg(
        F.min(inside).alias("whisker_low"),
        F.max(inside).alias("whisker_high"),
        F.count_if(inside.isNull()).alias("outliers"),
    )
    return out if color else out.withColumnRenamed(key, "group")


def heatmap(df: DataFrame, x: str | None = None, y: str | None = None, z: str | None = None, how: str = "mean"):
    """Pivot of z over (y, x), or the correlation matrix."""
    if x and y and z:
        return pivot(df, y, x, z, how)
    return correlations(df)


def density(df: DataFrame, x: str, y: str, bins: int = 20, z: str | None = None) -> DataFrame:
    """Counts (and mean of z) on a two-dimensional grid of equal-width cells."""
    m = moments(df, [x, y], ["min", "max"])
    known = df.dropna(subset=[x, y])

    def cell(c):
        low = float(m[c]["min"] or 0)
        width = (float(m[c]["max"] or 0) - low) / bins or 1.0
        return F.least(F.floor((col(c) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")

    aggs = [F.count(F.lit(1)).alias("count")] + ([F.avg(col(z)).alias("mean")] if z else [])
    return known.groupBy(cell(x).alias("x_bin"), cell(y).alias("y_bin")).agg(*aggs)


def parallel_coordinates(df: DataFrame, columns: Sequence[str], key: Sequence[str], limit: int = 1000) -> DataFrame:
    return scatter(df, columns, limit, key)


def radar(df: DataFrame, columns: Sequence[str], category: str | None = None) -> DataFrame:
    return group_means(df, columns, category, 5)


def treemap(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    return group_aggregate(df, [x], y, "sum" if y else "count")


def sankey(df: DataFrame, source: str, target: str, value: str | None = None) -> DataFrame:
    """Flows between numbered nodes; nodes are the distinct names of both columns in sorted order.

    The node table is as small as the chart's axes; it numbers by ``with_position`` all the same.
    """
    flows = group_aggregate(df, [source, target], value, "sum" if value else "count")
    flows = flows.select(
        col(source).cast("string").alias("source"), col(target).cast("string").alias("target"), "value"
    )
    names = flows.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    nodes = with_position(names, ["node"], "id")
    nodes = small_side(nodes.select("node", (F.col("id") - 1).cast("int").alias("id")))
    ends = {e: nodes.select(F.col("node").alias(e), F.col("id").alias(f"{e}_id")) for e in ("source", "target")}
    return flows.join(ends["source"], "source").join(ends["target"], "target")


def word_frequencies(df: DataFrame, column: str, top: int = 200) -> DataFrame:
    """Most frequent words (runs of letters or digits, lower case) of whole texts."""
    words = F.explode(F.regexp_extract_all(F.lower(col(column)), F.lit(r"([\p{L}\p{N}]+)")))
    counts = df.select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "word").limit(top)


def funnel(df: DataFrame, stage: str, value: str | None = None) -> DataFrame:
    """Stages by size, with percent of the first and of the previous stage."""
    stages = group_aggregate(df, [stage], value, "sum" if value else "count")
    size = F.col("value").cast("double")
    placed = cut_lineage(with_position(stages.withColumn("__down", F.coalesce(-size, F.lit(float("inf")))), ["__down", stage], "__at"))
    largest = placed.agg(F.max(size)).first()[0]
    before = placed.select((F.col("__at") + 1).alias("__at"), size.alias("__before"))
    out = placed.join(before, "__at", "left").withColumns(
        {"percent_initial": size / F.lit(largest) * 100, "percent_previous": F.coalesce(size / F.col("__before"), F.lit(1.0)) * 100}
    )
    return out.select(*(col(c) for c in stages.columns), "percent_initial", "percent_previous")


def waterfall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Sum of y per x with its running total in x order."""
    return running_sum(group_aggregate(df, [x], y, "sum"), "value", [x], "running_total")


def candlestick(df: DataFrame, x: str, open_: str, high: str, low: str, close: str) -> DataFrame:
    return df.select(*[col(c) for c in (x, open_, high, low, close)]).orderBy(col(x))


def candlestick_from_ticks(df: DataFrame, ts: str, price: str, order_by: Sequence[str], unit: str = "day") -> DataFrame:
    """Open, high, low and close per time bucket; ``min_by``/``max_by`` combine before the shuffle."""
    at = F.struct(*[col(o) for o in order_by])
    return df.groupBy(F.date_trunc(unit, col(ts)).cast("timestamp_ntz").alias("bucket")).agg(
        F.min_by(col(price), at).alias("open"),
        F.max(col(price)).alias("high"),
        F.min(col(price)).alias("low"),
        F.max_by(col(price), at).alias("close"),
    )


def gauge(df: DataFrame, column: str) -> DataFrame:
    return kpi(df, [column])


def distribution_matrix(df: DataFrame, columns: Sequence[str], key: Sequence[str], limit: int = 1000) -> dict:
    """Histograms on the diagonal and pair samples elsewhere, for two to four columns."""
    if not 2 <= len(columns) <= 4:
        raise ValueError("a distribution matrix takes two to four columns")
    out = {}
    for a in columns:
        for b in columns:
            out[a, b] = histogram(df, a) if a == b else scatter(df, [a, b], limit, key)
    return out


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x."""
    known = df.dropna(subset=[x, y])
    return known.agg(
        F.regr_slope(col(y), col(x)).alias("slope"),
        F.regr_intercept(col(y), col(x)).alias("intercept"),
        F.regr_r2(col(y), col(x)).alias("r2"),
        F.count(F.lit(1)).alias("points"),
    )


def missing_map(df: DataFrame) -> DataFrame:
    """Rows per pattern of missing cells (one character per column, 1 = missing)."""
    flags = [F.when(col(c).isNull(), "1").otherwise("0") for c in df.columns]
    return df.groupBy(F.concat(*flags).alias("pattern")).agg(F.count(F.lit(1)).alias("count"))


def time_series(df: DataFrame, date: str, value: str, order_by: Sequence[str], partition_by=(), rows_per_chunk=None):
    """The series in date order with moving averages of 7 and 30 rows."""
    return moving_average(df, value, order_by, (7, 30), partition_by, rows_per_chunk)


def auto_dashboard(df: DataFrame, key: Sequence[str]) -> dict[str, DataFrame]:
    """First numeric histogram, first category top 10, correlations, and a 1000-point scatter."""
    numbers, texts = numeric_columns(df), text_columns(df)
    out = {}
    if numbers:
        out["histogram"] = histogram(df, numbers[0])
    if texts:
        out["top_values"] = value_counts(df, texts[0], 10)
    if len(numbers) >= 2:
        out["correlation"] = correlations(df, numbers)
        out["scatter"] = scatter(df, numbers[:2], 1000, key)
    return out


#: Charts of the dashboard templates.
TEMPLATES = {
    "Sales Analytics": ["bar", "line", "pie", "histogram"],
    "Marketing Performance": ["scatter", "bubble", "heatmap", "funnel"],
    "Financial Overview": ["candlestick", "waterfall", "gauge", "kpi"],
    "Customer Analysis": ["treemap", "sunburst", "sankey", "radar"],
}


def chart_data(df: DataFrame, chart: str, x=None, y=None, color=None, z=None, how="count", key=(), columns=()) -> DataFrame:
    """Dispatch by chart type."""
    makers = {
        "bar": lambda: grouped_bar(df, x, color, y, how) if color else bar(df, x, y, how),
        "column": lambda: bar(df, x, y, how),
        "stacked_bar": lambda: grouped_bar(df, x, color, y, how),
        "grouped_bar": lambda: grouped_bar(df, x, color, y, how),
        "lollipop": lambda: lollipop(df, x, y),
        "pie": lambda: pie(df, x, y),
        "donut": lambda: pie(df, x, y),
        "histogram": lambda: histogram(df, x, 30, color),
        "line": lambda: line(df, x, y, color),
        "area": lambda: line(df, x, y, color),
        "scatter": lambda: scatter(df, [c for c in (x, y, color) if c], None, key),
        "bubble": lambda: scatter(df, [c for c in (x, y, z, color) if c], None, key),
        "scatter_3d": lambda: scatter(df, [x, y, z], None, key),
        "box": lambda: box(df, y or x, color),
        "violin": lambda: box(df, y or x, color),
        "heatmap": lambda: heatmap(df, x, y, z, "mean" if how == "count" else how),
        "contour": lambda: density(df, x, y, 20, z),
        "density": lambda: density(df, x, y, 20, z),
        "parallel_coordinates": lambda: parallel_coordinates(df, columns or [x, y], key),
        "radar": lambda: radar(df, columns or [y], x),
        "treemap": lambda: treemap(df, x, y),
        "sunburst": lambda: treemap(df, x, y),
        "sankey": lambda: sankey(df, x, y, z),
        "word_cloud": lambda: word_frequencies(df, x),
        "funnel": lambda: funnel(df, x, y),
        "waterfall": lambda: waterfall(df, x, y),
        "gauge": lambda: gauge(df, x),
        "kpi": lambda: kpi(df, columns or [x]),
        "candlestick": lambda: candlestick(df, x, *columns),
        "trend": lambda: trend_line(df, x, y),
        "missing": lambda: missing_map(df),
        "time_series": lambda: time_series(df, x, y, [x, *key]),
    }
    if chart not in makers:
        raise ValueError(f"unknown chart type {chart!r}")
    return makers[chart]()


def template_dashboard(df: DataFrame, template: str, key: Sequence[str]) -> dict[str, DataFrame]:
    """Charts of a template with columns chosen by type; charts the table has no columns for are left out."""
    from millrace.functions.semantics import temporal_columns

    numbers, texts, times = numeric_columns(df), text_columns(df), temporal_columns(df)
    n1, n2 = (numbers + [None, None])[:2]
    t1, t2 = (texts + [None, None])[:2]
    day = times[0] if times else None
    picks = {
        "bar": dict(x=t1, y=n1, how="mean"),
        "line": dict(x=day, y=n1),
        "pie": dict(x=t1),
        "histogram": dict(x=n1),
        "scatter": dict(x=n1, y=n2),
        "bubble": dict(x=n1, y=n2, z=numbers[2] if len(numbers) > 2 else None),
        "heatmap": dict(),
        "funnel": dict(x=t1),
        "candlestick": dict(x=day, columns=numbers[:4] if len(numbers) >= 4 else None),
        "waterfall": dict(x=t1, y=n1),
        "gauge": dict(x=n1),
        "kpi": dict(columns=numbers or None),
        "treemap": dict(x=t1, y=n1),
        "sunburst": dict(x=t1, y=n1),
        "sankey": dict(x=t1, y=t2),
        "radar": dict(x=t1, columns=numbers or None),
    }
    out = {}
    for chart in TEMPLATES[template]:
        args = picks[chart]
        if all(v is not None for v in args.values()):
            out[chart] = chart_data(df, chart, key=key, **args)
    return out


def apply_filters(df: DataFrame, filters: Sequence[tuple]) -> DataFrame:
    """Filters as ``(kind, column, argument)``: values, text or range."""
    out = df
    for kind, column, argument in filters:
        if kind == "values":
            out = keep_values(out, column, argument)
        elif kind == "text":
            out = search_text(out, column, argument)
        elif kind == "range":
            out = keep_range(out, column, *argument)
        else:
            raise ValueError(f"unknown filter {kind!r}")
    return out


def filtered_dashboard(df: DataFrame, filters: Sequence[tuple], kpis: Sequence[str], charts: Sequence[dict]) -> dict:
    """KPI means and charts of the rows that pass the filters."""
    kept = apply_filters(df, filters)
    out = {"kpi": kpi(kept, kpis)}
    for spec in charts:
        out[spec["chart"]] = chart_data(kept, **spec)
    return out


def limit_data(df: DataFrame, key: str, value: str | None, n: int) -> DataFrame:
    """Rows of the ``n`` largest keys, for charts that cannot show more."""
    return keep_top_keys(df, key, value, n)
