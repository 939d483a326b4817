"""Queries over windows, order, samples, splits, chart data, sources and lineage."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators import charts, ordering, sampling
from millrace.plans.catalog import query, r, union_all
from millrace.plans.queries_basic import NUMBERS
from millrace.session import checkpoint_folder
from millrace.sources import readers, sinks

# --- windows ----------------------------------------------------------------------------------

#: events whose error rows carry no value
GAPS = "(SELECT event_id, ts, user_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"


def gaps(t):
    kept = F.when(F.col("event_type") != "error", F.col("value"))
    return t.events.select("event_id", "ts", "user_id", kept.alias("value"))


@query(
    "w1_moving_average",
    f"""SELECT event_id, user_id, value, ts, {r('CASE WHEN count(value) OVER w7 = 7 THEN avg(value) OVER w7 END')} AS value_ma7,
 {r('CASE WHEN count(value) OVER w30 = 30 THEN avg(value) OVER w30 END')} AS value_ma30 FROM {GAPS}
 WINDOW w7 AS (ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
)
def _(t):
    return ordering.moving_average(gaps(t), "value", ["ts", "event_id"])


for _id, _fn, _sql in (
    ("w2_forward_fill", ordering.forward_fill, "last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    ("w3_backward_fill", ordering.backward_fill, "first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
):

    @query(_id, f"SELECT event_id, user_id, ts, {r(_sql)} AS value FROM {GAPS}")
    def _(t, fn=_fn):
        return fn(gaps(t), ["value"], ["ts", "event_id"], ["user_id"])

    @query(f"{_id}_whole_table", f"SELECT event_id, user_id, ts, {r(_sql.replace('PARTITION BY user_id ', ''))} AS value FROM {GAPS}")
    def _(t, fn=_fn):
        return fn(gaps(t), ["value"], ["ts", "event_id"])


_PREV = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_NEXT = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(
    "w4_interpolate",
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {GAPS}),
 n AS (SELECT *, last_value(value IGNORE NULLS) {_PREV} AS pv, max(CASE WHEN value IS NOT NULL THEN rn END) {_PREV} AS pp,
 first_value(value IGNORE NULLS) {_NEXT} AS nv, min(CASE WHEN value IS NOT NULL THEN rn END) {_NEXT} AS np FROM p)
 SELECT event_id, user_id, ts, {r('CASE WHEN value IS NOT NULL THEN value WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (rn - pp) / CAST(np - pp AS DOUBLE) END')} AS value FROM n""",
)
def _(t):
    return ordering.interpolate(gaps(t), ["value"], ["ts", "event_id"], ["user_id"])


@query(
    "w5_cumulative_share",
    f"""WITH s AS (SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
 c AS (SELECT nation, n, row_number() OVER w AS rank, sum(n) OVER w / (SELECT CAST(sum(n) AS DOUBLE) FROM s) AS share FROM s WINDOW w AS (ORDER BY n DESC, nation ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT nation, rank, {r('share')} AS share, rank <= (SELECT min(rank) FROM c WHERE share >= 0.95) AS needed FROM c""",
)
def _(t):
    from millrace.models.interpret import cumulative_importance

    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    sizes = joined.groupBy(F.col("n_name").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("importance"))
    out = cumulative_importance(sizes, 0.95)
    return out.select(F.col("feature").alias("nation"), "rank", F.col("cumulative").alias("share"), "needed")


@query(
    "w6_running_total",
    """SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS running_total FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)""",
)
def _(t):
    days = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return ordering.running_sum(days, "n", ["day"], "running_total")


@query(
    "w7_percent_of_total",
    f"""SELECT o_orderpriority, n AS value, {r('n / CAST(sum(n) OVER () AS DOUBLE)')} AS share FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""",
)
def _(t):
    return charts.pie(t.orders, "o_orderpriority")


@query("w8_ordinal_codes", "SELECT p_brand AS value, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_brand FROM part)")
def _(t):
    from millrace.operators.encoding import codes

    return codes(t.part, "p_brand")


@query("w8_row_positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders")
def _(t):
    return ordering.with_position(t.orders, ["o_orderdate", "o_orderkey"], rows_per_chunk=2_000).select("o_orderkey", "position")


# --- order, limit, sample ---------------------------------------------------------------------


@query("o1_sort", "SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def _(t):
    return sampling.sort_by(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", False, ["c_custkey"])


@query(
    "o2_top_groups",
    "SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def _(t):
    line = t.lineitem.withColumn("l_quantity", F.col("l_quantity").cast("bigint"))
    return sampling.top_groups(line, "l_suppkey", "l_quantity", 10)


@query(
    "o2_rows_of_top_groups",
    "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)",
)
def _(t):
    return charts.limit_data(t.lineitem, "l_suppkey", None, 10).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("o3_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def _(t):
    return sampling.first_rows(t.orders, 100, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("o4_sample_rows")
def _(t):
    return sampling.sample_rows(t.orders, 1000, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("o4_sample_size", "SELECT least(1000, count(*)) AS n, least(1000, count(DISTINCT o_orderkey)) AS kinds FROM orders")
def _(t):
    some = sampling.sample_rows(t.orders, 1000, ["o_orderkey"])
    return some.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("kinds"))


@query(
    "o5_stratified_split",
    """SELECT o_orderpriority, CAST(round(count(*) * 0.2) AS BIGINT) AS test, CAST(count(*) - round(count(*) * 0.2) AS BIGINT) AS train FROM orders GROUP BY 1""",
)
def _(t):
    train, test = sampling.stratified_split(t.orders, "o_orderpriority", 0.2, ["o_orderkey"])
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("o_orderpriority").agg(
        F.count_if(F.col("part") == "test").alias("test"), F.count_if(F.col("part") == "train").alias("train")
    )


@query("o5_split_is_whole", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS kinds FROM orders")
def _(t):
    train, test = sampling.split(t.orders, 0.2, ["o_orderkey"])
    return train.unionByName(test).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("kinds"))


@query("o6_folds")
def _(t):
    return sampling.with_folds(t.orders, 5, ["o_orderkey"]).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))


# --- chart data -------------------------------------------------------------------------------


@query("h1_bar", f"SELECT p_brand, {r('avg(p_retailprice)', 4)} AS value FROM part GROUP BY 1")
def _(t):
    return charts.bar(t.part, "p_brand", "p_retailprice", "mean")


@query("h2_grouped_bar", "SELECT p_brand, p_type, count(*) AS value FROM part GROUP BY 1, 2")
def _(t):
    return charts.grouped_bar(t.part, "p_brand", "p_type")


@query("h3_lollipop", "SELECT l_linenumber, sum(l_quantity) AS value FROM lineitem GROUP BY 1 ORDER BY 2 DESC")
def _(t):
    return charts.lollipop(t.lineitem, "l_linenumber", "l_quantity")


@query(
    "h4_pie",
    f"SELECT p_type, value, {r('value / sum(value) OVER ()')} AS share FROM (SELECT p_type, CAST(sum(p_size) AS BIGINT) AS value FROM part GROUP BY 1)",
)
def _(t):
    return charts.pie(t.part, "p_type", "p_size")


@query(
    "h5_histogram",
    f"""WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem)
 SELECT bin, count(*) AS "count", {r('any_value(lo) + bin * any_value(w)', 4)} AS low, {r('any_value(lo) + (bin + 1) * any_value(w)', 4)} AS high
 FROM (SELECT CAST(least(floor((l_extendedprice - lo) / w), 29) AS INTEGER) AS bin, lo, w FROM lineitem, b) GROUP BY bin""",
)
def _(t):
    return charts.histogram(t.lineitem, "l_extendedprice", 30)


@query(
    "h5_histogram_by_color",
    """WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS w FROM events)
 SELECT event_type, bin, count(*) AS "count" FROM (SELECT event_type, CAST(least(floor((value - lo) / w), 9) AS INTEGER) AS bin FROM events, b) GROUP BY ALL""",
)
def _(t):
    return charts.histogram(t.events, "value", 10, "event_type").drop("low", "high")


@query("h6_line", "SELECT ts, value, event_type FROM events ORDER BY 1")
def _(t):
    return charts.line(t.events, "ts", "value", "event_type")


@query("h6_line_buckets", f"SELECT date_trunc('day', ts) AS ts, {r('avg(value)')} AS mean, count(*) AS points FROM events GROUP BY 1")
def _(t):
    out = charts.line_buckets(t.events, "ts", "value")
    return out


@query("h7_scatter", "SELECT p_size, p_retailprice, p_brand FROM part")
def _(t):
    return charts.scatter(t.part, ["p_size", "p_retailprice", "p_brand"])


@query("h7_scatter_sample")
def _(t):
    return charts.scatter(t.lineitem, ["l_quantity", "l_extendedprice"], 1000, ["l_orderkey", "l_linenumber"])


@query(
    "h8_box",
    f"""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
 SELECT l.l_returnflag, {r('any_value(q1)', 4)} AS q1, {r('any_value(median)', 4)} AS median, {r('any_value(q3)', 4)} AS q3,
 {r('min(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 4)} AS whisker_low,
 {r('max(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 4)} AS whisker_high,
 count(*) FILTER (l_extendedprice NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
 FROM lineitem l JOIN q ON l.l_returnflag = q.l_returnflag GROUP BY 1""",
)
def _(t):
    return charts.box(t.lineitem, "l_extendedprice", "l_returnflag")


@query(
    "h9_heatmap",
    f"""SELECT p_brand, {', '.join(r(f"avg(p_size) FILTER (p_type = '{v}')") + f' AS "{v}"' for v in ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'))} FROM part GROUP BY 1""",
)
def _(t):
    return charts.heatmap(t.part, "p_type", "p_brand", "p_size")


@query(
    "h9_correlation_heatmap",
    union_all(f"SELECT '{a}' AS a, '{b}' AS b, {r('1.0' if a == b else f'corr({a}, {b})')} AS r FROM {'lineitem' if a != b else '(SELECT 1)'}" for a in NUMBERS for b in NUMBERS),
)
def _(t):
    return charts.heatmap(t.lineitem.select(*NUMBERS))


@query(
    "h10_density",
    f"""WITH b AS (SELECT min(l_quantity) AS x0, (max(l_quantity) - min(l_quantity)) / 20 AS xw, min(l_extendedprice) AS y0, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS yw FROM lineitem)
 SELECT x_bin, y_bin, count(*) AS "count", {r('avg(l_discount)')} AS mean FROM (SELECT CAST(least(floor((l_quantity - x0) / xw), 19) AS INTEGER) AS x_bin,
 CAST(least(floor((l_extendedprice - y0) / yw), 19) AS INTEGER) AS y_bin, l_discount FROM lineitem, b) GROUP BY 1, 2""",
)
def _(t):
    return charts.density(t.lineitem, "l_quantity", "l_extendedprice", 20, "l_discount")


@query("h11_parallel_coordinates")
def _(t):
    return charts.parallel_coordinates(t.lineitem, NUMBERS, ["l_orderkey", "l_linenumber"])


@query(
    "h12_radar",
    f"SELECT *, {r('max(greatest(p_size, p_retailprice)) OVER ()', 4)} AS axis_max FROM (SELECT p_type, {r('avg(p_size)', 4)} AS p_size, {r('avg(p_retailprice)', 4)} AS p_retailprice FROM part GROUP BY 1 ORDER BY 1 LIMIT 5)",
)
def _(t):
    return charts.radar(t.part, ["p_size", "p_retailprice"], "p_type")


@query("h13_treemap", "SELECT p_type, CAST(sum(p_size) AS BIGINT) AS value FROM part GROUP BY 1")
def _(t):
    return charts.treemap(t.part, "p_type", "p_size")


@query(
    "h14_sankey",
    """WITH f AS (SELECT n_name AS source, c_mktsegment AS target, count(*) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
 n AS (SELECT node, CAST(row_number() OVER (ORDER BY node) - 1 AS INTEGER) AS id FROM (SELECT source AS node FROM f UNION SELECT target FROM f))
 SELECT source, target, value, a.id AS source_id, b.id AS target_id FROM f JOIN n a ON a.node = source JOIN n b ON b.node = target""",
)
def _(t):
    flows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return charts.sankey(flows, "n_name", "c_mktsegment")


@query(
    "h15_word_frequencies",
    r"""SELECT word, count(*) AS "count" FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200""",
)
def _(t):
    return charts.word_frequencies(t.documents, "text", 200)


@query(
    "h16_funnel",
    f"""SELECT event_type, value, {r('value * 100.0 / max(value) OVER ()')} AS percent_initial,
 {r('coalesce(value * 100.0 / lag(value) OVER (ORDER BY value DESC, event_type), 100)')} AS percent_previous FROM (SELECT event_type, count(*) AS value FROM events GROUP BY 1)""",
)
def _(t):
    return charts.funnel(t.events, "event_type")


@query(
    "h16_waterfall",
    "SELECT p_brand, value, CAST(sum(value) OVER (ORDER BY p_brand) AS BIGINT) AS running_total FROM (SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS value FROM part GROUP BY 1)",
)
def _(t):
    return charts.waterfall(t.part, "p_brand", "p_size")


_OHLC = """SELECT date_trunc('day', ts) AS bucket, arg_min(value, ts) AS "open", max(value) AS high, min(value) AS low, arg_max(value, ts) AS "close" FROM events GROUP BY 1"""


@query("h17_candlestick_from_ticks", _OHLC)
def _(t):
    return charts.candlestick_from_ticks(t.events, "ts", "value", ["ts", "event_id"])


@query("h17_candlestick", _OHLC)
def _(t):
    days = charts.candlestick_from_ticks(t.events, "ts", "value", ["ts", "event_id"])
    return charts.candlestick(days, "bucket", "open", "high", "low", "close")


@query("h18_gauge", f"SELECT 'c_acctbal' AS kpi, {r('avg(c_acctbal)', 4)} AS mean, {r('max(c_acctbal)', 4)} AS \"max\" FROM customer")
def _(t):
    return charts.gauge(t.customer, "c_acctbal")


@query(
    "h19_distribution_matrix",
    """WITH b AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 30 AS w FROM lineitem)
 SELECT bin, count(*) AS "count" FROM (SELECT CAST(least(floor((l_quantity - lo) / w), 29) AS INTEGER) AS bin FROM lineitem, b) GROUP BY 1""",
)
def _(t):
    cells = charts.distribution_matrix(t.lineitem, ["l_quantity", "l_extendedprice"], ["l_orderkey", "l_linenumber"])
    return cells["l_quantity", "l_quantity"].select("bin", "count")


@query("h20_auto_dashboard", "SELECT p_name, count(*) AS \"count\" FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return charts.auto_dashboard(t.part, ["p_partkey"])["top_values"]


@query("h21_template_dashboard", "SELECT event_type, {} AS value FROM events GROUP BY 1".format(r("avg(event_id)")))
def _(t):
    return charts.template_dashboard(t.events, "Sales Analytics", ["event_id"])["bar"]


@query(
    "h22_filtered_dashboard",
    f"SELECT 'p_retailprice' AS kpi, {r('avg(p_retailprice)', 4)} AS mean, {r('max(p_retailprice)', 4)} AS \"max\" FROM part WHERE p_type IN ('PROMO', 'SMALL') AND contains(lower(p_name), 'red')",
)
def _(t):
    filters = [("values", "p_type", ["PROMO", "SMALL"]), ("text", "p_name", "red")]
    return charts.filtered_dashboard(t.part, filters, ["p_retailprice"], [dict(chart="bar", x="p_brand")])["kpi"]


@query(
    "h23_trend_line",
    f"""SELECT {r('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {r('regr_intercept(l_extendedprice, l_quantity)', 4)} AS intercept,
 {r('regr_r2(l_extendedprice, l_quantity)', 4)} AS r2, count(*) AS points FROM lineitem""",
)
def _(t):
    return charts.trend_line(t.lineitem, "l_quantity", "l_extendedprice")


@query(
    "h24_missing_map",
    """SELECT (nullif(l_discount, 0) IS NULL)::INT::VARCHAR || (nullif(l_tax, 0) IS NULL)::INT::VARCHAR AS pattern, count(*) AS "count" FROM lineitem GROUP BY 1""",
)
def _(t):
    from millrace.plans.queries_basic import gappy

    return charts.missing_map(gappy(t).select("l_discount", "l_tax"))


@query(
    "h25_time_series",
    f"""SELECT day, n, {r('CASE WHEN count(n) OVER w7 = 7 THEN avg(n) OVER w7 END')} AS n_ma7, {r('CASE WHEN count(n) OVER w30 = 30 THEN avg(n) OVER w30 END')} AS n_ma30
 FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
 WINDOW w7 AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
)
def _(t):
    days = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return charts.time_series(days, "day", "n", ["day"])


# --- sources and sinks ------------------------------------------------------------------------


@query("s2_parquet", "SELECT s_suppkey, s_name FROM supplier")
def _(t):
    return readers.read_any(t.spark, f"{t.folder}/supplier.parquet").select("s_suppkey", "s_name")


@query("s5_many_files", "SELECT 'nation' AS dataset, true AS success, CAST(3 AS INTEGER) AS columns UNION ALL SELECT 'region', true, 2 UNION ALL SELECT 'absent', false, NULL")
def _(t):
    paths = [f"{t.folder}/{n}.parquet" for n in ("nation", "region", "absent")]
    return readers.load_files(t.spark, paths)[1].select("dataset", "success", "columns")


@query(
    "s7_documents",
    "SELECT CAST(doc_id AS VARCHAR) AS _id, lang, source FROM documents WHERE lang = 'en' AND source = 'src1'",
)
def _(t):
    source = t.documents.select(F.col("doc_id").alias("_id"), "lang", "source")
    return readers.documents(source, json.dumps({"lang": "en", "source": "src1"}))


@query("s8_payloads", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def _(t):
    wrapped = t.events.select(F.concat(F.lit('{"data": {"items": ['), "props", F.lit("]}}")).alias("payload"))
    rows = readers.explode_payloads(wrapped, "payload", "data.items", "k bigint")
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k4_registry",
    """SELECT 'nation' AS dataset, count(*) AS rows, CAST(3 AS INTEGER) AS columns, CAST(sum(8 + strlen(n_name)) AS BIGINT) AS bytes FROM nation
 UNION ALL SELECT 'region', count(*), 2, CAST(sum(4 + strlen(r_name)) AS BIGINT) FROM region""",
)
def _(t):
    registry = sinks.Registry(t.spark)
    for name in ("nation", "region"):
        registry.tables[name] = getattr(t, name)
    return registry.info()


def event_log(t):
    """The events table read as a lineage table."""
    status = F.when(F.col("event_type") == "error", "error").otherwise("success")
    params = F.create_map(F.lit("value"), F.col("value").cast("string"))
    return t.events.select(
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("operation"),
        F.col("user_id").cast("string").alias("description"),
        params.alias("parameters"),
        status.alias("status"),
    )


@query(
    "k7_filter_history",
    "SELECT ts AS timestamp, event_type AS operation FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'",
)
def _(t):
    kept = sinks.filter_history(event_log(t), "error", "error", datetime(2024, 1, 10), datetime(2024, 1, 20))
    return kept.select("timestamp", "operation")


@query(
    "k8_history_summary",
    f"""SELECT count(*) AS total_steps, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed,
 count(DISTINCT event_type) AS operations, min(ts) AS "start", max(ts) AS "end", {r('(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6', 4)} AS duration_seconds FROM events""",
)
def _(t):
    return sinks.summarise_history(event_log(t))


@query("k8_operation_frequency", "SELECT event_type AS operation, count(*) AS \"count\" FROM events GROUP BY 1")
def _(t):
    return sinks.operation_frequency(event_log(t))


@query("k8_recent_steps", "SELECT ts AS timestamp, event_type AS operation FROM events ORDER BY ts DESC LIMIT 20")
def _(t):
    return sinks.recent_steps(event_log(t), 20).select("timestamp", "operation")


@query("k10_fitted_parameters", f"SELECT 'l_quantity' AS \"column\", 'standard' AS type, {r('avg(l_quantity)')} AS shift, {r('stddev_pop(l_quantity)')} AS scale FROM lineitem")
def _(t):
    from millrace.operators import scaling

    records = sinks.transformer_params(scaling.fit(t.lineitem, ["l_quantity"], "standard"))
    rows = [(x["column"], x["type"], x["params"]["shift"], x["params"]["scale"]) for x in records]
    return t.spark.createDataFrame(rows, "column string, type string, shift double, scale double")


# --- round trips: a given table is written, read again and compared with itself -----------------


def scratch(t) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_folder(t.spark)}/trip-{uuid.uuid4().hex}"


CUSTOMERS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def customers(df):
    return df.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"), F.col("c_acctbal").cast("double"), "c_mktsegment")


@query("s1_csv", f"SELECT {CUSTOMERS} FROM customer")
def _(t):
    path = scratch(t)
    t.customer.write.options(header=True, sep=";", encoding="iso-8859-1").csv(path)
    return customers(readers.read_csv(t.spark, path, sep=";", encoding="latin-1"))


@query("s1_csv_below_a_head", "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority || chr(10) || '\"a, b\"' AS o_note FROM orders")
def _(t):
    """Two lines above the header of every file, separators, quotes and line breaks in values."""
    path = scratch(t)
    note = F.concat("o_orderpriority", F.lit('\n""a, b""'))
    line = F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date"), F.concat(F.lit('"'), note, F.lit('"')))
    head = "report\n2 lines, not data\no_orderkey,o_orderstatus,o_totalprice,o_orderdate,o_note\n"
    files = t.orders.groupBy(F.floor(F.col("o_orderkey") / 20_000).alias("file")).agg(F.concat(F.lit(head), F.concat_ws("\n", F.collect_list(line))).alias("value"))
    files.repartition("file").select("value").write.option("maxRecordsPerFile", 1).text(path)
    back = readers.read_csv(t.spark, path, skip_rows=2, multi_line=True)
    return back.select(F.col("o_orderkey").cast("bigint"), "o_orderstatus", F.col("o_totalprice").cast("double"), "o_orderdate", "o_note")


@query("s3_json", f"SELECT {CUSTOMERS} FROM customer")
def _(t):
    return customers(readers.read_json(t.spark, sinks.export(t.customer, scratch(t), "customer", "json"), lines=True))


FILES_PER_FOLDER = 1_000


@query("s4_text", "SELECT s_name AS text, count(*) AS n FROM supplier GROUP BY 1")
def _(t):
    """One text a file. Each task writes a folder of its own, which is moved as one; no folder holds all files."""
    path = scratch(t)
    names = t.supplier.select("s_name")
    parts = max(t.spark.sparkContext.defaultParallelism, -(-names.count() // FILES_PER_FOLDER))
    dealt = names.repartition(parts).withColumn("part", F.spark_partition_id())
    dealt.write.option("maxRecordsPerFile", 1).partitionBy("part").text(path)
    texts = readers.read_text(t.spark, f"{path}/part=*")
    return texts.select(F.trim(F.regexp_replace("text", "\n", "")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("k1_export", f"SELECT {CUSTOMERS}, f AS format FROM customer, (SELECT unnest(['csv', 'json', 'parquet']) AS f)")
def _(t):
    folder = scratch(t)
    parts = []
    for fmt in ("csv", "json", "parquet"):
        path = sinks.export(t.customer, folder, "customer", fmt)
        parts.append(customers(readers.read_any(t.spark, path) if fmt != "json" else readers.read_json(t.spark, path, lines=True)).withColumn("format", F.lit(fmt)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("k2_export_for_bi", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate FROM orders")
def _(t):
    path = sinks.export_powerbi(t.orders.select("o_orderkey", "o_orderdate"), scratch(t), "orders")
    return t.spark.read.schema("o_orderkey bigint, o_orderdate string").csv(path, header=True)


@query("k5_registry_round_trip", f"SELECT {CUSTOMERS} FROM customer")
def _(t):
    folder = scratch(t)
    registry = sinks.Registry(t.spark)
    registry.add("customer", t.customer)
    registry.save(folder)
    return customers(sinks.Registry.load(t.spark, folder)[0].get("customer"))
