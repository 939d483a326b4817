"""Queries over types, missing values, outliers, scaling, encoding and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import semantics as sem
from millrace.operators import convert, encoding, missing, neighbours, outliers, scaling
from millrace.plans.catalog import query, r, union_all
from millrace.plans.queries_basic import GAPPY, NUMBERS, gappy

KEY = ["l_orderkey", "l_linenumber"]
K = "l_orderkey, l_linenumber"

# --- scalar functions -------------------------------------------------------------------------


@query("t1_trim", "SELECT c_custkey, trim('  ' || c_mktsegment || ' ') AS segment FROM customer")
def _(t):
    padded = F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))
    return t.customer.select("c_custkey", sem.strip(padded).alias("segment"))


@query("t2_collapse_blanks", r"SELECT p_partkey, regexp_replace(replace(p_name, ' ', '   '), '\s+', ' ', 'g') AS name FROM part")
def _(t):
    wide = F.regexp_replace("p_name", " ", "   ")
    return t.part.select("p_partkey", sem.collapse_blanks(wide).alias("name"))


@query(
    "t3_title_case",
    """SELECT p_partkey, list_aggregate(list_transform(regexp_extract_all(lower(p_name || '''s ' || p_brand || 'x'), '([a-z]+|[^a-z]+)'),
 lambda w: upper(w[1]) || w[2:]), 'string_agg', '') AS name FROM part""",
)
def _(t):
    return t.part.select("p_partkey", sem.title_case(F.concat("p_name", F.lit("'s "), "p_brand", F.lit("x"))).alias("name"))


@query(
    "t4_boolean_words",
    "SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS flag FROM events",
)
def _(t):
    word = F.when(F.col("event_type") == "click", " Yes").when(F.col("event_type") == "view", "FALSE").otherwise(F.col("event_type"))
    return t.events.select("event_id", sem.to_flag(word).alias("flag"))


@query("t5_concat", "SELECT c_custkey, c_name || ' ' || c_mktsegment AS label FROM customer")
def _(t):
    from millrace.operators.project import joined_text

    return joined_text(t.customer, ["c_name", "c_mktsegment"], "label").select("c_custkey", "label")


@query("t6_year", "SELECT event_id, CAST(year(ts) AS INTEGER) AS y FROM events")
def _(t):
    return t.events.select("event_id", F.year(sem.to_moment(F.col("ts").cast("string"))).alias("y"))


@query("t7_date_pattern", r"SELECT doc_id, regexp_matches(text, '^\d{4}-\d{2}-\d{2}') AS dated FROM documents")
def _(t):
    return t.documents.select("doc_id", F.col("text").rlike(sem.ISO_DATE_PREFIX).alias("dated"))


@query("t8_absolute", "SELECT c_custkey, round(abs(c_acctbal), 4) AS balance FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.abs("c_acctbal").alias("balance"))


@query(
    "t9_clip",
    f"SELECT {K}, CASE WHEN l_quantity < 10 THEN 10.0 WHEN l_quantity > 40 THEN 40.0 ELSE l_quantity END AS q FROM {GAPPY}",
)
def _(t):
    return gappy(t).select(*KEY, sem.clip(F.col("l_quantity"), 10.0, 40.0).alias("q"))


@query(
    "t10_log_transform",
    f"""SELECT c_custkey, {r('ln(1 + c_acctbal - (SELECT min(c_acctbal) FROM customer) + 1)')} AS c_acctbal,
 {r('CASE WHEN (SELECT min(c_nationkey) FROM customer) <= 0 THEN ln(1 + c_nationkey - (SELECT min(c_nationkey) FROM customer) + 1) ELSE ln(1 + c_nationkey) END')} AS c_nationkey
 FROM customer""",
)
def _(t):
    return outliers.log_transform(t.customer, ["c_acctbal", "c_nationkey"]).select("c_custkey", "c_acctbal", "c_nationkey")


@query(
    "t11_null_predicates",
    f"SELECT {K}, l_discount IS NULL AS missing, l_discount IS NOT NULL AS present FROM {GAPPY}",
)
def _(t):
    x = F.col("l_discount")
    return gappy(t).select(*KEY, x.isNull().alias("missing"), x.isNotNull().alias("present"))


# --- conversion -------------------------------------------------------------------------------

#: parts with a size written as text, some of it unreadable
CODED = "(SELECT p_partkey, CASE WHEN p_size > 48 THEN 'n/a' WHEN p_size > 46 THEN NULL ELSE ' ' || p_size END AS size_text, CASE WHEN p_size > 20 THEN '2024-02-' || lpad(CAST(p_size - 20 AS VARCHAR), 2, '0') ELSE p_brand END AS day_text FROM part)"


def coded(t):
    size = F.col("p_size")
    day = F.concat(F.lit("2024-02-"), F.lpad((size - 20).cast("string"), 2, "0"))
    return t.part.select(
        "p_partkey",
        F.when(size > 48, "n/a").when(size > 46, None).otherwise(F.concat(F.lit(" "), size.cast("string"))).alias("size_text"),
        F.when(size > 20, day).otherwise(F.col("p_brand")).alias("day_text"),
    )


@query("c1_cast_int", f"SELECT p_partkey, try_cast(trim(size_text) AS BIGINT) AS size_text FROM {CODED}")
def _(t):
    return convert.convert(coded(t), ["size_text"], "int64").select("p_partkey", "size_text")


@query("c1_cast_datetime", f"SELECT p_partkey, try_cast(day_text AS TIMESTAMP) AS day_text FROM {CODED}")
def _(t):
    return convert.convert(coded(t), ["day_text"], "datetime").select("p_partkey", "day_text")


@query(
    "c2_conversion_preview",
    f"""SELECT 'size_text' AS "column", 'object' AS from_type, 'float64' AS to_type, count(try_cast(trim(size_text) AS DOUBLE)) AS converted,
 count(size_text) - count(try_cast(trim(size_text) AS DOUBLE)) AS failed, {r('count(try_cast(trim(size_text) AS DOUBLE)) * 100.0 / count(*)')} AS success_pct,
 count(size_text) = count(try_cast(trim(size_text) AS DOUBLE)) AS success FROM {CODED}""",
)
def _(t):
    return convert.conversion_report(coded(t), ["size_text"], "float64")


@query(
    "c3_c4_auto_convert",
    f"SELECT p_partkey, try_cast(trim(size_text) AS DOUBLE) AS size_text, try_cast(day_text AS TIMESTAMP) AS day_text FROM {CODED}",
)
def _(t):
    return convert.auto_convert(coded(t), "share")


@query(
    "c5_auto_convert_loss",
    f"SELECT p_partkey, try_cast(trim(size_text) AS DOUBLE) AS size_text, try_cast(day_text AS TIMESTAMP) AS day_text FROM {CODED}",
)
def _(t):
    return convert.auto_convert(coded(t), "loss")


@query("c6_date_columns", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) AS o_orderdate FROM orders")
def _(t):
    text = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    return convert.convert_date_columns(text)


@query(
    "c7_numeric_candidates",
    f"""SELECT 'size_text' AS "column", count(try_cast(trim(size_text) AS DOUBLE)) AS numbers, count(size_text) AS "values",
 count(try_cast(trim(size_text) AS DOUBLE)) > 0 AS candidate FROM {CODED}
 UNION ALL SELECT 'day_text', 0, count(day_text), false FROM {CODED}""",
)
def _(t):
    return convert.numeric_candidates(coded(t))


@query(
    "c8_storage_plan",
    """SELECT "column", type, CASE WHEN lo >= -128 AND hi < 128 THEN 'tinyint' WHEN lo >= -32768 AND hi < 32768 THEN 'smallint'
 WHEN type = 'bigint' AND lo >= -2147483648 AND hi < 2147483648 THEN 'int' ELSE type END AS best, bytes_before FROM (
 SELECT 'l_orderkey' AS "column", 'bigint' AS type, min(l_orderkey) AS lo, max(l_orderkey) AS hi, count(*) * 8 AS bytes_before FROM lineitem
 UNION ALL SELECT 'l_partkey', 'bigint', min(l_partkey), max(l_partkey), count(*) * 8 FROM lineitem
 UNION ALL SELECT 'l_linenumber', 'int', min(l_linenumber), max(l_linenumber), count(*) * 4 FROM lineitem)
 UNION ALL SELECT 'l_returnflag', 'string', 'category', CAST(sum(strlen(l_returnflag)) AS BIGINT) FROM lineitem""",
)
def _(t):
    plan = convert.storage_plan(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"))
    return plan.drop("bytes_after")


@query("c8_shrink", "SELECT CAST(l_linenumber AS BIGINT) AS n, count(*) AS lines FROM lineitem GROUP BY 1")
def _(t):
    small = convert.shrink(t.lineitem.select("l_orderkey", "l_linenumber"))
    return small.groupBy(F.col("l_linenumber").cast("bigint").alias("n")).agg(F.count(F.lit(1)).alias("lines"))


@query(
    "c9_nested_as_text",
    "SELECT vec_id, '{\"label\":' || label || '}' AS tag FROM embeddings",
)
def _(t):
    tagged = t.embeddings.select("vec_id", F.struct("label").alias("tag"))
    return sem.nested_to_text(tagged)


@query("c10_json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# --- missing values ---------------------------------------------------------------------------

_FILL = {"mean": "avg({c})", "median": "median({c})"}
for _how, _expr in _FILL.items():

    @query(
        f"m1_fill_{_how}" if _how == "mean" else f"m2_fill_{_how}",
        f"SELECT {K}, "
        + ", ".join(f"{r(f'coalesce({c}, (SELECT {_expr.format(c=c)} FROM {GAPPY}))')} AS {c}" for c in ("l_quantity", "l_discount"))
        + f" FROM {GAPPY}",
    )
    def _(t, how=_how):
        fit = {"mean": missing.fit_mean, "median": missing.fit_median}[how]
        df = gappy(t).select(*KEY, "l_quantity", "l_discount")
        return missing.fill(df, fit(df, ["l_quantity", "l_discount"]))


def _mode_sql(c, table=GAPPY):
    return f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    "m3_fill_mode",
    f"SELECT {K}, coalesce(l_returnflag, {_mode_sql('l_returnflag')}) AS l_returnflag, coalesce(l_quantity, {_mode_sql('l_quantity')}) AS l_quantity FROM {GAPPY}",
)
def _(t):
    df = gappy(t).select(*KEY, "l_returnflag", "l_quantity")
    return missing.fill(df, missing.fit_mode(df, ["l_returnflag", "l_quantity"]))


@query(
    "m4_fill_constant",
    f"SELECT {K}, coalesce(l_tax, -1.0) AS l_tax, coalesce(l_returnflag, 'none') AS l_returnflag FROM {GAPPY}",
)
def _(t):
    df = missing.fill_constant(gappy(t), ["l_tax"], "-1")
    return missing.fill_constant(df, ["l_returnflag"], "none").select(*KEY, "l_tax", "l_returnflag")


@query(
    "m6_missing_summary",
    "SELECT * FROM ("
    + union_all(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, {r(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct FROM {GAPPY}"
        for c in ("l_quantity", "l_discount", "l_tax", "l_returnflag")
    )
    + ") WHERE missing > 0",
)
def _(t):
    return missing.missing_summary(gappy(t))


@query(
    "m7_smart_fill",
    f"SELECT {K}, "
    + ", ".join(
        f"{r(f'coalesce({c}, (SELECT CASE WHEN abs(skewness({c})) > 1 THEN median({c}) ELSE avg({c}) END FROM {GAPPY}))')} AS {c}"
        for c in ("l_quantity", "l_discount", "l_tax")
    )
    + f", coalesce(l_returnflag, {_mode_sql('l_returnflag')}) AS l_returnflag FROM {GAPPY}",
)
def _(t):
    df = gappy(t).select(*KEY, "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return missing.fill(df, missing.fit_smart(df))


PARTS = "(SELECT p_partkey, p_partkey AS a, CASE WHEN p_size <= 45 THEN p_size END AS b, CASE WHEN p_brand <> 'Brand#2' THEN p_retailprice END AS c FROM part)"


def holey_parts(t):
    return t.part.select(
        "p_partkey",
        F.col("p_partkey").cast("double").alias("a"),
        F.when(F.col("p_size") <= 45, F.col("p_size").cast("double")).alias("b"),
        F.when(F.col("p_brand") != "Brand#2", F.col("p_retailprice")).alias("c"),
    )


def _knn_sql(k=5):
    """Brute force: every part with a gap against all parts that have the value."""
    near = []
    for c in ("b", "c"):
        terms = [f"coalesce((q.{x} - d.{x}) * (q.{x} - d.{x}), 0)" for x in "abc"]
        shared = " + ".join(f"(q.{x} IS NOT NULL AND d.{x} IS NOT NULL)::INT" for x in "abc")
        near.append(
            f"""SELECT q.p_partkey, '{c}' AS slot, avg(v) AS v FROM (SELECT q.p_partkey, d.{c} AS v, row_number() OVER (PARTITION BY q.p_partkey
 ORDER BY sqrt(({' + '.join(terms)}) * (3.0::DOUBLE / ({shared}))), d.{c}) AS rn FROM {PARTS} q, {PARTS} d WHERE q.{c} IS NULL AND d.{c} IS NOT NULL) q WHERE rn <= {k} GROUP BY 1"""
        )
    return f"""WITH n AS ({union_all(near)}) SELECT p_partkey, {r('p.a')} AS a, {r("coalesce(p.b, (SELECT v FROM n WHERE n.p_partkey = p.p_partkey AND slot = 'b'))")} AS b,
 {r("coalesce(p.c, (SELECT v FROM n WHERE n.p_partkey = p.p_partkey AND slot = 'c'))")} AS c FROM {PARTS} p"""


@query("m8_knn_impute", _knn_sql())
def _(t):
    return neighbours.knn_impute(holey_parts(t), ["a", "b", "c"], 5)


@query("m9_iterative_impute")
def _(t):
    from millrace.models.linear import iterative_impute

    return iterative_impute(gappy(t).select(*KEY, *NUMBERS), NUMBERS, max_iter=3)


@query(
    "m10_fill_expression",
    f"SELECT {K}, {r('coalesce(l_quantity, l_extendedprice / 100)')} AS l_quantity FROM {GAPPY}",
)
def _(t):
    return missing.fill_expression(gappy(t), "l_quantity", "l_extendedprice / 100").select(*KEY, "l_quantity")


HALF = """(SELECT p_partkey AS a, CASE WHEN p_size <= 45 THEN p_size END AS b, CASE WHEN p_size > 40 THEN p_size END AS mostly_missing,
 CASE WHEN p_size > 5 THEN p_type END AS kind FROM part)"""


@query(
    "m11_smart_missing",
    f"""WITH h AS (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, kind FROM {HALF}),
 n AS (SELECT a, avg(v) AS v FROM (SELECT q.a, d.b AS v, row_number() OVER (PARTITION BY q.a ORDER BY abs(q.a - d.a), d.b) AS rn
 FROM h q, h d WHERE q.b IS NULL AND d.b IS NOT NULL) WHERE rn <= 5 GROUP BY 1)
 SELECT {r('h.a')} AS a, {r('coalesce(h.b, n.v)')} AS b, coalesce(kind, (SELECT kind FROM h WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS kind
 FROM h LEFT JOIN n ON h.a = n.a""",
)
def _(t):
    half = t.part.select(
        F.col("p_partkey").cast("double").alias("a"),
        F.when(F.col("p_size") <= 45, F.col("p_size").cast("double")).alias("b"),
        F.when(F.col("p_size") > 40, F.col("p_size").cast("double")).alias("mostly_missing"),
        F.when(F.col("p_size") > 5, F.col("p_type")).alias("kind"),
    )
    return missing.smart_missing(half)


@query(
    "m12_model_policy",
    f"SELECT {r('coalesce(l_discount, (SELECT avg(l_discount) FROM ' + GAPPY + '))')} AS l_discount, coalesce(l_returnflag, {_mode_sql('l_returnflag')}) AS l_returnflag, l_linestatus FROM {GAPPY}",
)
def _(t):
    return missing.model_policy(gappy(t).select("l_discount", "l_returnflag", "l_linestatus"), "impute")


@query(
    "m13_median_or_mode",
    f"SELECT {K}, {r('coalesce(l_discount, (SELECT median(l_discount) FROM ' + GAPPY + '))')} AS l_discount, coalesce(l_returnflag, {_mode_sql('l_returnflag')}) AS l_returnflag FROM {GAPPY}",
)
def _(t):
    df = gappy(t).select(*KEY, "l_discount", "l_returnflag")
    return missing.fill(df, missing.fit_median_or_mode(df))


@query(
    "m14_mean_before_model",
    f"SELECT {r('coalesce(l_tax, (SELECT avg(l_tax) FROM ' + GAPPY + '))')} AS l_tax, l_linestatus FROM {GAPPY}",
)
def _(t):
    df = gappy(t).select("l_tax", "l_linestatus")
    return missing.fill(df, missing.fit_mean(df, ["l_tax"]))


# --- outliers ---------------------------------------------------------------------------------

P = "l_extendedprice"
_QUART = f"(SELECT quantile_cont({P}, 0.25) AS q1, quantile_cont({P}, 0.75) AS q3 FROM lineitem)"
BOUNDS = {
    "iqr": (0.8, f"SELECT q1 - 0.8 * (q3 - q1) AS lo, q3 + 0.8 * (q3 - q1) AS hi FROM {_QUART}"),
    "std": (1.5, f"SELECT avg({P}) - 1.5 * stddev_samp({P}) AS lo, avg({P}) + 1.5 * stddev_samp({P}) AS hi FROM lineitem"),
    "percentile": ((5, 95), f"SELECT quantile_cont({P}, 0.05) AS lo, quantile_cont({P}, 0.95) AS hi FROM lineitem"),
}
_ID = {"iqr": "x1", "std": "x3", "percentile": "x5"}
for _m, (_param, _sql) in BOUNDS.items():

    @query(
        f"{_ID[_m]}_{_m}_bounds",
        f"""SELECT '{P}' AS "column", '{_m}' AS method, {r('any_value(lo)', 4)} AS low, {r('any_value(hi)', 4)} AS high,
 count(*) FILTER ({P} < lo OR {P} > hi) AS outliers, count({P}) AS "values", {r(f'count(*) FILTER ({P} < lo OR {P} > hi) * 100.0 / count({P})', 4)} AS outlier_pct
 FROM lineitem, ({_sql})""",
    )
    def _(t, m=_m, param=_param):
        return outliers.report(t.lineitem, [P], m, param)


@query(
    "x2_zscore",
    f"""SELECT {K}, coalesce(abs(({P} - (SELECT avg({P}) FROM lineitem)) / (SELECT stddev_pop({P}) FROM lineitem)) > 2, false) AS is_far FROM lineitem""",
)
def _(t):
    d = outliers.fit(t.lineitem, [P], "zscore", 2.0)[P]
    return t.lineitem.select(*KEY, d.flag().alias("is_far"))


@query(
    "x4_modified_z",
    f"""SELECT {K}, coalesce(abs(0.6745 * ({P} - (SELECT median({P}) FROM lineitem)) / (SELECT mad({P}) FROM lineitem)) > 1.2, false) AS is_far FROM lineitem""",
)
def _(t):
    d = outliers.fit(t.lineitem, [P], "modified_z", 1.2)[P]
    return t.lineitem.select(*KEY, d.flag().alias("is_far"))


@query("x7_remove", f"SELECT {K}, {P} FROM lineitem, ({BOUNDS['iqr'][1]}) WHERE NOT ({P} < lo OR {P} > hi)")
def _(t):
    return outliers.treat(t.lineitem, [P], "iqr", "remove", 0.8).select(*KEY, P)


@query(
    "x8_cap",
    f"SELECT {K}, {r(f'CASE WHEN {P} < lo THEN lo WHEN {P} > hi THEN hi ELSE {P} END', 4)} AS {P} FROM lineitem, ({BOUNDS['iqr'][1]})",
)
def _(t):
    return outliers.treat(t.lineitem, [P], "iqr", "cap", 0.8).select(*KEY, P)


@query(
    "x8_cap_without_bounds",
    f"SELECT {K}, {r(f'CASE WHEN {P} < lo THEN lo WHEN {P} > hi THEN hi ELSE {P} END', 4)} AS {P} FROM lineitem, ({BOUNDS['percentile'][1]})",
)
def _(t):
    return outliers.treat(t.lineitem, [P], "zscore", "cap").select(*KEY, P)


@query("x9_log", f"SELECT {K}, {r(f'ln(1 + {P})')} AS {P} FROM lineitem")
def _(t):
    return outliers.treat(t.lineitem, [P], "iqr", "log").select(*KEY, P)


@query(
    "x10_mark",
    f"SELECT {K}, coalesce({P} < lo OR {P} > hi, false) AS {P}_outlier FROM lineitem, ({BOUNDS['std'][1]})",
)
def _(t):
    return outliers.treat(t.lineitem, [P], "std", "mark", 1.5).select(*KEY, f"{P}_outlier")


@query(
    "x11_many_columns",
    "SELECT count(*) AS rows_kept FROM lineitem, "
    + ", ".join(
        f"(SELECT quantile_cont({c}, 0.05) AS lo{i}, quantile_cont({c}, 0.95) AS hi{i} FROM lineitem) b{i}" for i, c in enumerate(NUMBERS)
    )
    + " WHERE "
    + " AND ".join(f"NOT ({c} < lo{i} OR {c} > hi{i})" for i, c in enumerate(NUMBERS)),
)
def _(t):
    kept = outliers.treat(t.lineitem, NUMBERS, "percentile", "remove")
    return kept.agg(F.count(F.lit(1)).alias("rows_kept"))


@query(
    "x13_wide_cap",
    "SELECT o_orderkey, "
    + r("CASE WHEN o_totalprice < q1 - 3 * (q3 - q1) THEN q1 - 3 * (q3 - q1) WHEN o_totalprice > q3 + 3 * (q3 - q1) THEN q3 + 3 * (q3 - q1) ELSE o_totalprice END", 4)
    + " AS o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)",
)
def _(t):
    out = outliers.wide_cap(t.orders.select("o_orderkey", "o_totalprice"))
    return out.withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query(
    "x14_range_check",
    union_all(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count,
 count(*) FILTER ({c} < q1 - 5 * (q3 - q1) OR {c} > q3 + 5 * (q3 - q1)) <= 0.05 * count({c}) AS valid_range
 FROM events, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM events)"""
        for c in ("event_id", "user_id", "value")
    ),
)
def _(t):
    from millrace.operators.validation import range_checks

    return range_checks(t.events)


@query(
    "x15_dispatch",
    union_all(
        f"""SELECT '{m}' AS method, count(*) FILTER (value < lo OR value > hi) AS outliers FROM events, ({s.replace(P, 'value').replace('lineitem', 'events')})"""
        for m, (_, s) in BOUNDS.items()
    ),
)
def _(t):
    parts = [outliers.report(t.events, ["value"], m, p).select("method", "outliers") for m, (p, _) in BOUNDS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- scaling ----------------------------------------------------------------------------------

_SCALE = {
    "standard": ("z1", "({c} - (SELECT avg({c}) FROM {t})) / (SELECT stddev_pop({c}) FROM {t})"),
    "minmax": ("z2", "({c} - (SELECT min({c}) FROM {t})) / (SELECT max({c}) - min({c}) FROM {t})"),
    "robust": ("z3", "({c} - (SELECT median({c}) FROM {t})) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM {t})"),
    "maxabs": ("z5", "{c} / (SELECT max(abs({c})) FROM {t})"),
}
for _m, (_id, _e) in _SCALE.items():

    @query(
        f"{_id}_{_m}_scale",
        f"SELECT {K}, " + ", ".join(f"{r(_e.format(c=c, t=GAPPY))} AS {c}" for c in NUMBERS) + f" FROM {GAPPY}",
    )
    def _(t, m=_m):
        return scaling.scale(gappy(t).select(*KEY, *NUMBERS), NUMBERS, m)


@query(
    "z4_quantile_uniform",
    # up to 1000 rows the reference quantiles are the values themselves
    f"""WITH v AS (SELECT s_acctbal, count(*) AS n, sum(count(*)) OVER (ORDER BY s_acctbal) AS upto, (SELECT count(*) FROM supplier) AS total FROM supplier GROUP BY 1)
 SELECT s_suppkey, {r('CASE WHEN upto = n THEN 0 WHEN upto = total THEN 1 ELSE ((upto - n) + (upto - 1)) / 2.0 / (total - 1) END')} AS s_acctbal
 FROM supplier JOIN v ON supplier.s_acctbal = v.s_acctbal""",
)
def _(t):
    return scaling.scale(t.supplier.select("s_suppkey", "s_acctbal"), ["s_acctbal"], "quantile_uniform")


@query("z4_quantile_normal")
def _(t):
    return scaling.scale(t.lineitem.select(*KEY, P), [P], "quantile_normal")


_LEN = " + ".join(f"{c} * {c}" for c in NUMBERS)


@query(
    "z6_row_normalise",
    f"SELECT {K}, " + ", ".join(f"{r(f'{c} / sqrt({_LEN})', 6)} AS {c}" for c in NUMBERS) + " FROM lineitem",
    digits=6,
)
def _(t):
    return scaling.scale(t.lineitem.select(*KEY, *NUMBERS), NUMBERS, "normalize")


@query(
    "z7_scaler_recommendation",
    union_all(
        f"""SELECT '{c}' AS "column", 'numeric' AS type, CASE WHEN abs(skewness({c})) > 2 THEN 'QuantileTransformer'
 WHEN count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) > 0 THEN 'RobustScaler'
 WHEN min({c}) >= 0 AND max({c}) <= 1 THEN 'None' ELSE 'StandardScaler' END AS recommended
 FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)"""
        for c in NUMBERS
    ),
)
def _(t):
    return scaling.recommend_scalers(t.lineitem.select(*NUMBERS))


@query(
    "z8_encoder_recommendation",
    union_all(
        f"""SELECT '{c}' AS "column", 'categorical' AS type, CASE WHEN count(DISTINCT {c}) <= 10 THEN 'OneHotEncoder' WHEN count(DISTINCT {c}) <= 50
 THEN 'OrdinalEncoder' ELSE 'TargetEncoder' END AS recommended FROM part"""
        for c in ("p_name", "p_brand", "p_type")
    ),
)
def _(t):
    return scaling.recommend_encoders(t.part)


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "z9_apply_recommended",
    f"""WITH m AS (SELECT avg(p_retailprice) AS m FROM part), g AS (SELECT p_name AS name, avg(p_retailprice) AS v, count(*) AS n FROM part GROUP BY 1)
 SELECT {r('CASE WHEN n = 1 THEN m ELSE m * (1 - 1 / (1 + exp(-(n - 20) / 10.0))) + v / (1 + exp(-(n - 20) / 10.0)) END')} AS p_name,
 CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand, {r('(p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER ()')} AS p_size, {r('p_retailprice')} AS p_retailprice,
 {', '.join(f"CAST(p_type = '{v}' AS INTEGER) AS p_type_{v}" for v in _TYPES)} FROM part p JOIN g ON p.p_name = g.name, m""",
)
def _(t):
    return scaling.apply_recommended(t.part.drop("p_partkey"), "p_retailprice")


@query(
    "z10_compare_scalers",
    union_all(
        f"""SELECT '{m}' AS method, {r('avg(x)')} AS mean, {r('stddev_samp(x)')} AS std, {r('min(x)')} AS "min", {r('max(x)')} AS "max"
 FROM (SELECT {e} AS x FROM lineitem)"""
        for m, e in [("original", "l_quantity")] + [(m, e.format(c="l_quantity", t="lineitem")) for m, (_, e) in _SCALE.items()]
    ),
)
def _(t):
    return scaling.compare_scalers(t.lineitem, "l_quantity")


@query(
    "z11_apply_scaler",
    f"SELECT c_custkey, {r(_SCALE['standard'][1].format(c='c_acctbal', t='customer'))} AS c_acctbal, c_mktsegment FROM customer",
)
def _(t):
    return scaling.scale(t.customer, ["c_acctbal"], "standard").select("c_custkey", "c_acctbal", "c_mktsegment")


# --- encoding and features --------------------------------------------------------------------

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def segments(t):
    return t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("NONE")).alias("seg"))


@query(
    "e1_one_hot",
    f"SELECT {K}, " + ", ".join(f"CAST(coalesce(l_returnflag = '{v}', false) AS INTEGER) AS l_returnflag_{v}" for v in ("A", "N")) + f" FROM {GAPPY}",
)
def _(t):
    return encoding.one_hot(gappy(t).select(*KEY, "l_returnflag"), ["l_returnflag"])


@query(
    "e1_one_hot_drop_first",
    f"SELECT {K}, CAST(coalesce(l_returnflag = 'N', false) AS INTEGER) AS \"l_returnflag_N\" FROM {GAPPY}",
)
def _(t):
    return encoding.one_hot(gappy(t).select(*KEY, "l_returnflag"), ["l_returnflag"], drop_first=True)


@query(
    "e1_indicators",
    """SELECT o_orderkey, (SELECT count(DISTINCT o_custkey) FROM orders) AS size,
 dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS place, CAST(1.0 AS DOUBLE) AS value FROM orders""",
)
def _(t):
    out = encoding.indicators(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"])
    at = lambda f: F.get(F.col("o_custkey")[f], F.lit(0))
    return out.select("o_orderkey", F.col("o_custkey.size").cast("bigint").alias("size"), at("indices").cast("bigint").alias("place"), at("values").alias("value"))


@query(
    "e2_label_encode",
    f"SELECT {K}, CAST(dense_rank() OVER (ORDER BY coalesce(l_returnflag, 'nan')) - 1 AS INTEGER) AS l_returnflag FROM {GAPPY}",
)
def _(t):
    return encoding.label_encode(gappy(t).select(*KEY, "l_returnflag"), ["l_returnflag"])


@query(
    "e3_ordinal_encode",
    f"SELECT {K}, CASE WHEN l_returnflag IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY l_returnflag NULLS LAST) - 1 AS INTEGER) END AS l_returnflag FROM {GAPPY}",
)
def _(t):
    return encoding.ordinal_encode(gappy(t).select(*KEY, "l_returnflag"), ["l_returnflag"])


@query(
    "e4_frequency_encode",
    f"""SELECT {K}, l_returnflag, CASE WHEN l_returnflag IS NOT NULL THEN {r(f'count(*) OVER (PARTITION BY l_returnflag) / CAST((SELECT count(l_returnflag) FROM {GAPPY}) AS DOUBLE)')} END AS l_returnflag_freq FROM {GAPPY}""",
)
def _(t):
    return encoding.frequency_encode(gappy(t).select(*KEY, "l_returnflag"), ["l_returnflag"])


@query(
    "e4_frequency_count",
    "SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS p_brand_freq FROM part",
)
def _(t):
    return encoding.frequency_encode(t.part.select("p_partkey", "p_brand"), ["p_brand"], share=False)


@query(
    "e5_binary_encode",
    f"""SELECT {K}, CAST(l_linestatus = (SELECT l_linestatus FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_linestatus LIMIT 1) AS INTEGER) AS l_linestatus FROM lineitem""",
)
def _(t):
    order = [*KEY, "l_partkey", "l_linestatus"]
    return encoding.binary_encode(t.lineitem, "l_linestatus", order).select(*KEY, "l_linestatus")


@query(
    "e6_target_encode",
    f"""WITH m AS (SELECT avg(p_retailprice) AS m FROM part), g AS (SELECT p_name, avg(p_retailprice) AS v, count(*) AS n FROM part GROUP BY 1)
 SELECT p_partkey, {r('CASE WHEN n = 1 THEN m ELSE m * (1 - 1 / (1 + exp(-(n - 20) / 10.0))) + v / (1 + exp(-(n - 20) / 10.0)) END')} AS p_name
 FROM part JOIN g USING (p_name), m""".replace("part JOIN g USING (p_name)", "part p JOIN g ON p.p_name = g.p_name"),
)
def _(t):
    return encoding.target_encode(t.part, ["p_name"], "p_retailprice").select("p_partkey", "p_name")


@query(
    "e7_encoding_summary",
    """SELECT 'p_brand' AS "column", 'one_hot' AS method, count(DISTINCT p_brand) AS original_unique, count(DISTINCT p_brand) AS new_columns, CAST(NULL AS VARCHAR) AS target FROM part
 UNION ALL SELECT 'p_type', 'one_hot', count(DISTINCT p_type), count(DISTINCT p_type), NULL FROM part""",
)
def _(t):
    return encoding.encoding_summary(t.part, ["p_brand", "p_type"], "one_hot")


@query(
    "e8_apply_encoder",
    "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type FROM part",
)
def _(t):
    return encoding.encode(t.part.select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], "ordinal")


@query(
    "g1_polynomial",
    f"""SELECT {K}, l_quantity, l_discount, {r('l_quantity * l_quantity')} AS "l_quantity^2", {r('l_quantity * l_discount')} AS "l_quantity l_discount",
 {r('l_discount * l_discount')} AS "l_discount^2" FROM {GAPPY}""",
)
def _(t):
    return encoding.polynomial(gappy(t).select(*KEY, "l_quantity", "l_discount"), ["l_quantity", "l_discount"], 2)


@query(
    "g2_equal_width_bins",
    """SELECT c_custkey, CAST(least(greatest(ceil((c_acctbal - lo) / ((hi - lo) / 7.0)) - 1, 0), 6) AS INTEGER) AS c_acctbal_binned
 FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""",
)
def _(t):
    return encoding.cut_equal(t.customer, "c_acctbal", 7).select("c_custkey", "c_acctbal_binned")


@query(
    "g3_labelled_bins",
    f"""SELECT {K}, CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'few' WHEN l_quantity > 10 AND l_quantity <= 30 THEN 'some' WHEN l_quantity > 30
 AND l_quantity <= 50 THEN 'many' END AS lot FROM {GAPPY}""",
)
def _(t):
    return encoding.cut_edges(gappy(t), "l_quantity", [0, 10, 30, 50], ["few", "some", "many"], "lot").select(*KEY, "lot")
