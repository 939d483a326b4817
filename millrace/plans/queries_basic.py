"""Queries over projections, filters, joins, aggregates, duplicates, profiles and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import aggregate as agg
from millrace.operators import dedup, joins, project, validation
from millrace.plans.catalog import query, r, union_all

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM = {
    "l_orderkey": "int64", "l_partkey": "int64", "l_suppkey": "int64", "l_linenumber": "int64",
    "l_quantity": "float64", "l_extendedprice": "float64", "l_discount": "float64", "l_tax": "float64",
    "l_returnflag": "object", "l_linestatus": "object", "l_shipdate": "datetime64[ns]",
}


def gappy(t):
    """lineitem with gaps: a zero discount or tax, and a full lot of 50, count as not recorded."""
    return t.lineitem.withColumns(
        {
            "l_discount": F.nullif(F.col("l_discount"), F.lit(0.0)),
            "l_tax": F.nullif(F.col("l_tax"), F.lit(0.0)),
            "l_quantity": F.nullif(F.col("l_quantity"), F.lit(50.0)),
            "l_returnflag": F.nullif(F.col("l_returnflag"), F.lit("R")),
        }
    )


GAPPY = """(SELECT * REPLACE (nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax,
 nullif(l_quantity, 50) AS l_quantity, nullif(l_returnflag, 'R') AS l_returnflag) FROM lineitem)"""


def doubled(t):
    """orders with its urgent rows twice."""
    return t.orders.unionByName(t.orders.where("o_orderpriority = '1-URGENT'"))


DOUBLED = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderpriority = '1-URGENT')"

# --- projections and filters ------------------------------------------------------------------


@query(
    "p1_type_groups",
    union_all(
        f"SELECT '{'numeric' if k.endswith('64') else 'categorical' if k == 'object' else 'datetime'}' AS kind, '{c}' AS \"column\""
        for c, k in LINEITEM.items()
    ),
)
def _(t):
    return project.type_groups(t.lineitem)


@query("p2_value_filter", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t):
    kept = project.keep_values(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return kept.select("o_orderkey", "o_orderpriority")


@query("p2_value_picker", "SELECT DISTINCT p_size FROM part WHERE p_size IS NOT NULL ORDER BY 1 LIMIT 100")
def _(t):
    return project.offered_values(t.part, "p_size", 100)


@query("p3_text_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')")
def _(t):
    return project.search_text(t.part, "p_name", "RED").select("p_partkey", "p_name")


@query("p4_range_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
def _(t):
    return project.keep_range(t.orders, "o_totalprice", 100000.0, 200000.0).select("o_orderkey", "o_totalprice")


@query(
    "p5_complete_rows",
    f"""SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM {GAPPY}
 WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL""",
)
def _(t):
    kept = project.complete_rows(gappy(t), ["l_quantity", "l_discount"])
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query(
    "p6_drop_empty",
    """SELECT p_partkey, p_brand FROM (SELECT CASE WHEN p_size > 10 THEN p_partkey END AS p_partkey,
 CASE WHEN p_size > 10 THEN p_brand END AS p_brand FROM part) WHERE p_partkey IS NOT NULL OR p_brand IS NOT NULL""",
)
def _(t):
    big = F.col("p_size") > 10
    part = t.part.select(
        F.when(big, F.col("p_partkey")).alias("p_partkey"),
        F.when(big, F.col("p_brand")).alias("p_brand"),
        F.lit(None).cast("string").alias("p_nothing"),
    )
    return project.drop_empty(part)


@query(
    "p7_drop_zero_rows",
    """SELECT l_orderkey, l_linenumber, net_price FROM (SELECT *, CASE WHEN l_discount >= 0.09 THEN 0 ELSE l_extendedprice END
 AS net_price FROM lineitem) WHERE net_price IS NULL OR net_price <> 0""",
)
def _(t):
    price = F.when(F.col("l_discount") >= 0.09, 0.0).otherwise(F.col("l_extendedprice"))
    priced = t.lineitem.withColumn("net_price", price).select("l_orderkey", "l_linenumber", "net_price")
    return project.drop_zero_rows(priced)


@query("p8_features_and_target", "SELECT l_quantity, l_discount, l_returnflag FROM lineitem")
def _(t):
    return project.features_and_target(t.lineitem, ["l_quantity", "l_discount"], "l_returnflag")


@query(
    "p9_derived_column",
    f"SELECT l_orderkey, l_linenumber, {r('l_extendedprice * (1 - l_discount)')} AS revenue FROM lineitem",
)
def _(t):
    out = project.derive(t.lineitem, "revenue", "l_extendedprice * (1 - l_discount)")
    return out.select("l_orderkey", "l_linenumber", "revenue")


@query(
    "p9_z_normalised",
    f"""SELECT o_orderkey, {r('(o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER ()', 4)} AS z
 FROM orders""",
)
def _(t):
    return project.z_normalised(t.orders, "o_totalprice", "z").select("o_orderkey", "z")


@query(
    "p9_age_bins",
    """SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 25 THEN 'medium'
 WHEN p_size > 25 AND p_size <= 40 THEN 'large' END AS size_group FROM part""",
)
def _(t):
    from millrace.operators.encoding import cut_edges

    out = cut_edges(t.part, "p_size", [0, 10, 25, 40], ["small", "medium", "large"], "size_group")
    return out.select("p_partkey", "size_group")


@query(
    "p9_above_median",
    """SELECT c_custkey, CAST(coalesce(c_acctbal > (SELECT median(c_acctbal) FROM customer), false) AS INTEGER) AS rich
 FROM customer""",
)
def _(t):
    return project.above_median(t.customer, "c_acctbal", "rich").select("c_custkey", "rich")


@query("p9_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS order_year FROM orders")
def _(t):
    text = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return project.year_of(text, "day", "order_year").select("o_orderkey", "order_year")


@query("p9_joined_text", "SELECT p_partkey, p_brand || ' ' || p_type AS label FROM part")
def _(t):
    return project.joined_text(t.part, ["p_brand", "p_type"], "label").select("p_partkey", "label")


@query(
    "p10_columns_by_keyword",
    "SELECT 'l_extendedprice' AS \"column\", 'amount' AS word_class UNION ALL SELECT 'l_quantity', 'amount'"
    " UNION ALL SELECT 'l_shipdate', 'date'",
)
def _(t):
    line = t.lineitem
    rows = [(c, "amount") for c in project.named_like(line.columns, project.AMOUNT_WORDS)]
    rows += [(c, "date") for c in project.named_like(line.columns, project.DATE_WORDS)]
    return t.spark.createDataFrame(rows, "column string, word_class string")


# --- joins ------------------------------------------------------------------------------------

ORDER_SIDE = "SELECT o_orderkey, nullif(o_custkey, 3) AS o_custkey, o_orderpriority AS tag FROM orders"
CUSTOMER_SIDE = "SELECT nullif(c_custkey, 7) AS c_custkey, c_nationkey, c_mktsegment AS tag FROM customer"


def _sides(t):
    orders = t.orders.select("o_orderkey", F.nullif("o_custkey", F.lit(3)).alias("o_custkey"), F.col("o_orderpriority").alias("tag"))
    customers = t.customer.select(
        F.nullif("c_custkey", F.lit(7)).alias("c_custkey"), "c_nationkey", F.col("c_mktsegment").alias("tag")
    )
    return orders, customers


for _how in ("inner", "left", "right", "outer"):

    @query(
        f"j1_merge_{_how}",
        f"""SELECT o.o_orderkey, o.o_custkey, o.tag AS tag_x, c.c_custkey, c.c_nationkey, c.tag AS tag_y
 FROM ({ORDER_SIDE}) o {'full' if _how == 'outer' else _how} JOIN ({CUSTOMER_SIDE}) c
 ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey""",
    )
    def _(t, how=_how):
        return joins.merge(*_sides(t), "o_custkey", "c_custkey", how)


@query(
    "j1_merge_hot_null_keys",
    """SELECT o.o_orderkey, o.o_ref, c.c_custkey, c.c_ref
 FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN -7 ELSE o_custkey END AS o_ref FROM orders) o
 FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey <= 3 THEN NULL ELSE c_custkey END AS c_ref FROM customer) c ON o.o_ref IS NOT DISTINCT FROM c.c_ref""",
)
def _(t):
    """Half of the keys are null, which match three rows; a fifth of the rest is one key without a match."""
    ref = F.when(F.col("o_orderkey") % 2 == 0, None).when(F.col("o_orderkey") % 5 == 0, F.lit(-7)).otherwise(F.col("o_custkey"))
    left = t.orders.select("o_orderkey", ref.cast("bigint").alias("o_ref"))
    right = t.customer.select("c_custkey", F.when(F.col("c_custkey") > 3, F.col("c_custkey")).alias("c_ref"))
    return joins.merge(left, right, "o_ref", "c_ref", "outer")


@query(
    "j1_merge_shared_key",
    """SELECT coalesce(a.n_regionkey, b.n_regionkey) AS n_regionkey, a.n_name, b.r_name
 FROM nation a FULL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) b ON a.n_regionkey = b.n_regionkey""",
)
def _(t):
    region = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.merge(t.nation.drop("n_nationkey"), region, "n_regionkey", "n_regionkey", "outer")


@query(
    "j2_top_key_rows",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1
 ORDER BY sum(CAST(o_totalprice AS DECIMAL(18,2))) DESC, o_custkey LIMIT 20)""",
)
def _(t):
    orders = t.orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    return joins.keep_top_keys(orders, "o_custkey", "o_totalprice", 20).select("o_orderkey", "o_custkey")


@query(
    "j3_lookup",
    """SELECT s_suppkey, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
def _(t):
    return joins.look_up(t.supplier, "s_nationkey", t.nation, "n_nationkey", "n_name", "nation").select("s_suppkey", "nation")


_COMPARED = [("only_b", c, "false", "true") for c in ("c_mktsegment", "c_nationkey", "c_name", "c_custkey", "c_acctbal")]
_COMPARED += [("only_a", c, "true", "false") for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")]
_COMPARED += [("shape", "columns", "4", "5"), ("types", "int64", "2", "2"), ("types", "float64", "1", "1"), ("types", "object", "1", "2")]


@query(
    "j4_compare_tables",
    union_all(f"SELECT '{s}' AS section, '{k}' AS \"key\", '{a}' AS a, '{b}' AS b" for s, k, a, b in _COMPARED)
    + " UNION ALL SELECT 'shape', 'rows', CAST((SELECT count(*) FROM supplier) AS VARCHAR), CAST((SELECT count(*) FROM customer) AS VARCHAR)",
)
def _(t):
    return joins.compare_tables(t.supplier, t.customer)


# --- aggregates -------------------------------------------------------------------------------

_A1 = {"count": "count(l_quantity)", "sum": "sum(l_quantity)", "mean": "avg(l_quantity)", "median": "median(l_quantity)"}
for _how, _expr in _A1.items():

    @query(
        f"a1_group_{_how}",
        f"""SELECT l_returnflag, {_expr if _how == 'count' else r(_expr)} AS value FROM {GAPPY}
 WHERE l_returnflag IS NOT NULL GROUP BY 1""",
    )
    def _(t, how=_how):
        return agg.group_aggregate(gappy(t), ["l_returnflag"], "l_quantity", how)


@query(
    "a2_group_two_keys",
    f"""SELECT l_returnflag, l_linestatus, {r('avg(l_extendedprice)', 4)} AS value FROM {GAPPY}
 WHERE l_returnflag IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    return agg.group_aggregate(gappy(t), ["l_returnflag", "l_linestatus"], "l_extendedprice", "mean")


@query("a3_value_counts", "SELECT p_brand, count(*) AS \"count\" FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return agg.value_counts(t.part, "p_brand", 10)


@query(
    "a4_pivot",
    f"""SELECT l_returnflag, {r("avg(l_quantity) FILTER (l_linestatus = 'F')")} AS "F",
 {r("avg(l_quantity) FILTER (l_linestatus = 'O')")} AS "O" FROM lineitem GROUP BY 1""",
)
def _(t):
    return agg.pivot(t.lineitem, "l_returnflag", "l_linestatus", "l_quantity", "mean")


@query(
    "a4_pivot_long",
    f"""SELECT l_returnflag AS "row", CAST(l_partkey AS VARCHAR) AS "column", dense_rank() OVER (ORDER BY CAST(l_partkey AS VARCHAR)) AS place,
 {r("avg(l_quantity)")} AS "value" FROM lineitem GROUP BY l_returnflag, l_partkey""",
)
def _(t):
    return agg.pivot_long(t.lineitem, "l_returnflag", "l_partkey", "l_quantity", "mean")


@query(
    "a4_pivot_page",
    "SELECT l_suppkey, " + ", ".join(f"""{r(f"sum(l_quantity) FILTER (l_linenumber = {i})")} AS "{i}\"""" for i in (4, 5, 6)) + " FROM lineitem GROUP BY 1",
)
def _(t):
    return agg.pivot_page(t.lineitem, "l_suppkey", "l_linenumber", "l_quantity", "sum", page=1, width=3)


@query(
    "a5_null_profile",
    union_all(
        f"""SELECT '{c}' AS "column", count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS "unique",
 count(*) AS total, {r(f'(count(*) - count({c})) * 100.0 / count(*)')} AS null_pct,
 {r(f'count(DISTINCT {c}) * 100.0 / count(*)')} AS unique_pct FROM {GAPPY}"""
        for c in LINEITEM
    ),
)
def _(t):
    return agg.null_profile(gappy(t))


def _describe_sql(c, table, digits=4):
    return f"""SELECT '{c}' AS "column", count({c}) AS "count", {r(f'avg({c})', digits)} AS mean, {r(f'stddev_samp({c})', digits)} AS std,
 {r(f'min({c})', digits)} AS "min", {r(f'quantile_cont({c}, 0.25)', digits)} AS q25, {r(f'quantile_cont({c}, 0.5)', digits)} AS q50,
 {r(f'quantile_cont({c}, 0.75)', digits)} AS q75, {r(f'max({c})', digits)} AS "max" FROM {table}"""


@query("a6_describe", union_all(_describe_sql(c, GAPPY) for c in NUMBERS))
def _(t):
    return agg.describe(gappy(t), NUMBERS)


_FIRST = lambda c, table: f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1)"
_FREQ = lambda c, table: f"(SELECT count(*) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1)"


@query(
    "a7_describe_all",
    union_all(
        [f"SELECT *, NULL AS \"unique\", NULL AS top, NULL AS freq FROM ({_describe_sql('c_acctbal', 'customer', 4)})"]
        + [
            f"""SELECT '{c}', count({c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(DISTINCT {c}),
 {_FIRST(c, 'customer')}, {_FREQ(c, 'customer')} FROM customer"""
            for c in ("c_name", "c_mktsegment")
        ]
    ),
)
def _(t):
    return agg.describe_all(t.customer.drop("c_custkey", "c_nationkey"))


@query(
    "a8_categorical_summary",
    union_all(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", count(DISTINCT {c}) AS "unique", {_FIRST(c, GAPPY)} AS top,
 {_FREQ(c, GAPPY)} AS freq, count(*) - count({c}) AS missing, {r(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct FROM {GAPPY}"""
        for c in ("l_returnflag", "l_linestatus")
    ),
)
def _(t):
    return agg.categorical_summary(gappy(t))


@query(
    "a9_distribution",
    union_all(
        f"""SELECT '{c}' AS "column", {r(f'avg({c})', 4)} AS mean, {r(f'median({c})', 4)} AS median, {r(f'stddev_samp({c})', 4)} AS std,
 {r(f'skewness({c})', 4)} AS skewness, {r(f'kurtosis({c})', 4)} AS kurtosis FROM {GAPPY}"""
        for c in NUMBERS
    ),
)
def _(t):
    return agg.distribution(gappy(t), NUMBERS)


_PROBS = [0.01, 0.1, 0.333, 0.9, 0.99]


@query(
    "a10_quantiles",
    union_all(
        f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS p, {r(f'quantile_cont({c}, {p})', 4)} AS value FROM lineitem"
        for c in NUMBERS
        for p in _PROBS
    ),
)
def _(t):
    return agg.quantile_table(t.lineitem, NUMBERS, _PROBS)


@query(
    "a11_mad",
    union_all(
        f"SELECT '{c}' AS \"column\", {r(f'median({c})', 4)} AS median, {r(f'mad({c})', 4)} AS mad FROM {GAPPY}" for c in NUMBERS
    ),
)
def _(t):
    return agg.mad_table(gappy(t), NUMBERS)


@query(
    "a12_skew_kurtosis",
    f"""SELECT event_type, {r('skewness(value)')} AS skew, {r('kurtosis(value)')} AS kurt FROM events GROUP BY 1""",
)
def _(t):
    from millrace.functions.semantics import sample_kurtosis, sample_skewness

    v = F.col("value")
    return t.events.groupBy("event_type").agg(sample_skewness(v).alias("skew"), sample_kurtosis(v).alias("kurt"))


@query(
    "a13_entropy",
    union_all(
        f"""SELECT '{c}' AS "column", count(*) AS "unique", {r('-sum(p * log2(p))')} AS entropy,
 {r('CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 1 END')} AS balance
 FROM (SELECT count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM orders WHERE {c} IS NOT NULL GROUP BY {c})"""
        for c in ("o_orderstatus", "o_orderpriority", "o_custkey")
    ),
)
def _(t):
    return agg.entropy(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query(
    "a14_correlation_matrix",
    union_all(
        f"SELECT '{a}' AS a, '{b}' AS b, {r('1.0' if a == b else f'corr({a}, {b})')} AS r FROM {GAPPY if a != b else '(SELECT 1)'}"
        for a in NUMBERS
        for b in NUMBERS
    ),
)
def _(t):
    return agg.correlations(gappy(t), NUMBERS)


@query(
    "a15_correlated_pairs",
    f"""SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, {r('corr(l_quantity, l_extendedprice)')} AS r FROM lineitem
 HAVING abs(corr(l_quantity, l_extendedprice)) > 0.8""",
)
def _(t):
    return agg.correlated_pairs(t.lineitem, NUMBERS, 0.8)


@query(
    "a16_target_correlation",
    union_all(
        f"SELECT '{c}' AS feature, {r(f'abs(corr({c}, l_extendedprice))')} AS score FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax")
    ),
)
def _(t):
    return agg.target_correlations(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


def _vif_sql():
    """Closed form for three columns: VIF_1 = G11 * (G22 G33 - G23^2) / det(G)."""
    cols = ["l_quantity", "l_discount", "l_tax"]
    g = {}
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            g[i, j] = f"g{min(i, j)}{max(i, j)}"
    sums = ", ".join(f"sum({cols[i]} * {cols[j]}) AS g{i}{j}" for i in range(3) for j in range(i, 3))
    det = "(g00*(g11*g22-g12*g12) - g01*(g01*g22-g12*g02) + g02*(g01*g12-g11*g02))"
    minors = ["(g11*g22-g12*g12)", "(g00*g22-g02*g02)", "(g00*g11-g01*g01)"]
    rows = union_all(f"SELECT '{c}' AS feature, g{i}{i} * {minors[i]} / {det} AS v FROM s" for i, c in enumerate(cols))
    where = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return f"""WITH s AS (SELECT {sums} FROM {GAPPY} WHERE {where}), v AS ({rows})
 SELECT feature, {r('v')} AS vif, CASE WHEN v > 10 THEN 'High' WHEN v > 5 THEN 'Moderate' ELSE 'Low' END AS status FROM v"""


@query("a17_vif", _vif_sql())
def _(t):
    return agg.variance_inflation(gappy(t), ["l_quantity", "l_discount", "l_tax"])


@query(
    "a18_class_balance",
    """SELECT CAST(quality AS VARCHAR) AS class, count(*) AS "count",
 round(count(*) / CAST((SELECT count(*) FROM labels) AS DOUBLE) * 100, 2) AS percentage FROM labels GROUP BY quality""",
)
def _(t):
    return agg.class_balance(t.labels, "quality")


@query(
    "a18_imbalance",
    f"""SELECT count(*) AS classes, {r('max(n) / CAST(min(n) AS DOUBLE)')} AS ratio,
 CASE WHEN max(n) / CAST(min(n) AS DOUBLE) > 5 THEN 'significant' WHEN max(n) / CAST(min(n) AS DOUBLE) > 2 THEN 'moderate' ELSE 'balanced' END AS band
 FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)""",
)
def _(t):
    return agg.imbalance(t.labels, "toxic")


_LINE_FILLED = " + ".join(f"count({c})" for c in LINEITEM)


@query(
    "a19_quality_indicators",
    f"""WITH c AS (SELECT 100.0 * ({_LINE_FILLED}) / (11 * count(*)) AS complete, count(*) AS n FROM {GAPPY}),
 d AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM {GAPPY}))
 SELECT 'completeness' AS indicator, {r('complete')} AS value, CASE WHEN complete >= 95 THEN 'excellent' WHEN complete >= 80 THEN 'good'
 ELSE 'needs attention' END AS band FROM c
 UNION ALL SELECT 'uniqueness', {r('100 - 100.0 * (n - k) / n')}, CASE WHEN n = k THEN 'no duplicates' WHEN (n - k) * 100.0 / n < 5
 THEN 'low duplicates' ELSE 'high duplicates' END FROM c, d
 UNION ALL SELECT 'type_consistency', 100.0, 'excellent'""",
)
def _(t):
    return agg.quality_indicators(gappy(t))


@query(
    "a20_kpi",
    union_all(
        f"SELECT '{c}' AS kpi, {r(f'avg({c})', 4)} AS mean, {r(f'max({c})', 4)} AS \"max\" FROM lineitem"
        for c in ("l_quantity", "l_extendedprice")
    ),
)
def _(t):
    return agg.kpi(t.lineitem, ["l_quantity", "l_extendedprice"])


@query(
    "a21_group_means",
    f"""SELECT *, {r('max(greatest(l_quantity, l_discount)) OVER ()')} AS axis_max FROM (SELECT p_brand,
 {r('avg(l_quantity)')} AS l_quantity, {r('avg(l_discount)')} AS l_discount FROM lineitem JOIN part ON l_partkey = p_partkey
 GROUP BY 1 ORDER BY 1 LIMIT 5)""",
)
def _(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return agg.group_means(joined, ["l_quantity", "l_discount"], "p_brand", 5)


_LINE_NULLS = f"(11 * count(*) - ({_LINE_FILLED}))"


@query(
    "a22_grand_totals",
    f"""SELECT CAST(11 * count(*) AS BIGINT) AS total_cells, CAST({_LINE_NULLS} AS BIGINT) AS null_cells,
 {r(f'{_LINE_NULLS} * 100.0 / (11 * count(*))')} AS null_rate FROM {GAPPY}""",
)
def _(t):
    return agg.grand_totals(gappy(t))


@query(
    "a23_flag_statistics",
    f"""WITH b AS (SELECT quantile_cont(l_extendedprice, 0.75) + 0.5 * (quantile_cont(l_extendedprice, 0.75)
 - quantile_cont(l_extendedprice, 0.25)) AS hi FROM lineitem)
 SELECT CASE WHEN l_extendedprice > hi THEN 'outlier' ELSE 'normal' END AS "group", count(*) AS "count",
 {r('avg(l_extendedprice)', 4)} AS mean, {r('median(l_extendedprice)', 4)} AS median, {r('stddev_samp(l_extendedprice)', 4)} AS std
 FROM lineitem, b GROUP BY 1""",
)
def _(t):
    from millrace.operators import outliers

    d = outliers.fit(t.lineitem, ["l_extendedprice"], "iqr", 0.5)["l_extendedprice"]
    return agg.flag_statistics(t.lineitem, "l_extendedprice", d.flag())


@query(
    "a24_before_after",
    union_all(
        f"""SELECT '{s}' AS stage, 'l_quantity' AS "column", {r(f'avg({e})', 4)} AS mean, {r(f'stddev_samp({e})', 4)} AS std,
 {r(f'min({e})', 4)} AS "min", {r(f'max({e})', 4)} AS "max" FROM lineitem"""
        for s, e in (("before", "l_quantity"), ("after", "ln(1 + l_quantity)"))
    ),
)
def _(t):
    from millrace.operators.outliers import log_transform

    return agg.before_after(t.lineitem, log_transform(t.lineitem, ["l_quantity"]), ["l_quantity"])


# --- duplicates -------------------------------------------------------------------------------


@query("d1_drop_duplicates", f"SELECT DISTINCT o_orderkey, o_custkey, o_orderpriority FROM {DOUBLED}")
def _(t):
    return dedup.drop_duplicates(doubled(t)).select("o_orderkey", "o_custkey", "o_orderpriority")


@query(
    "d1_drop_nested_duplicates",
    "SELECT DISTINCT label FROM embeddings",
)
def _(t):
    nested = t.embeddings.select("label", F.create_map(F.lit("label"), F.col("label")).alias("m"))
    return dedup.drop_duplicates(nested).select("label")


@query(
    "d2_duplicate_count",
    f"""SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, {r('sum(n - 1) * 100.0 / sum(n)')} AS duplicate_pct
 FROM (SELECT count(*) AS n FROM {DOUBLED} GROUP BY ALL)""".replace("count(*) AS n", "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, count(*) AS n"),
)
def _(t):
    return dedup.duplicates_table(doubled(t))


for _keep, _dir in (("first", "ASC"), ("last", "DESC")):

    @query(
        f"d3_keep_{_keep}",
        f"""SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
 ORDER BY o_orderdate {_dir}, o_orderkey {_dir}) AS rn FROM orders) WHERE rn = 1""",
    )
    def _(t, keep=_keep):
        kept = dedup.keep_one(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], keep)
        return kept.select("o_orderkey", "o_custkey", "o_totalprice")


# --- profiles and validation ------------------------------------------------------------------


def _entropy_sql(c, table):
    return f"""(SELECT CASE WHEN count(*) = 1 THEN 100.0 ELSE -sum(p * log2(p)) / log2(count(*)) * 100 END FROM
 (SELECT count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}))"""


def validation_sql(table, columns, digits=4):
    """The validation record in SQL; every number and date column reads as float64, text as object."""
    parts = []
    for c, kind in columns.items():
        numeric = kind.endswith("64")
        inferred = "object" if kind == "object" else "float64"
        if numeric:
            fence = lambda m: f"({c} < q1 - {m} * (q3 - q1) OR {c} > q3 + {m} * (q3 - q1))"
            outliers = f"(CASE WHEN max(q3) > max(q1) THEN count(*) FILTER ({fence(1.5)}) ELSE 0 END)"
            far = f"(CASE WHEN max(q3) > max(q1) THEN count(*) FILTER ({fence(5)}) ELSE 0 END)"
            health = f"((greatest(0, 100 - abs(skewness({c})) * 10) + greatest(0, 100 - abs(kurtosis({c})) * 5)) / 2)"
            source = f"{table} x, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table} y)"
        else:
            outliers, far, health, source = "0", "0", _entropy_sql(c, table), f"{table} x"
        parts.append(
            f"""SELECT '{c}' AS "column", '{kind}' AS data_type, '{inferred}' AS inferred_type, count(*) AS total_count,
 count({c}) AS non_null_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count,
 count({c}) * 100.0 / count(*) AS completeness_pct, count(DISTINCT {c}) * 100.0 / count({c}) AS uniqueness_pct,
 {'true' if kind == inferred else 'false'} AS type_consistency, {far} * 1.0 / count({c}) <= 0.05 AS valid_range,
 CAST({outliers} AS BIGINT) AS outlier_count, {outliers} * 100.0 / count({c}) AS outlier_impact, {health} AS distribution_health FROM {source}"""
        )
    validity = """(completeness_pct * 0.3 + (100 - outlier_impact) * 0.2 + CASE WHEN type_consistency THEN 20 ELSE 10 END
 + CASE WHEN valid_range THEN 10 ELSE 0 END + distribution_health * 0.2)"""
    return f"""SELECT "column", data_type, inferred_type, total_count, non_null_count, null_count, unique_count,
 {r('completeness_pct', digits)} AS completeness_pct, {r('uniqueness_pct', digits)} AS uniqueness_pct, type_consistency, valid_range,
 outlier_count, {r('outlier_impact', digits)} AS outlier_impact, {r('distribution_health', digits)} AS distribution_health,
 {r(validity, digits)} AS validity_score, {r(f'completeness_pct * 0.4 + uniqueness_pct * 0.2 + {validity} * 0.4', digits)} AS overall_score
 FROM ({union_all(parts)})"""


@query("y5_column_validation", validation_sql("lineitem", LINEITEM))
def _(t):
    return validation.validate_columns(t.lineitem)


@query("y5_column_validation_gaps", validation_sql(GAPPY, LINEITEM))
def _(t):
    return validation.validate_columns(gappy(t))


@query(
    "y1_profile",
    f"""SELECT count(*) AS total_rows, CAST(11 AS BIGINT) AS total_columns, CAST({_LINE_NULLS} AS BIGINT) AS missing_values,
 (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {GAPPY})) AS duplicate_rows FROM {GAPPY}""",
)
def _(t):
    return validation.profile(gappy(t)).select("total_rows", "total_columns", "missing_values", "duplicate_rows")


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_SCORE = f"""(WITH b AS (SELECT count(*) AS n, 6 * count(*) - ({' + '.join(f'count({c})' for c in _ORDER_COLS)}) AS miss FROM {DOUBLED}),
 d AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM {DOUBLED}))
 SELECT n AS total_rows, CAST(6 AS BIGINT) AS total_columns, CAST(miss AS BIGINT) AS missing_values, n - k AS duplicate_rows,
 miss * 100.0 / (6 * n) AS missing_pct, (n - k) * 100.0 / n AS duplicate_pct FROM b, d)"""
_SCORED = f"(SELECT *, greatest(0, least(100, 100 - 2 * missing_pct - 3 * duplicate_pct)) AS q FROM {_SCORE})"


@query(
    "y3_quality_score",
    f"""SELECT total_rows, total_columns, missing_values, duplicate_rows, {r('missing_pct')} AS missing_pct, {r('duplicate_pct')} AS duplicate_pct,
 {r('q')} AS quality_score, CASE WHEN q >= 90 THEN 'excellent' WHEN q >= 70 THEN 'good' ELSE 'fair' END AS band FROM {_SCORED}""",
)
def _(t):
    return validation.quality_score(doubled(t))


@query(
    "y2_quality_report",
    f"""SELECT {r('q')} AS overall, CASE WHEN q >= 90 THEN 'A' WHEN q >= 80 THEN 'B' WHEN q >= 70 THEN 'C' WHEN q >= 60 THEN 'D' ELSE 'F' END AS grade,
 total_rows AS n_rows, total_columns AS n_columns, {r('missing_pct')} AS missing_percentage, duplicate_rows AS n_duplicates,
 CAST((missing_pct > 5)::INT + (duplicate_rows > 0)::INT AS INTEGER) AS n_alerts FROM {_SCORED}""",
)
def _(t):
    rep = validation.quality_report(doubled(t))
    return rep.select("quality_score.*", "overview.*", "duplicates.*", F.size("alerts").alias("n_alerts"))


@query(
    "y4_quality_overview",
    union_all(
        f"""SELECT '{n}' AS dataset, count(*) AS total_rows, CAST({w} AS BIGINT) AS total_columns, 0.0::DOUBLE AS missing_pct,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {n})) AS duplicate_rows FROM {n}"""
        for n, w in (("customer", 5), ("supplier", 4), ("part", 6))
    ),
)
def _(t):
    return validation.quality_overview({"customer": t.customer, "supplier": t.supplier, "part": t.part})


@query(
    "y4_platform_totals",
    """SELECT CAST(3 AS BIGINT) AS datasets, CAST(0 AS BIGINT) AS models, CAST(0 AS BIGINT) AS operations,
 (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS total_rows, CAST(15 AS BIGINT) AS total_columns""",
)
def _(t):
    return validation.platform_totals({"customer": t.customer, "supplier": t.supplier, "part": t.part})


@query(
    "y6_type_inference",
    union_all(
        f"SELECT '{c}' AS \"column\", '{d}' AS data_type, '{i}' AS inferred_type, {str(d == i).lower()} AS type_consistency"
        for c, d, i in (
            ("key", "int64", "float64"), ("flag_text", "object", "float64"), ("day", "object", "datetime64[ns]"),
            ("yes_no", "object", "bool"), ("price_text", "object", "float64"), ("name", "object", "object"),
        )
    ),
)
def _(t):
    orders = t.orders.select(
        F.col("o_orderkey").alias("key"),
        F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("flag_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("no").alias("yes_no"),
        F.concat(F.lit(" "), F.col("o_totalprice").cast("string")).alias("price_text"),
        F.col("o_orderpriority").alias("name"),
    )
    return validation.type_inference(orders)


@query(
    "y7_distribution_health",
    f"SELECT \"column\", distribution_health FROM ({validation_sql('events', {'event_id': 'int64', 'ts': 'datetime64[ns]', 'user_id': 'int64', 'event_type': 'object', 'value': 'float64'})})",
)
def _(t):
    return validation.distribution_health(t.events.drop("props"))


@query(
    "y8_cardinality_health",
    union_all(
        f"""SELECT '{c}' AS "column", {r('u')} AS unique_ratio, CAST(CASE {
            "WHEN u BETWEEN 0.7 AND 0.95 THEN 100 WHEN u < 0.1 THEN 30 WHEN u > 0.99 THEN 70 ELSE 80"
            if k.endswith('64') else "WHEN u BETWEEN 0.01 AND 0.1 THEN 100 WHEN u > 0.8 THEN 30 ELSE 70"
        } END AS INTEGER) AS score FROM (SELECT count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) AS u FROM part)"""
        for c, k in (("p_partkey", "int64"), ("p_name", "object"), ("p_brand", "object"), ("p_type", "object"), ("p_size", "int64"), ("p_retailprice", "float64"))
    ),
)
def _(t):
    return validation.cardinality_health(t.part)


@query(
    "y9_potential_targets",
    "SELECT * FROM ("
    + union_all(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "unique", CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary' ELSE 'few values' END AS reason
 FROM lineitem"""
        for c, k in LINEITEM.items()
        if k in ("int64", "object")
    )
    + """) WHERE "unique" BETWEEN 2 AND 10""",
)
def _(t):
    return validation.potential_targets(t.lineitem)


@query(
    "y10_robustness",
    f"""SELECT {r('avg(overall_score)', 4)} AS overall_robustness, count(*) FILTER (overall_score >= 80) AS high_quality_columns,
 count(*) FILTER (overall_score < 60) AS low_quality_columns FROM ({validation_sql(GAPPY, LINEITEM, 6)})""",
)
def _(t):
    return validation.robustness(gappy(t))


@query(
    "y10_robustness_breakdown",
    f"SELECT \"column\", completeness_pct, uniqueness_pct, validity_score, overall_score FROM ({validation_sql(GAPPY, LINEITEM)})",
)
def _(t):
    return validation.robustness_breakdown(gappy(t))


_ADVICE = """SELECT 'Mostly missing: ' || "column" AS title, 'High' AS priority FROM v WHERE completeness_pct < 50
 UNION ALL SELECT 'Gaps: ' || "column", 'Medium' FROM v WHERE completeness_pct >= 50 AND completeness_pct < 80
 UNION ALL SELECT 'Outliers: ' || "column", 'Medium' FROM v WHERE outlier_impact > 10
 UNION ALL SELECT 'Type: ' || "column", 'Medium' FROM v WHERE NOT type_consistency
 UNION ALL SELECT 'Many values: ' || "column", 'Low' FROM v WHERE data_type = 'object' AND uniqueness_pct > 80 AND unique_count > 50"""


@query("y11_column_recommendations", f"WITH v AS ({validation_sql(GAPPY, LINEITEM)}) {_ADVICE}")
def _(t):
    return validation.column_recommendations(gappy(t)).select("title", "priority")


@query(
    "y11_column_issues",
    f"""WITH v AS ({validation_sql(GAPPY, LINEITEM)}) SELECT "column", 'missing' AS issue, null_count AS affected FROM v WHERE completeness_pct < 95
 UNION ALL SELECT "column", 'outliers', outlier_count FROM v WHERE outlier_impact > 5
 UNION ALL SELECT "column", 'type', non_null_count FROM v WHERE NOT type_consistency
 UNION ALL SELECT "column", 'cardinality', unique_count FROM v WHERE data_type = 'object' AND uniqueness_pct > 90""",
)
def _(t):
    return validation.column_issues(gappy(t))


_DATASET_ADVICE = f"""SELECT 'Duplicate rows' AS title, CASE WHEN duplicate_pct > 10 THEN 'High' ELSE 'Medium' END AS priority FROM {_SCORE} WHERE duplicate_rows > 0
 UNION ALL SELECT 'Many missing cells', 'High' FROM {_SCORE} WHERE missing_pct > 20"""


@query("y12_dataset_recommendations", _DATASET_ADVICE)
def _(t):
    return validation.dataset_recommendations(doubled(t)).select("title", "priority")


_DOUBLED_KINDS = {"o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "object", "o_totalprice": "float64", "o_orderdate": "datetime64[ns]", "o_orderpriority": "object"}
_DOUBLED_VALID = validation_sql(DOUBLED, _DOUBLED_KINDS)


@query(
    "y13_priority_counts",
    f"WITH v AS ({_DOUBLED_VALID}) SELECT priority, count(*) AS \"count\" FROM ({_ADVICE} UNION ALL {_DATASET_ADVICE}) GROUP BY 1",
)
def _(t):
    return validation.priority_counts(doubled(t))


@query(
    "y14_audit",
    f"""WITH v AS ({_DOUBLED_VALID}), s AS (SELECT * FROM {_SCORE})
 SELECT 'High' AS priority, 'missing' AS issue, "column", null_count AS affected FROM v WHERE null_count * 100.0 / total_count > 20
 UNION ALL SELECT 'Medium', 'outliers', "column", outlier_count FROM v WHERE outlier_count > total_count * 0.05
 UNION ALL SELECT CASE WHEN duplicate_pct > 10 THEN 'High' ELSE 'Medium' END, 'duplicates', NULL, duplicate_rows FROM s WHERE duplicate_rows > 0""",
)
def _(t):
    return validation.audit(doubled(t)).drop("recommendation")


@query(
    "y15_insights",
    f"""WITH s AS (SELECT * FROM {_SCORE}) SELECT 'orders' AS dataset, section, metric, {r('value')} AS value FROM (
 SELECT 'summary' AS section, 'total_records' AS metric, CAST(total_rows AS DOUBLE) AS value FROM s
 UNION ALL SELECT 'summary', 'total_features', 6 UNION ALL SELECT 'summary', 'completeness_pct', 100 - missing_pct FROM s
 UNION ALL SELECT 'overview', 'missing_values', missing_values FROM s UNION ALL SELECT 'overview', 'duplicate_rows', duplicate_rows FROM s
 UNION ALL SELECT 'insight', 'numeric_features', 3 UNION ALL SELECT 'insight', 'categorical_features', 2
 UNION ALL SELECT 'insight', 'impute_missing_pct', missing_pct FROM s WHERE missing_pct > 5
 UNION ALL SELECT 'insight', 'deduplicate_rows', duplicate_rows FROM s WHERE duplicate_rows > 0)""",
)
def _(t):
    return validation.insights(doubled(t), "orders")


_CUSTOMER = {"c_custkey": "int64", "c_name": "object", "c_nationkey": "int64", "c_mktsegment": "object"}


@query(
    "y16_sample_values",
    union_all(
        f"""SELECT '{c}' AS "column", '{k}' AS data_type, (SELECT count({c}) FROM customer) AS non_null, string_agg(v, '|' ORDER BY v) AS samples
 FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM customer ORDER BY 1 LIMIT 3)"""
        for c, k in _CUSTOMER.items()
    ),
)
def _(t):
    out = validation.sample_values(t.customer.drop("c_acctbal"), 3)
    return out.withColumn("samples", F.concat_ws("|", "samples"))


@query(
    "y17_mixed_types",
    """SELECT 'code' AS "column", count(*) FILTER (p_size > 25) AS numeric_values, count(*) FILTER (p_size <= 25) AS text_values,
 count(*) FILTER (p_size > 25) > 0 AND count(*) FILTER (p_size <= 25) > 0 AS mixed FROM part
 UNION ALL SELECT 'p_name', 0, count(p_name), false FROM part""",
)
def _(t):
    code = F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    return agg.mixed_type_shares(t.part.select("p_name", code.alias("code")))


@query(
    "y18_chart_recommendation",
    """SELECT CAST(row_number() OVER (ORDER BY score DESC, k) AS INTEGER) AS rank, chart, CAST(score AS INTEGER) AS score FROM (
 SELECT 1 AS k, 'Bar Chart' AS chart, 95 AS score FROM (SELECT count(DISTINCT l_linenumber) AS u FROM lineitem) WHERE u < 20
 UNION ALL SELECT 2, 'Pie Chart', 85 FROM (SELECT count(DISTINCT l_linenumber) AS u FROM lineitem) WHERE u < 20
 UNION ALL SELECT 3, 'Donut Chart', 80 FROM (SELECT count(DISTINCT l_linenumber) AS u FROM lineitem) WHERE u <= 10
 UNION ALL SELECT 4, 'Scatter Plot', 95 UNION ALL SELECT 5, 'Line Chart', 90)""",
)
def _(t):
    return validation.recommend_charts(t.lineitem, "l_linenumber", "l_quantity").drop("best_for")


@query(
    "y19_next_steps",
    f"""SELECT 'chart' AS topic, 'histogram of o_orderkey' AS advice UNION ALL SELECT 'chart', 'scatter of o_orderkey and o_custkey'
 UNION ALL SELECT 'chart', 'bar chart of o_orderstatus' UNION ALL SELECT 'model', 'random forest' UNION ALL SELECT 'model', 'automatic model search'
 UNION ALL SELECT 'quality', CASE WHEN q >= 90 THEN 'excellent' WHEN q >= 70 THEN 'good' ELSE 'fair' END FROM {_SCORED}""",
)
def _(t):
    return validation.next_steps(doubled(t))


@query(
    "y20_column_detail",
    f"""WITH v AS ({validation_sql('orders', {'o_orderpriority': 'object'}, 4)})
 SELECT 'record' AS part, 'total_count' AS label, CAST(total_count AS DOUBLE) AS value FROM v UNION ALL SELECT 'record', 'non_null_count', non_null_count FROM v
 UNION ALL SELECT 'record', 'unique_count', unique_count FROM v UNION ALL SELECT 'record', 'completeness_pct', completeness_pct FROM v
 UNION ALL SELECT 'record', 'validity_score', validity_score FROM v UNION ALL SELECT 'record', 'overall_score', overall_score FROM v
 UNION ALL SELECT 'top', o_orderpriority, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""",
)
def _(t):
    return validation.column_detail(t.orders, "o_orderpriority")


@query(
    "y21_type_table",
    union_all(
        f"""SELECT '{c}' AS "column", '{k}' AS data_type, count({c}) AS non_null FROM customer""" for c, k in _CUSTOMER.items()
    ),
)
def _(t):
    return validation.sample_values(t.customer.drop("c_acctbal")).drop("samples")


@query(
    "y22_dataset_validation",
    f"""WITH c AS (SELECT {r('corr(l_quantity, l_extendedprice)', 4)} AS r, count(*) AS n, sum(l_quantity*l_quantity) AS a,
 sum(l_extendedprice*l_extendedprice) AS b, sum(l_quantity*l_extendedprice) AS ab FROM lineitem),
 v AS (SELECT r, 1 / (1 - ab * ab / (a * b)) AS vif FROM c),
 d AS (SELECT (SELECT count(*) FROM lineitem) AS n, count(*) AS k FROM (SELECT DISTINCT l_quantity, l_extendedprice, l_returnflag FROM lineitem)),
 f AS (SELECT max(n) / CAST(min(n) AS DOUBLE) AS ratio FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)),
 u AS (SELECT count(DISTINCT l_quantity) / CAST(count(*) AS DOUBLE) AS uq, count(DISTINCT l_extendedprice) / CAST(count(*) AS DOUBLE) AS ue,
 count(DISTINCT l_returnflag) / CAST(count(*) AS DOUBLE) AS uf FROM lineitem),
 h AS (SELECT (CASE WHEN uq BETWEEN 0.7 AND 0.95 THEN 100 WHEN uq < 0.1 THEN 30 WHEN uq > 0.99 THEN 70 ELSE 80 END
 + CASE WHEN ue BETWEEN 0.7 AND 0.95 THEN 100 WHEN ue < 0.1 THEN 30 WHEN ue > 0.99 THEN 70 ELSE 80 END
 + CASE WHEN uf BETWEEN 0.01 AND 0.1 THEN 100 WHEN uf > 0.8 THEN 30 ELSE 70 END) / 3.0 AS score FROM u)
 SELECT 'null_rate' AS "check", 'table' AS subject, 0.0::DOUBLE AS value, 'ok' AS status
 UNION ALL SELECT 'duplicate_rate', 'table', {r('(n - k) * 100.0 / n', 4)}, CASE WHEN n = k THEN 'ok' WHEN (n - k) * 100.0 / n <= 10 THEN 'warn' ELSE 'bad' END FROM d
 UNION ALL SELECT 'cardinality', 'table', {r('score', 4)}, CASE WHEN score >= 80 THEN 'ok' WHEN score >= 60 THEN 'warn' ELSE 'bad' END FROM h
 UNION ALL SELECT 'imbalance', 'l_returnflag', {r('ratio', 4)}, CASE WHEN ratio > 5 THEN 'significant' WHEN ratio > 2 THEN 'moderate' ELSE 'balanced' END FROM f
 UNION ALL SELECT 'vif', 'l_quantity', {r('vif', 4)}, CASE WHEN vif > 10 THEN 'high' WHEN vif > 5 THEN 'moderate' ELSE 'low' END FROM v
 UNION ALL SELECT 'vif', 'l_extendedprice', {r('vif', 4)}, CASE WHEN vif > 10 THEN 'high' WHEN vif > 5 THEN 'moderate' ELSE 'low' END FROM v
 UNION ALL SELECT 'correlation', 'l_quantity~l_extendedprice', r, 'high' FROM v WHERE abs(r) > 0.8""",
)
def _(t):
    line = t.lineitem.select("l_quantity", "l_extendedprice", "l_returnflag")
    return validation.validate_dataset(line, "l_returnflag")
