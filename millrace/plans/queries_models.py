"""Queries over feature selection, models, evaluation, interpretation and composite plans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.models import attribution, evaluate, interpret, isolation, linear, supervised, unsupervised
from millrace.operators import missing, neighbours, sampling, selection
from millrace.plans import compose
from millrace.plans.catalog import query, r, union_all
from millrace.plans.queries_basic import DOUBLED, GAPPY, NUMBERS, doubled, gappy
from millrace.session import checkpoint_folder, cut_lineage

# --- feature selection ------------------------------------------------------------------------

FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query("v1_drop_correlated", f"SELECT l_quantity, l_discount, {r('l_extendedprice * 2')} AS twice FROM lineitem")
def _(t):
    twice = F.col("l_extendedprice") * 2
    line = t.lineitem.select("l_quantity", "l_discount", twice.alias("twice"), "l_extendedprice")
    return selection.drop_correlated(line, 0.95)


@query("v2_variance_threshold", "SELECT l_quantity, l_returnflag FROM lineitem")
def _(t):
    return selection.keep_varying(t.lineitem.select("l_quantity", "l_discount", "l_tax", "l_returnflag"), 0.01)


def _anova_sql(f):
    return f"""SELECT '{f}' AS feature, {r('(b / (k - 1)) / (w / (n - k))', 3)} AS score FROM (SELECT sum(c * (m - g) * (m - g)) AS b, sum(q) AS w, count(*) AS k, sum(c) AS n
 FROM (SELECT l_returnflag, count({f}) AS c, avg({f}) AS m, var_pop({f}) * count({f}) AS q FROM lineitem GROUP BY 1), (SELECT avg({f}) AS g FROM lineitem))"""


@query("v3_f_classification", union_all(_anova_sql(f) for f in [*FEATURES, "l_extendedprice"]), digits=3)
def _(t):
    return selection.f_scores(t.lineitem, [*FEATURES, "l_extendedprice"], "l_returnflag", "classification")


@query(
    "v3_f_regression",
    union_all(
        f"SELECT '{f}' AS feature, {r(f'c * c / (1 - c * c) * (n - 2)', 2)} AS score FROM (SELECT corr({f}, l_extendedprice) AS c, count(*) AS n FROM lineitem)"
        for f in FEATURES
    ),
    digits=2,
)
def _(t):
    return selection.f_scores(t.lineitem, FEATURES, "l_extendedprice", "regression")


def _mi_sql(f, bins=4):
    cuts = [f"(SELECT quantile_cont({f}, {i / bins}) FROM lineitem)" for i in range(1, bins)]
    x = "CASE " + " ".join(f"WHEN {f} <= {c} THEN {i}" for i, c in enumerate(cuts)) + f" ELSE {bins - 1} END"
    return f"""SELECT '{f}' AS feature, {r('greatest(sum(n * ln(n * t / (nx * CAST(ny AS DOUBLE)))) / any_value(t), 0)', 6)} AS score FROM (SELECT n, sum(n) OVER (PARTITION BY x) AS nx,
 sum(n) OVER (PARTITION BY y) AS ny, CAST(sum(n) OVER () AS DOUBLE) AS t FROM (SELECT {x} AS x, l_linenumber AS y, count(*) AS n FROM lineitem GROUP BY 1, 2))"""


@query("v4_mutual_information", union_all(_mi_sql(f) for f in ("l_quantity", "l_extendedprice")), digits=6)
def _(t):
    return selection.mutual_information(t.lineitem, ["l_quantity", "l_extendedprice"], "l_linenumber", "classification", bins=4)


def _psi_sql(n):
    z = f"(1.0 / (({n} + 10.0) * ({n} + 10.0)))"
    series = f"ln({n} + 10.0) - 0.5 / ({n} + 10.0) - {z} * (1.0 / 12 - {z} * (1.0 / 120 - {z} * (1.0 / 252 - {z} * (1.0 / 240 - {z} / 132.0))))"
    return f"({series} - " + " - ".join(f"1.0 / ({n} + {i})" for i in range(10)) + ")"


def _near_sql(feature, x, y, numbers):
    """Every customer against every other: the radius, then the rows within it on the axes."""
    same = "true" if numbers else "a.y = b.y"
    gap = "greatest(abs(a.x - b.x), abs(a.y - b.y))" if numbers else "abs(a.x - b.x)"
    inside = lambda c: f"count(*) FILTER (abs(b.{c} - a.{c}) <= greatest(a.r - (abs(a.{c}) + a.r) * 1e-12, 0))"
    many = f", {inside('y')} AS my" if numbers else ""
    last = _psi_sql("my") if numbers else _psi_sql("ny")
    return f"""SELECT '{feature}' AS feature, {r(f"greatest(avg({_psi_sql('kk')} - {_psi_sql('mx')} - {last}) + {_psi_sql('CAST(count(*) AS DOUBLE)')}, 0)")} AS score FROM (
 WITH p AS (SELECT c_custkey AS i, {x} AS x, {y} AS y FROM customer),
 c AS (SELECT *, count(*) OVER ({'' if numbers else 'PARTITION BY y'}) AS ny FROM p),
 a AS (SELECT a.i, a.x, a.y, a.ny, least(3, a.ny - 1) AS kk, list_sort(list({gap}))[least(3, a.ny - 1) + 1] AS r FROM c a JOIN c b ON {same} WHERE a.ny > 1 GROUP BY a.i, a.x, a.y, a.ny)
 SELECT a.i, a.kk, a.ny, {inside('x')} AS mx{many} FROM a, c b WHERE b.ny > 1 GROUP BY a.i, a.kk, a.ny)"""


@query("v4_neighbour_information_classes", _near_sql("c_acctbal", "c_acctbal", "c_mktsegment", False))
def _(t):
    return selection.neighbour_information(t.customer, ["c_acctbal"], "c_mktsegment", "classification")


@query(
    "v4_neighbour_information_numbers",
    _near_sql("c_nationkey", "(c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER ()", "(c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER ()", True),
)
def _(t):
    return selection.neighbour_information(t.customer, ["c_nationkey"], "c_acctbal", "regression")


@query("v5_forest_importance")
def _(t):
    return selection.forest_importance(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "regression", trees=10)


@query("v6_recursive_elimination")
def _(t):
    return selection.recursive_elimination(t.lineitem, FEATURES, "l_extendedprice", "regression", 1, trees=5)


#: line items with what they earn
EARNED = "(SELECT l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem)"
EARNERS = ["l_extendedprice", "l_discount", "l_tax"]


def earned(t):
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select(*EARNERS, revenue.alias("revenue"))


for _id, _method in (("v7_correlation_selection", "correlation"), ("v9_select_features", "f_statistic")):

    @query(_id, f"SELECT l_extendedprice, {r('revenue')} AS revenue FROM {EARNED}")
    def _(t, method=_method):
        return selection.select_features(earned(t), EARNERS, "revenue", method, 1, "regression")[0]


@query(
    "v8_score_table",
    union_all(
        f"""SELECT '{f}' AS feature, {r(f'abs(corr({f}, revenue))')} AS score, {str(f == 'l_extendedprice').lower()} AS selected FROM {EARNED}""" for f in EARNERS
    ),
)
def _(t):
    return selection.select_features(earned(t), EARNERS, "revenue", "correlation", 1, "regression")[1]


# --- isolation forest -------------------------------------------------------------------------


@query("x6_isolation_forest")
def _(t):
    return isolation.detect(t.events.select("event_id", "value"), ["value"], 0.1)


@query("x12_clip_isolated")
def _(t):
    return isolation.clip_isolated(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"])


@query("l18_anomalies")
def _(t):
    return isolation.detect(t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), ["o_totalprice", "o_custkey"], 0.05)


@query("l18_anomaly_count", "SELECT count(*) AS n, true AS within_share FROM orders")
def _(t):
    found = isolation.detect(t.orders, ["o_totalprice"], 0.05)
    # ties at the limit stay below it, so never more than the asked share is marked
    n = F.count(F.lit(1))
    return found.agg(n.alias("n"), (F.count_if("is_anomaly") <= F.ceil(n * 0.05)).alias("within_share"))


# --- models -----------------------------------------------------------------------------------


def graded(t):
    """documents with a quality label and simple features of their text.

    Models pass over their rows many times, so the texts are read once and the features kept; texts are not shuffled.
    """
    words = F.size(F.split("text", r"\s+"))
    lines = F.size(F.split("text", "\n"))
    digits = F.length(F.regexp_replace("text", r"\D+", ""))
    told = t.documents.select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"), words.cast("double").alias("words"),
        lines.cast("double").alias("lines"), (digits / F.greatest(F.length("text"), F.lit(1))).alias("digit_share"),
    )
    return cut_lineage(told.join(t.labels, "doc_id").select("doc_id", "lang", "n_chars", "words", "lines", "digit_share", "quality"))


def valued(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *NUMBERS)


LINE = ["l_orderkey", "l_linenumber", "l_partkey"]


def _trained_rows(t, models):
    return supervised.results_table(t.spark, models).select(
        "model_name", "task_type", "target_column", F.explode("metrics").alias("metric", "value")
    )


def _classifiers(name, algorithms, features=None, params=None):
    @query(name)
    def _(t):
        config = supervised.Config(target="quality", features=tuple(features or ()), task="classification")
        return _trained_rows(t, supervised.compare(graded(t), config, algorithms, ["doc_id"], params))


def _regressors(name, algorithms, params=None):
    @query(name)
    def _(t):
        config = supervised.Config(target="l_extendedprice", features=tuple(FEATURES), task="regression")
        return _trained_rows(t, supervised.compare(valued(t), config, algorithms, LINE, params))


NUMERIC = ["n_chars", "words", "lines", "digit_share"]
_classifiers("l4_logistic_regression", ["logistic_regression"])
_classifiers("l6_tree_classifiers", ["random_forest", "decision_tree"], params={"random_forest": {"numTrees": 10}})
_classifiers("l7_boosted_classifier", ["gradient_boosting"], params={"gradient_boosting": {"maxIter": 5}})
_classifiers("l8_svm", ["svm"], params={"svm": {"maxIter": 20}})
_classifiers("l9_naive_bayes", ["naive_bayes"], NUMERIC)
_classifiers("l10_mlp", ["mlp"], NUMERIC, {"mlp": {"maxIter": 20}})
_classifiers("l11_adaboost", ["adaboost", "bagging", "extra_trees"], NUMERIC, {"adaboost": {"rounds": 5}, "bagging": {"numTrees": 5}, "extra_trees": {"numTrees": 5}})
_classifiers("l12_discriminants", ["lda", "qda"], NUMERIC)
_regressors("l5_linear_models", ["linear_regression", "ridge", "lasso", "elastic_net", "huber"])
_regressors("l7_boosted_regressor", ["xgboost"], {"xgboost": {"maxIter": 3}})
_regressors("l3_model_comparison", ["linear_regression", "decision_tree"])


@query("l1_train", None)
def _(t):
    config = supervised.Config(target="quality")
    return _trained_rows(t, supervised.compare(graded(t), config, ["random_forest"], ["doc_id"], {"random_forest": {"numTrees": 10}}))


@query(
    "l2_model_preparation",
    f"SELECT {r('coalesce(l_discount, (SELECT avg(l_discount) FROM ' + GAPPY + '))')} AS l_discount, l_linestatus FROM {GAPPY}",
)
def _(t):
    return supervised.prepare(gappy(t).select("l_discount", "l_linestatus"), supervised.Config("l_linestatus"))


@query(
    "l5_least_squares",
    f"SELECT {r('regr_slope(l_extendedprice, l_quantity)', 3)} AS slope, {r('regr_intercept(l_extendedprice, l_quantity)', 2)} AS intercept FROM lineitem",
    digits=3,
)
def _(t):
    fit = linear.ordinary(t.lineitem, ["l_quantity"], "l_extendedprice")
    return t.spark.createDataFrame([(fit.weights[0], round(fit.intercept, 2))], "slope double, intercept double")


def _lda_sql():
    """Two classes, one feature: score = prior - log(v)/2 - (x - m)^2 / (2 v) with pooled variance v."""
    return """WITH c AS (SELECT l_linestatus AS k, avg(l_extendedprice) AS m, count(*) AS n, var_pop(l_extendedprice) * count(*) AS q FROM lineitem GROUP BY 1),
 v AS (SELECT sum(q) / sum(n) AS v, sum(n) AS t FROM c)
 SELECT l_orderkey, l_linenumber, arg_max(k, ln(n / CAST(t AS DOUBLE)) - (l_extendedprice - m) * (l_extendedprice - m) / (2 * v)) AS prediction
 FROM lineitem, c, v GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"""


@query("l12_lda_predictions", _lda_sql())
def _(t):
    fitted = supervised.train(t.lineitem.select("l_extendedprice", "l_linestatus"), "l_linestatus", "lda", "classification", ["l_extendedprice"])
    return fitted.predict(t.lineitem).select("l_orderkey", "l_linenumber", "prediction")


@query("l13_bayesian_ridge")
def _(t):
    fit = linear.bayesian_ridge(t.lineitem, FEATURES, "l_extendedprice")
    rows = list(zip(fit.features, fit.weights)) + [("intercept", fit.intercept)]
    return t.spark.createDataFrame(rows, "term string, weight double")


@query(
    "l14_knn_regression",
    f"""SELECT s_suppkey, {r('avg(v)')} AS prediction FROM (SELECT s.s_suppkey, c.c_acctbal AS v, row_number() OVER (PARTITION BY s.s_suppkey
 ORDER BY sqrt((s.s_nationkey - c.c_nationkey) * (s.s_nationkey - c.c_nationkey) * 1.0 + (s.s_acctbal - c.c_acctbal) * (s.s_acctbal - c.c_acctbal)), c.c_acctbal) AS rn
 FROM supplier s, customer c) WHERE rn <= 5 GROUP BY 1""",
)
def _(t):
    people = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_acctbal").alias("y"))
    rows = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return neighbours.knn_predict(people, rows, ["nation", "balance"], "y", 5, "regression").select("s_suppkey", "prediction")


@query("l14_knn_classifier")
def _(t):
    config = supervised.Config(target="quality", features=tuple(NUMERIC), task="classification")
    return _trained_rows(t, supervised.compare(graded(t), config, ["knn"], ["doc_id"]))


@query("l15_kmeans")
def _(t):
    rows, _ = unsupervised.kmeans(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"], 3)
    return rows


@query("l16_density_clusters")
def _(t):
    flat = t.embeddings.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return unsupervised.dbscan(flat, ["x", "y"], 0.02, 5)


@query(
    "l16_density_core_rows",
    """WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
 c AS (SELECT a.vec_id FROM p a, p b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.02 * 0.02 GROUP BY 1 HAVING count(*) >= 5)
 SELECT p.vec_id, NOT EXISTS (SELECT 1 FROM p q JOIN c ON c.vec_id = q.vec_id WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 0.02 * 0.02) AS noise FROM p""",
)
def _(t):
    flat = t.embeddings.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return unsupervised.dbscan(flat, ["x", "y"], 0.02, 5).select("vec_id", (F.col("cluster") < 0).alias("noise"))


@query(
    "l17_explained_variance",
    f"""WITH c AS (SELECT var_samp(l_quantity) AS a, var_samp(l_discount * 100) AS d, covar_samp(l_quantity, l_discount * 100) AS b FROM lineitem),
 e AS (SELECT (a + d) / 2 AS m, sqrt((a - d) * (a - d) / 4 + b * b) AS s FROM c)
 SELECT CAST(1 AS INTEGER) AS component, {r('(m + s) / (2 * m)')} AS explained FROM e UNION ALL SELECT 2, {r('(m - s) / (2 * m)')} FROM e""",
)
def _(t):
    line = t.lineitem.select("l_quantity", (F.col("l_discount") * 100).alias("d"))
    return unsupervised.principal_components(line, ["l_quantity", "d"], 2)[1]


@query("l17_components")
def _(t):
    parts = {f"e{i}": F.col("embedding")[i].cast("double") for i in range(4)}
    return unsupervised.principal_components(t.embeddings.select("vec_id", *[v.alias(n) for n, v in parts.items()]), list(parts), 2)[0].select("vec_id", "pc1", "pc2")


@query("l19_ensembles")
def _(t):
    data, unseen = sampling.split(graded(t).select("doc_id", *NUMERIC, "quality"), 0.3, ["doc_id"])
    names = ["logistic_regression", "decision_tree"]
    members = [supervised.train(data.drop("doc_id"), "quality", a, "classification", NUMERIC) for a in names]
    stacked = supervised.stack(data, "quality", names, ["doc_id"], 3, "classification", NUMERIC)
    vote = supervised.ensemble_comparison(members, lambda d: supervised.voting(members, d, ["doc_id"]), unseen, "voting")
    return vote.unionByName(supervised.ensemble_comparison(members, stacked.predict, unseen, "stacking").where("model = 'stacking'"))


@query("l20_search")
def _(t):
    data = graded(t).select("doc_id", *NUMERIC, "quality")
    return supervised.tune(data, "quality", "decision_tree", ["doc_id"], {"maxDepth": [2, 4]}, 3)[1]


@query("l21_cross_validation")
def _(t):
    data = graded(t).select("doc_id", *NUMERIC, "quality")
    return supervised.cv_summary(supervised.cross_validate(data, "quality", "decision_tree", 3, ["doc_id"]))


@query("l22_best_model")
def _(t):
    config = supervised.Config(target="quality", features=tuple(NUMERIC), task="classification")
    models = supervised.compare(graded(t), config, ["logistic_regression", "decision_tree", "naive_bayes"], ["doc_id"])
    return _trained_rows(t, [supervised.best_of(models)])


@query("l23_batch_scoring", f"SELECT l_orderkey, l_linenumber, {r('(SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem) + (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) * l_quantity', 2)} AS prediction FROM lineitem", digits=2)
def _(t):
    fitted = supervised.train(t.lineitem.select("l_quantity", "l_extendedprice"), "l_extendedprice", "linear_regression", "regression", ["l_quantity"])
    path = f"{checkpoint_folder(t.spark)}/model-{uuid.uuid4().hex}"
    supervised.save_model(fitted, path)
    return supervised.score_saved(path, t.lineitem).select("l_orderkey", "l_linenumber", "prediction")


@query(
    "l24_problem_definition",
    """SELECT 'classification' AS task, CAST(quality AS VARCHAR) AS item, CAST(count(*) AS DOUBLE) AS value FROM labels GROUP BY quality""",
)
def _(t):
    return supervised.problem_summary(t.labels, "quality")


@query("l25_single_training")
def _(t):
    config = supervised.Config(target="l_extendedprice", features=tuple(FEATURES), task="regression", test_share=0.3)
    return _trained_rows(t, supervised.compare(valued(t), config, ["bayesian_ridge"], LINE))


# --- evaluation -------------------------------------------------------------------------------

#: toxic as predicted by low quality
GUESS = "(SELECT CAST(toxic AS VARCHAR) AS label, CAST(1 - quality AS VARCHAR) AS prediction FROM labels)"


def guessed(t):
    return t.labels.select(F.col("toxic").cast("string").alias("label"), (1 - F.col("quality")).cast("string").alias("prediction"))


_CLASSES = f"""SELECT c AS class, coalesce(h / CAST(nullif(g, 0) AS DOUBLE), 0) AS p, coalesce(h / CAST(nullif(s, 0) AS DOUBLE), 0) AS r, s FROM (SELECT c, (SELECT count(*) FROM {GUESS} WHERE label = c AND prediction = c) AS h,
 (SELECT count(*) FROM {GUESS} WHERE prediction = c) AS g, (SELECT count(*) FROM {GUESS} WHERE label = c) AS s FROM (SELECT label AS c FROM {GUESS} UNION SELECT prediction FROM {GUESS}))"""
_F1 = "coalesce(2 * p * r / nullif(p + r, 0), 0)"


@query(
    "b1_classification_metrics",
    f"""SELECT {r('sum(r * s) / sum(s)')} AS accuracy, {r('sum(p * s) / sum(s)')} AS "precision", {r('sum(r * s) / sum(s)')} AS recall, {r(f'sum({_F1} * s) / sum(s)')} AS f1 FROM ({_CLASSES})""",
)
def _(t):
    return evaluate.classification_metrics(guessed(t))


@query("b1_class_report", f"SELECT class, {r('p')} AS \"precision\", {r('r')} AS recall, {r(_F1)} AS f1, s AS support FROM ({_CLASSES})")
def _(t):
    return evaluate.class_report(guessed(t))


@query("b2_confusion_matrix", f"SELECT label AS actual, count(*) FILTER (prediction = '0') AS \"0\", count(*) FILTER (prediction = '1') AS \"1\" FROM {GUESS} GROUP BY 1")
def _(t):
    return evaluate.confusion_matrix(guessed(t))


EVENT_SCORES = "(SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, value AS s FROM events)"


def event_scores(t):
    return t.events.select((F.col("event_type") == "purchase").cast("int").alias("y"), F.col("value").alias("s"))


@query(
    "b3_roc_curve",
    f"""SELECT {r('s')} AS threshold, pos, neg, {r('sum(neg) OVER w / (SELECT CAST(count(*) AS DOUBLE) FROM ' + EVENT_SCORES + ' WHERE y = 0)')} AS fpr,
 {r('sum(pos) OVER w / (SELECT CAST(count(*) AS DOUBLE) FROM ' + EVENT_SCORES + ' WHERE y = 1)')} AS tpr FROM (SELECT s, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM {EVENT_SCORES} GROUP BY 1) WINDOW w AS (ORDER BY s DESC)""",
)
def _(t):
    return evaluate.roc_curve(event_scores(t), "y", "s", 1)


@query(
    "b3_roc_auc",
    f"""SELECT {r('(sum(rk) FILTER (y = 1) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * CAST(any_value(n) AS DOUBLE))')} AS auc FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk,
 count(*) FILTER (y = 1) OVER () AS p, count(*) FILTER (y = 0) OVER () AS n FROM {EVENT_SCORES})""",
)
def _(t):
    return evaluate.roc_auc(event_scores(t), "y", "s", 1)


_ERR = "(SELECT l_extendedprice AS y, 1500 * l_quantity AS p FROM lineitem)"


@query(
    "b4_regression_metrics",
    f"""SELECT {r('avg((y - p) * (y - p))', 0)} AS mse, {r('sqrt(avg((y - p) * (y - p)))', 0)} AS rmse, {r('avg(abs(y - p))', 0)} AS mae, {r('1000 * (1 - avg((y - p) * (y - p)) / var_pop(y))', 0)} AS r2_permille FROM {_ERR}""",
    digits=0,
)
def _(t):
    rows = t.lineitem.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
    out = evaluate.regression_metrics(rows)
    return out.select("mse", "rmse", "mae", (F.col("r2") * 1000).alias("r2_permille"))


@query("b5_residuals", f"SELECT l_orderkey, l_linenumber, {r('l_extendedprice')} AS actual, {r('1500 * l_quantity')} AS predicted, {r('l_extendedprice - 1500 * l_quantity')} AS residual FROM lineitem")
def _(t):
    rows = t.lineitem.withColumn("prediction", F.col("l_quantity") * 1500)
    return evaluate.residuals(rows, "l_extendedprice", "prediction", None, ["l_orderkey", "l_linenumber"])


@query(
    "b6_calinski_harabasz",
    f"""SELECT k AS clusters, {r('(b / (k - 1)) / (w / (n - k))', 3)} AS calinski_harabasz FROM (SELECT count(*) AS k, sum(c) AS n, sum(c * (m - g) * (m - g)) AS b, sum(q) AS w FROM
 (SELECT c_nationkey, count(*) AS c, avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS q FROM customer GROUP BY 1), (SELECT avg(c_acctbal) AS g FROM customer))""",
    digits=3,
)
def _(t):
    return evaluate.cluster_quality(t.customer, ["c_acctbal"], "c_nationkey").drop("silhouette")


@query(
    "b6_silhouette",
    f"""WITH d AS (SELECT a.c_custkey AS id, a.c_nationkey AS own, b.c_nationkey AS other, sum((a.c_acctbal - b.c_acctbal) * (a.c_acctbal - b.c_acctbal)) AS s, count(*) AS n
 FROM customer a, customer b GROUP BY 1, 2, 3),
 p AS (SELECT id, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY id)
 SELECT (SELECT count(DISTINCT c_nationkey) FROM customer) AS clusters, {r('avg(CASE WHEN a IS NULL THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END)')} AS silhouette FROM p""",
)
def _(t):
    return evaluate.cluster_quality(t.customer, ["c_acctbal"], "c_nationkey").drop("calinski_harabasz")


# --- interpretation ---------------------------------------------------------------------------


@query("i1_feature_importance")
def _(t):
    data = graded(t).drop("doc_id")
    fitted = supervised.train(data, "quality", "random_forest", "classification", params={"numTrees": 10})
    return interpret.cumulative_importance(fitted.importances().withColumnRenamed("score", "importance"))


@query(
    "i2_partial_dependence",
    f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem),
 q AS (SELECT quantile_cont(l_quantity, 0.05) AS lo, quantile_cont(l_quantity, 0.95) AS hi FROM lineitem)
 SELECT {r('lo + (hi - lo) * i / 4.0')} AS value, {r('b + a * (lo + (hi - lo) * i / 4.0)', 2)} AS mean_prediction FROM f, q, range(5) g(i)""",
)
def _(t):
    line = t.lineitem.select("l_quantity", "l_extendedprice")
    fitted = supervised.train(line, "l_extendedprice", "linear_regression", "regression", ["l_quantity"])
    out = interpret.partial_dependence(fitted, line, "l_quantity", 5)
    return out.withColumn("mean_prediction", F.round("mean_prediction", 2))


@query("i3_shapley")
def _(t):
    data = graded(t).select("doc_id", *NUMERIC, "quality")
    fitted = supervised.train(data.drop("doc_id"), "quality", "decision_tree", "classification", NUMERIC)
    return interpret.global_attribution(interpret.shapley(fitted, data, ["doc_id"], 4, 20))


@query("i3_tree_attribution")
def _(t):
    data = graded(t).select("doc_id", *NUMERIC, "quality")
    fitted = supervised.train(data.drop("doc_id"), "quality", "random_forest", "classification", NUMERIC, {"numTrees": 10})
    return interpret.global_attribution(attribution.tree_shapley(fitted, data, ["doc_id"]))


@query("i4_local_surrogate")
def _(t):
    data = graded(t).select(*NUMERIC, "quality")
    fitted = supervised.train(data, "quality", "logistic_regression", "classification", NUMERIC)
    row = data.orderBy(*NUMERIC).first().asDict()
    return interpret.local_surrogate(fitted, data, row, 2000)


@query("i5_model_registry")
def _(t):
    config = supervised.Config(target="quality", features=tuple(NUMERIC), task="classification")
    models = supervised.compare(graded(t), config, ["decision_tree"], ["doc_id"])
    return interpret.registry_table(t.spark, {"tree": models[0]})


# --- composite plans --------------------------------------------------------------------------


@query("r1_auto_clean")
def _(t):
    return compose.auto_clean(t.part.drop("p_partkey"))[0]


#: orders with repeated rows, gaps, blanks around the text, and a number written as text
ROUGH = f"""(SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, '  ' || nullif(o_orderstatus, 'P') || ' ' AS o_orderstatus,
 ' ' || o_custkey AS o_custkey FROM {DOUBLED})"""


def rough(t):
    d = doubled(t)
    open_ = F.col("o_orderstatus") == "P"
    status = F.concat(F.lit("  "), F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit(" "))
    return d.select(
        "o_orderkey", F.when(~open_, F.col("o_totalprice")).alias("o_totalprice"), status.alias("o_orderstatus"),
        F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("o_custkey"),
    )


@query(
    "r2_quick_clean",
    f"""WITH d AS (SELECT DISTINCT * FROM {ROUGH}) SELECT o_orderkey, {r('coalesce(o_totalprice, (SELECT median(o_totalprice) FROM d))', 3)} AS o_totalprice,
 trim(coalesce(o_orderstatus, (SELECT o_orderstatus FROM d WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))) AS o_orderstatus, CAST(trim(o_custkey) AS DOUBLE) AS o_custkey FROM d""",
    digits=3,
)
def _(t):
    return compose.quick_clean(rough(t))


#: line items with signed prices, zero lots, gaps, copies and dates as text
SIGNED = """(SELECT l_orderkey, CASE WHEN l_discount > 0.08 THEN -l_extendedprice ELSE l_extendedprice END AS price, CASE WHEN l_quantity > 45 THEN 0 ELSE l_quantity END AS quantity,
 lower(l_returnflag) || 'x' AS flag, strftime(l_shipdate, '%Y-%m-%d') AS ship_date FROM lineitem)"""


@query(
    "r3_auto_fix",
    f"""WITH a AS (SELECT l_orderkey, abs(price) AS price, quantity, flag, ship_date FROM {SIGNED} WHERE quantity <> 0 OR quantity IS NULL),
 q AS (SELECT quantile_cont(price, 0.25) AS p1, quantile_cont(price, 0.75) AS p3 FROM a)
 SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS l_orderkey, {r('least(greatest(price, p1 - 3 * (p3 - p1)), p3 + 3 * (p3 - p1))', 2)} AS price, {r('quantity')} AS quantity, upper(flag[1]) || flag[2:] AS flag, CAST(ship_date AS TIMESTAMP) AS ship_date FROM a, q""",
    digits=2,
)
def _(t):
    price = F.when(F.col("l_discount") > 0.08, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    line = t.lineitem.select(
        "l_orderkey", price.alias("price"), F.when(F.col("l_quantity") > 45, 0.0).otherwise(F.col("l_quantity")).alias("quantity"),
        F.concat(F.lower("l_returnflag"), F.lit("x")).alias("flag"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_date"),
    )
    return compose.auto_fix(line)[0]


@query(
    "r3_auto_fix_report",
    """SELECT CAST(2 AS INTEGER) AS step, 'rows with a zero amount' AS action, count(*) FILTER (l_quantity = 0 OR l_extendedprice = 0) AS affected FROM lineitem
 UNION ALL SELECT 5, 'duplicate rows', (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (l_orderkey, l_partkey, l_suppkey) FROM lineitem))
 UNION ALL SELECT 7, 'date columns', 1""",
)
def _(t):
    return compose.auto_fix(t.lineitem.drop("l_orderkey", "l_partkey", "l_suppkey"))[1]


@query("r4_prepare_features")
def _(t):
    return compose.prepare_features(gappy(t).select(*NUMBERS, "l_returnflag", "l_linestatus"), "l_linestatus")


@query(
    "r5_prepare_for_ml",
    f"""SELECT {r('(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER ()')} AS l_quantity, CAST(l_returnflag = 'N' AS INTEGER) AS "l_returnflag_N", CAST(l_returnflag = 'R' AS INTEGER) AS "l_returnflag_R",
 CAST(l_linestatus = 'O' AS INTEGER) AS l_linestatus FROM lineitem""",
)
def _(t):
    return compose.prepare_for_ml(t.lineitem.select("l_quantity", "l_returnflag", "l_linestatus"))[0]


@query("r6_auto_train")
def _(t):
    data = graded(t)
    return compose.auto_train(data, "quality", ["doc_id"], trees=10)[1]


_R7 = {
    "drop": f"SELECT l_quantity, l_discount FROM {GAPPY} WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL",
    "mean": f"SELECT {r('coalesce(l_quantity, (SELECT avg(l_quantity) FROM ' + GAPPY + '))')} AS l_quantity, {r('coalesce(l_discount, (SELECT avg(l_discount) FROM ' + GAPPY + '))')} AS l_discount FROM {GAPPY}",
}
for _how, _sql in _R7.items():

    @query(f"r7_missing_{_how}", _sql)
    def _(t, how=_how):
        return missing.handle_missing(gappy(t).select("l_quantity", "l_discount"), how)
