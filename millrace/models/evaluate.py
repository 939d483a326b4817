"""Metrics from aggregates over (label, prediction) tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col, small_table
from millrace.operators.ordering import running_sums
from millrace.operators.sampling import sample_rows
from millrace.operators.stats import aggregate_in_jobs


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, count)."""
    return df.groupBy(col(label).cast("string").alias("actual"), col(prediction).cast("string").alias("predicted")).agg(
        F.count(F.lit(1)).alias("count")
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    from millrace.operators.encoding import categories

    table = confusion(df, label, prediction)
    names = categories(table, "predicted")
    return table.groupBy("actual").pivot("predicted", names).agg(F.sum("count")).na.fill(0)


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts (one row per pair of classes)."""
    table = confusion(df, label, prediction)
    actual = table.groupBy(F.col("actual").alias("class")).agg(F.sum("count").alias("support"))
    predicted = table.groupBy(F.col("predicted").alias("class")).agg(F.sum("count").alias("guessed"))
    hits = table.where("actual = predicted").select(F.col("actual").alias("class"), F.col("count").alias("hits"))
    both = actual.join(predicted, "class", "full").join(hits, "class", "left").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    out = both.withColumns({"precision": ratio("hits", "guessed"), "recall": ratio("hits", "support")})
    p, r = F.col("precision"), F.col("recall")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return out.select("class", "precision", "recall", f1.alias("f1"), "support")


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    w = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    report = class_report(df, label, prediction)
    return report.agg(
        w("recall").alias("accuracy"), w("precision").alias("precision"), w("recall").alias("recall"), w("f1").alias("f1")
    )


def roc_curve(df: DataFrame, label: str, score: str, positive, rows_per_chunk: int | None = None) -> DataFrame:
    """False and true positive rate at every distinct score, from the highest down.

    Equal scores are counted before the order is built, and the running counts go in chunks.
    """
    hit = (col(label) == F.lit(positive)).cast("bigint")
    counts = df.groupBy(col(score).alias("threshold")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    counts = counts.withColumn("__down", -F.col("threshold"))
    out = running_sums(counts, {"tp": "pos", "fp": "neg"}, ["__down"], rows_per_chunk)
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    rate = lambda c, t: F.try_divide(F.col(c).cast("double"), F.lit(float(t or 0)))
    return out.select("threshold", "pos", "neg", rate("fp", totals["n"]).alias("fpr"), rate("tp", totals["p"]).alias("tpr"))


def roc_auc(df: DataFrame, label: str, score: str, positive, rows_per_chunk: int | None = None) -> DataFrame:
    """Area under the ROC curve: each negative wins against the positives above it, and half of its ties."""
    curve = roc_curve(df, label, score, positive, rows_per_chunk)
    totals = curve.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    share = F.col("tpr") - F.col("pos") / F.lit(2.0 * (totals["p"] or 1))
    return curve.agg((F.sum(F.col("neg") * share) / F.lit(float(totals["n"] or 1))).alias("auc"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    e = col(label) - col(prediction)
    mse = F.avg(e * e)
    return df.agg(
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - mse / F.var_pop(col(label))).alias("r2")
    )


def residuals(df: DataFrame, label: str, prediction: str, limit: int | None = None, key: Sequence[str] = ()) -> DataFrame:
    """Actual, predicted and residual; with ``limit``, a repeatable sample for plotting."""
    out = sample_rows(df, limit, key) if limit else df
    return out.select(
        *[col(k) for k in key],
        col(label).alias("actual"),
        col(prediction).alias("predicted"),
        (col(label) - col(prediction)).alias("residual"),
    )


def cluster_quality(df: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """Silhouette with squared distances (from cluster sums, no pairs) and the Calinski-Harabasz index."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    data = df.select(*[col(f).cast("double").alias(f) for f in features], col(cluster).cast("int").alias("__c")).dropna()
    groups = data.groupBy("__c").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.var_pop(f).alias(f"v{i}") for i, f in enumerate(features)],
    )
    means = aggregate_in_jobs(data, [F.avg(f).alias(f"m{i}") for i, f in enumerate(features)])
    between = sum((F.col(f"m{i}") - F.lit(means[f"m{i}"])) ** 2 for i in range(len(features)))
    within = sum(F.col(f"v{i}") for i in range(len(features)))
    got = groups.agg(
        F.sum(F.col("n") * between).alias("b"), F.sum(F.col("n") * within).alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")
    ).first()
    k, n = got["k"], got["n"]
    ch = (got["b"] / (k - 1)) / (got["w"] / (n - k)) if k > 1 and got["w"] else None
    vectors = VectorAssembler(inputCols=list(features), outputCol="__x").transform(data)
    silhouette = ClusteringEvaluator(featuresCol="__x", predictionCol="__c").evaluate(vectors) if k > 1 else None
    return small_table(df.sparkSession, [(k, silhouette, ch)], "clusters bigint, silhouette double, calinski_harabasz double")


def summarise_scores(scores: Sequence[float]) -> tuple[float, float]:
    return float(np.mean(scores)), float(np.std(scores))
