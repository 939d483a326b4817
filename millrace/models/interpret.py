"""Interpretation of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cumulative_importance(importances: DataFrame, share: float = 0.95) -> DataFrame:
    """(feature, importance) ranked, with the running share and which are needed to reach ``share``.

    One row per feature of a model, so the ranking window is small.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")
    rows = order.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("importance").over(Window.partitionBy(F.lit(0)))
    out = importances.withColumns(
        {"rank": F.row_number().over(order).cast("bigint"), "cumulative": F.sum("importance").over(rows) / total}
    )
    before = out["cumulative"] - out["importance"] / total
    return out.withColumn("needed", F.round(before, 12) < F.lit(share))


def partial_dependence(trained, df: DataFrame, feature: str, points: int = 20, class_index: int = 1) -> DataFrame:
    """Mean prediction with one feature set to each value of a grid between its 5 % and 95 % quantiles.

    Text features use their categories. Each row is scored once per grid value, in one pass.
    """
    from millrace.functions.semantics import numeric_columns
    from millrace.operators.encoding import categories
    from millrace.operators.stats import exact_quantiles

    if feature in numeric_columns(df):
        low, high = exact_quantiles(df, [feature], [0.05, 0.95])[feature]
        grid = sorted({low + (high - low) * i / (points - 1) for i in range(points)})
    else:
        grid = categories(df, feature)
    spread = df.withColumn("__grid", F.explode(F.array(*[F.lit(g) for g in grid]))).withColumn(feature, F.col("__grid"))
    scored = trained.predict(spread)
    return scored.groupBy(F.col("__grid").alias("value")).agg(F.avg(_output(trained, class_index)).alias("mean_prediction"))


def _output(trained, class_index: int):
    return F.get("probability", F.lit(class_index)) if trained.labels else F.col("prediction")


def shapley(trained, df: DataFrame, key: list[str], permutations: int = 10, background: int = 100, class_index: int = 1) -> DataFrame:
    """Sampled Shapley values (Strumbelj and Kononenko 2014): ``key``, feature, contribution.

    Per row and permutation, a feature's contribution is the change of the prediction when it joins
    those before it, the others taken from a background row. The background is a sample of fixed size;
    order and background row come from hashes of the row key, so a re-run gives the same values.
    """
    from millrace.functions.semantics import col
    from millrace.operators.sampling import sample_rows

    features = list(trained.features)
    fields = {f.name: f.dataType.simpleString() for f in df.select(*[col(f) for f in features]).schema.fields}
    drawn = sample_rows(df, background, key).select(*[col(f) for f in features]).collect()
    literal = lambda row: F.struct(*[F.lit(row[f]).cast(fields[f]).alias(f) for f in features])
    bg = F.array(*[literal(r) for r in drawn])
    row_key = [col(k) for k in key]
    out = df.select(*row_key, *[col(f) for f in features if f not in key]).withColumn(
        "__m", F.explode(F.sequence(F.lit(1), F.lit(permutations)))
    )
    out = out.withColumn("__bg", F.get(bg, F.pmod(F.xxhash64(*row_key, "__m"), F.lit(len(drawn))).cast("int")))
    ranks = F.array(*[F.struct(F.xxhash64(*row_key, "__m", F.lit(f)).alias("h"), F.lit(i).alias("i")) for i, f in enumerate(features)])
    out = out.withColumn("__ranks", ranks)
    out = out.withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    out = out.withColumn("__with", F.explode(F.array(F.lit(True), F.lit(False))))
    mine = F.get("__ranks", F.col("__j"))
    mixed = {}
    for i, f in enumerate(features):
        rank = F.get("__ranks", F.lit(i))
        own = (rank < mine) | (F.col("__with") & (rank == mine))
        mixed[f] = F.when(own, col(f)).otherwise(F.col("__bg").getField(f))
    names = [f"__key{i}" for i in range(len(key))]
    out = out.withColumns(dict(zip(names, row_key))).withColumns(mixed)
    scored = trained.predict(out)
    change = F.when(F.col("__with"), _output(trained, class_index)).otherwise(-_output(trained, class_index))
    per_row = scored.groupBy(*names, "__j").agg((F.sum(change) / permutations).alias("contribution"))
    feature = F.get(F.array(*[F.lit(f) for f in features]), F.col("__j"))
    return per_row.select(*[F.col(n).alias(k) for n, k in zip(names, key)], feature.alias("feature"), "contribution")


def global_attribution(contributions: DataFrame) -> DataFrame:
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature")


def local_surrogate(trained, df: DataFrame, row: dict, samples: int = 5000, seed: int = 42, class_index: int = 1) -> DataFrame:
    """Weights of a ridge regression around one row (LIME, Ribeiro et al. 2016).

    Numbers are drawn from a normal fit to the table, text keeps the row's value half of the time;
    samples count by their distance to the row.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from millrace.functions.semantics import col, numeric_columns, small_table
    from millrace.operators.encoding import categories
    from millrace.operators.stats import moments

    features = list(trained.features)
    numbers = [f for f in features if f in numeric_columns(df)]
    m = moments(df, numbers, ["mean", "std"])
    drawn, inputs = {}, {}
    for i, f in enumerate(features):
        if f in numbers:
            scale = m[f]["std"] or 1.0
            drawn[f] = F.lit(m[f]["mean"]) + F.randn(seed + i) * F.lit(scale)
            inputs[f"z{i}"] = (col(f) - F.lit(m[f]["mean"])) / F.lit(scale)
        else:
            names = F.array(*[F.lit(v) for v in categories(df, f)])
            other = F.get(names, F.floor(F.rand(seed + i) * F.size(names)).cast("int"))
            drawn[f] = F.when(F.rand(seed + 1000 + i) < 0.5, F.lit(row[f])).otherwise(other)
            inputs[f"z{i}"] = (col(f) == F.lit(row[f])).cast("double")
    at = {
        f"z{i}": (row[f] - m[f]["mean"]) / (m[f]["std"] or 1.0) if f in numbers else 1.0 for i, f in enumerate(features)
    }
    # written down once: the draws must not change between the passes of the regression
    from millrace.session import cut_lineage

    cloud = cut_lineage(df.sparkSession.range(samples).select(*[v.alias(f) for f, v in drawn.items()]))
    scored = trained.predict(cloud).withColumn("__y", _output(trained, class_index)).withColumns(inputs)
    gap = sum((F.col(z) - F.lit(float(v))) ** 2 for z, v in at.items())
    width = 0.75 * len(features) ** 0.5
    scored = scored.withColumn("__w", F.sqrt(F.exp(-gap / (width * width)))).select(*inputs, "__y", "__w")
    ready = VectorAssembler(inputCols=list(inputs), outputCol="__x").transform(scored)
    fit = LinearRegression(featuresCol="__x", labelCol="__y", weightCol="__w", regParam=1.0 / samples, solver="normal").fit(ready)
    rows = [(f, float(w)) for f, w in zip(features, fit.coefficients.toArray())]
    return small_table(df.sparkSession, rows, "feature string, weight double").orderBy(F.desc(F.abs("weight")), "feature")


def registry_table(spark, models: dict) -> DataFrame:
    """One row per registered model: target, number of features, score, features."""
    from millrace.functions.semantics import small_table

    rows = []
    for name, m in models.items():
        score = m.metrics.get("accuracy", m.metrics.get("r2"))
        rows.append((name, m.name, m.target, len(m.features), score, list(m.features)))
    return small_table(spark, rows, "model string, algorithm string, target string, n_features int, score double, features array<string>")
