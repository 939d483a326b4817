"""Feature selection: scores per feature, then a projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col, numeric_columns, small_table
from millrace.operators.aggregate import _pair_corr, correlation_map, target_correlations
from millrace.operators.joins import small_side
from millrace.operators.neighbours import nearest
from millrace.operators.ordering import running_sums, with_position
from millrace.operators.stats import aggregate_in_jobs, exact_quantiles, moments
from millrace.session import cut_lineage

SCORES = "feature string, score double"


def correlated_to_drop(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Columns that correlate beyond the threshold with an earlier one."""
    r = correlation_map(df, columns)
    return [b for b in columns if any(abs(r[a, b] or 0.0) > threshold for a in columns[: columns.index(b)])]


def drop_correlated(df: DataFrame, threshold: float = 0.95, columns: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*correlated_to_drop(df, list(columns or numeric_columns(df)), threshold))


def keep_varying(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Drop numeric columns whose population variance is not above the threshold."""
    m = moments(df, numeric_columns(df), ["var_pop"])
    return df.drop(*[c for c in m if c and (m[c]["var_pop"] or 0.0) <= threshold])


def f_scores(df: DataFrame, features: Sequence[str], target: str, task: str) -> DataFrame:
    """F statistic per feature: ANOVA over classes, or of the simple regression on the target.

    ANOVA sums per class first (combining before the shuffle), then over classes, so neither a hot
    class nor many classes gather rows.
    """
    if task == "regression":
        exprs = []
        for i, f in enumerate(features):
            both = col(f).isNotNull() & col(target).isNotNull()
            exprs += [_pair_corr(col(f), col(target)).alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]
        got = aggregate_in_jobs(df, exprs)
        rows = []
        for i, f in enumerate(features):
            r2 = (got[f"r{i}"] or 0.0) ** 2
            rows.append((f, float("inf") if r2 >= 1 else r2 / (1 - r2) * (got[f"n{i}"] - 2)))
        return small_table(df.sparkSession, rows, SCORES)
    m = moments(df, features, ["mean"])
    centred = {f: col(f) - F.lit(m[f]["mean"]) for f in features}
    known = df.where(col(target).isNotNull())
    first, second = [], []
    for i, f in enumerate(features):
        c = centred[f]
        first += [F.count(c).alias(f"n{i}"), F.sum(c).alias(f"s{i}"), F.sum(c * c).alias(f"q{i}")]
        n, s = F.col(f"n{i}"), F.col(f"s{i}")
        second += [
            F.sum(s * s / n).alias(f"b{i}"), F.sum(f"q{i}").alias(f"q{i}"), F.sum(s).alias(f"s{i}"),
            F.sum(n).alias(f"n{i}"), F.count_if(n > 0).alias(f"k{i}"),
        ]
    got = known.groupBy(col(target)).agg(*first).agg(*second).first()
    rows = []
    for i, f in enumerate(features):
        n, k = got[f"n{i}"] or 0, got[f"k{i}"] or 0
        if k < 2 or n <= k:  # an empty table, one class, or a row for each class: no score
            rows.append((f, None))
            continue
        total = got[f"s{i}"] ** 2 / n
        between, within = got[f"b{i}"] - total, got[f"q{i}"] - got[f"b{i}"]
        rows.append((f, (between / (k - 1)) / (within / (n - k)) if within > 0 else float("inf")))
    return small_table(df.sparkSession, rows, SCORES)


def mutual_information(df: DataFrame, features: Sequence[str], target: str, task: str, bins: int = 10) -> DataFrame:
    """Mutual information in nats from joint counts of decile bins (and classes).

    An approximation by binning, cheaper than :func:`neighbour_information`. One shuffle of
    (feature, bin, class) counts serves all features.
    """
    cut = list(features) + ([target] if task == "regression" else [])
    edges = exact_quantiles(df, cut, [i / bins for i in range(1, bins)])

    def binned(c):
        inner = sorted(set(v for v in edges[c] if v is not None))
        out = F.lit(len(inner))
        for i, e in reversed(list(enumerate(inner))):
            out = F.when(col(c) <= F.lit(e), F.lit(i)).otherwise(out)
        return F.when(col(c).isNotNull(), out).cast("string")

    y = binned(target) if task == "regression" else col(target).cast("string")
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), binned(f).alias("x"), y.alias("y")) for f in features])
    counts = (
        df.select(F.explode(pairs).alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL")
        .groupBy("feature", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    plogp = lambda n: F.sum(n * F.log(n))
    n = F.col("n")
    joint = counts.groupBy("feature").agg(plogp(n).alias("xy"), F.sum(n).alias("n"))
    sides = [
        counts.groupBy("feature", side).agg(F.sum("n").alias("n")).groupBy("feature").agg(plogp(F.col("n")).alias(f"by_{side}"))
        for side in ("x", "y")
    ]
    both = joint.join(sides[0], "feature").join(sides[1], "feature")
    score = (F.col("xy") - F.col("by_x") - F.col("by_y")) / n + F.log("n")
    return both.select("feature", F.greatest(score, F.lit(0.0)).alias("score"))


def _digamma(n):
    """The logarithmic derivative of the gamma function at a positive whole number, by its series ten places on."""
    x = n + 10
    z = 1 / (x * x)
    series = F.log(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    return series - sum(1 / (n + i) for i in range(10))


def _within(points: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """(q, ``name``): the weight of points (v, w) from ``low`` to ``high``, ends included, of each (q, low, high).

    Points and ends are sorted together and their running sum is taken at both ends, so no point meets another.
    """
    end = lambda v, kind, sign: F.struct(F.col(v).alias("v"), F.lit(kind).alias("kind"), F.lit(sign).alias("sign"))
    ends = asked.select("q", F.explode(F.array(end("low", 0, -1), end("high", 2, 1))).alias("e")).select("q", "e.*")
    ends = ends.withColumn("w", F.lit(0).cast("bigint"))
    rows = points.select("v", F.lit(1).alias("kind"), "w").unionByName(ends, allowMissingColumns=True)
    summed = running_sums(cut_lineage(rows), {"upto": "w"}, ["v", "kind"])
    return summed.where("sign IS NOT NULL").groupBy("q").agg(F.sum(F.col("sign") * F.col("upto")).alias(name))


def neighbour_information(
    df: DataFrame, features: Sequence[str], target: str, task: str, k: int = 3, cell_rows: int = 1_000
) -> DataFrame:
    """Mutual information in nats by neighbours (Kraskov et al. 2004 for numbers, Ross 2014 for classes), not below 0.

    The distance of a row to its k-th neighbour, among all rows (largest difference of feature and target, both in standard
    deviations) or among those of its class (difference of the feature), is its radius; rows nearer than that are counted on
    each axis (on the feature's). Those at the radius are not, nor within 1e-12 of the values of it, which is rounding; copies
    always are. Rows with a null, NaN or infinity in either column are left out, and classes of one row. A class of at
    most k rows takes all its other rows. The score is null if less than two rows are left.
    """
    rows = []
    for f in features:
        x = col(f).cast("double")
        real = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        if task == "regression":
            y = col(target).cast("double")
            both = df.select(x.alias("x"), y.alias("y")).where(real(x) & real(y))
            m = moments(both, ["x", "y"], ["mean", "std_pop"])
            scaled = lambda c: (F.col(c) - F.lit(m[c]["mean"])) / F.lit(m[c]["std_pop"] or 1.0)
            both = both.select(scaled("x").alias("x"), scaled("y").alias("y"), F.lit(0).cast("bigint").alias("of"))
            apart = F.col("y")
        else:
            known = df.select(x.alias("x"), col(target).cast("string").alias("class")).where(real(x) & col("class").isNotNull())
            sizes = known.groupBy("class").agg(F.count(F.lit(1)).alias("of")).where("of > 1")
            # The number of a class takes its rows farther from others than any two values are.
            numbered = with_position(sizes, ["class"], "y").select(F.col("class").alias("__class"), "of", F.col("y").cast("double").alias("y"))
            both = known.join(small_side(numbered), F.col("class") == F.col("__class")).select("x", "y", "of")
            ends = known.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
            apart = F.col("y") * F.lit(2 * ((ends["high"] or 0.0) - (ends["low"] or 0.0)) + 1.0)
        kinds = both.groupBy("x", "y", "of").agg(F.count(F.lit(1)).alias("w"))
        kinds = cut_lineage(kinds.withColumn("q", F.monotonically_increasing_id()))
        n = kinds.agg(F.sum("w")).first()[0] or 0
        if n < 2:
            rows.append((f, None))
            continue
        # A row is its own neighbour, and so are its copies.
        place = F.array("x", apart)
        of = F.when(F.col("of") > 0, F.col("of")).otherwise(F.lit(n))
        need = F.least(F.lit(k), of - 1) + 1
        donors = kinds.select(place.alias("x"), F.array(F.lit(0.0)).alias("values"), "w")
        found = nearest(kinds.select("q", F.lit(0).alias("slot"), place.alias("x")), donors, 2, k + 1, cell_rows, largest=True)
        state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("d"))
        at = kinds.withColumn("need", need).join(found.select("q", "near"), "q")
        step = lambda a, e: F.struct((a["n"] + e["w"]).alias("n"), F.when(a["n"] < F.col("need"), e["d"]).otherwise(a["d"]).alias("d"))
        at = at.withColumn("radius", F.aggregate("near", state, step, lambda a: a["d"])).select("q", "x", "y", "w", "need", of.alias("of"), "radius")
        at = cut_lineage(at)

        def seen(c):
            slack = (F.abs(F.col(c)) + F.col("radius")) * 1e-12
            reach = F.greatest(F.col("radius") - slack, F.lit(0.0))
            asked = at.select("q", (F.col(c) - reach).alias("low"), (F.col(c) + reach).alias("high"))
            return _within(at.select(F.col(c).alias("v"), "w"), asked, f"m_{c}")

        counted = at.join(seen("x"), "q")
        terms = _digamma(F.col("need") - 1) - _digamma(F.col("m_x"))
        if task == "regression":
            counted = counted.join(seen("y"), "q")
            terms = terms - _digamma(F.col("m_y"))
        else:
            terms = terms - _digamma(F.col("of"))
        score = counted.agg(F.sum(terms * F.col("w")) / F.lit(n) + _digamma(F.lit(float(n)))).first()[0]
        rows.append((f, max(score, 0.0)))
    return small_table(df.sparkSession, rows, SCORES)


def forest_importance(df: DataFrame, features: Sequence[str], target: str, task: str, trees: int = 100) -> DataFrame:
    from millrace.models.supervised import train

    fitted = train(df.select(*[col(c) for c in [*features, target]]), target, "random_forest", task, params={"numTrees": trees})
    return fitted.importances()


def recursive_elimination(df: DataFrame, features: Sequence[str], target: str, task: str, keep: int, trees: int = 100) -> DataFrame:
    """Drop the least important feature of a forest, one per round; score is the rank (1 = kept)."""
    left, rank = list(features), {}
    while len(left) > keep:
        scores = {r["feature"]: r["score"] for r in forest_importance(df, left, target, task, trees).collect()}
        worst = min(left, key=lambda f: (scores.get(f, 0.0), f))
        left.remove(worst)
        rank[worst] = float(len(left) - keep + 2)
    rows = [(f, rank.get(f, 1.0)) for f in features]
    return small_table(df.sparkSession, rows, SCORES)


def scores(df: DataFrame, features: Sequence[str], target: str, method: str, task: str, n: int, **options) -> DataFrame:
    """(feature, score) by f_statistic, mutual_information (by neighbours), binned_information, forest, rfe or correlation."""
    makers = {
        "f_statistic": lambda: f_scores(df, features, target, task),
        "mutual_information": lambda: neighbour_information(df, features, target, task, **options),
        "binned_information": lambda: mutual_information(df, features, target, task, **options),
        "forest": lambda: forest_importance(df, features, target, task, **options),
        "rfe": lambda: recursive_elimination(df, features, target, task, n, **options),
        "correlation": lambda: target_correlations(df, features, target),
    }
    return makers[method]()


def select_features(df: DataFrame, features: Sequence[str], target: str, method: str, n: int, task: str, **options):
    """Best ``n`` features plus target, and the score table with a ``selected`` flag."""
    found = {r["feature"]: r["score"] for r in scores(df, features, target, method, task, n, **options).collect()}
    best = sorted(features, key=lambda f: ((found.get(f) or 0.0) if method == "rfe" else -(found.get(f) or 0.0)))[:n]
    rows = [(f, found.get(f), f in best) for f in features]
    table = small_table(df.sparkSession, rows, "feature string, score double, selected boolean")
    kept = df.select(*[col(f) for f in features if f in best], col(target))
    return kept, table.orderBy(F.desc_nulls_last("score"), "feature")


