"""Classification and regression: preparation, algorithms, training, comparison, search and scoring."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from operator import and_
from random import Random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.semantics import col, numeric_columns, small_table
from millrace.models import evaluate, store
from millrace.operators.sampling import split, stratified_split, with_folds

ROW = "__row"
#: A target with fewer distinct values than this is a class.
CLASS_LIMIT = 20


@dataclass(frozen=True)
class Config:
    target: str
    features: tuple[str, ...] = ()
    task: str | None = None
    missing: str = "impute"
    test_share: float = 0.2
    seed: int = 42


@dataclass
class Trained:
    """A fitted pipeline with what is needed to read its predictions."""

    name: str
    task: str
    target: str
    features: tuple[str, ...]
    labels: list[str] | None
    model: object
    metrics: dict = field(default_factory=dict)
    seconds: float = 0.0

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` (the class name for classifiers) and ``probability`` where known.

        A row with a gap in a number keeps its place, with nulls for both.
        """
        out = self.model.transform(df)
        whole = F.lit(True) if ALIASES.get(self.name, self.name) in TAKES_GAPS else complete(df, self.features)
        extra = [c for c in out.columns if c not in df.columns and c not in ("prediction", "probability")]
        if self.labels:
            names = F.array(*[F.lit(v) for v in self.labels])
            out = out.withColumn("prediction", F.get(names, F.col("prediction").cast("int")))
            if "probability" in out.columns:
                kind = dict(out.dtypes)["probability"]
                out = out if kind.startswith("array") else out.withColumn("probability", vector_to_array("probability"))
        told = [c for c in ("prediction", "probability") if c in out.columns and c not in df.columns]
        return out.withColumns({c: F.when(whole, F.col(c)) for c in told}).drop(*extra)

    def importances(self) -> DataFrame:
        """(feature, score): importance per input column, one-hot columns added up."""
        own = self.model.inner if isinstance(self.model, Encoded) else self.model
        if hasattr(own, "importance"):
            return self._own_importances(own)
        last = self.model.stages[-1]
        if hasattr(last, "featureImportances"):
            values = last.featureImportances.toArray()
        elif hasattr(last, "coefficientMatrix"):
            values = abs(last.coefficientMatrix.toArray()).sum(axis=0)
        elif hasattr(last, "coefficients"):
            values = abs(last.coefficients.toArray())
        else:
            raise ValueError(f"{self.name} has no importances")
        sizes = _slots(self.model)
        rows, at = [], 0
        for f, size in sizes:
            rows.append((f, float(sum(values[at : at + size]))))
            at += size
        return small_table(SparkSession.getActiveSession(), rows, "feature string, score double").orderBy(F.desc("score"), "feature")


    def _own_importances(self, own) -> DataFrame:
        rows = own.importance()
        if isinstance(self.model, Encoded):
            values, rows, at = [v for _, v in rows], [], 0
            for f, size in _slots(self.model.pre):
                rows.append((f, float(sum(values[at : at + size]))))
                at += size
        return small_table(SparkSession.getActiveSession(), rows, "feature string, score double").orderBy(F.desc("score"), "feature")


def _slots(model: PipelineModel) -> list[tuple[str, int]]:
    """Each feature with its places in the assembled vector; a text of one category has none."""
    kept = {s.getOutputCol(): len(s.getIndices()) for s in model.stages if isinstance(s, VectorSlicer)}
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    return [(name.removeprefix("__hot_"), kept.get(name, 1)) for name in assembler.getInputCols()]


#: name -> (classifier, regressor, default parameters)
ALGORITHMS = {
    "logistic_regression": (C.LogisticRegression, None, {"maxIter": 100}),
    "linear_regression": (None, R.LinearRegression, {}),
    "ridge": (None, R.LinearRegression, {"regParam": 1.0, "elasticNetParam": 0.0}),
    "lasso": (None, R.LinearRegression, {"regParam": 1.0, "elasticNetParam": 1.0}),
    "elastic_net": (None, R.LinearRegression, {"regParam": 1.0, "elasticNetParam": 0.5}),
    "huber": (None, R.LinearRegression, {"loss": "huber", "epsilon": 1.35}),
    "random_forest": (C.RandomForestClassifier, R.RandomForestRegressor, {"numTrees": 100, "seed": 42}),
    "bagging": (C.RandomForestClassifier, R.RandomForestRegressor, {"numTrees": 10, "featureSubsetStrategy": "all", "seed": 42}),
    "decision_tree": (C.DecisionTreeClassifier, R.DecisionTreeRegressor, {"seed": 42}),
    "gradient_boosting": (C.GBTClassifier, R.GBTRegressor, {"maxIter": 50, "seed": 42}),
    "naive_bayes": (C.NaiveBayes, None, {"modelType": "gaussian"}),
    "mlp": (C.MultilayerPerceptronClassifier, None, {"maxIter": 100, "seed": 42}),
}
#: Boosters of other packages are second-order boosting.
ALIASES = {"xgboost": "newton_boosting", "lightgbm": "newton_boosting", "catboost": "newton_boosting", "boosting": "gradient_boosting"}
#: These are trained elsewhere in the package but compared here.
OWN = ("lda", "qda", "adaboost", "knn", "bayesian_ridge", "svm", "svr", "extra_trees", "newton_boosting")
#: Models that learn where a gap in a number goes; others predict nothing for such a row.
TAKES_GAPS = ("newton_boosting",)


def task_of(df: DataFrame, target: str) -> str:
    """Classification for text targets and for those with fewer than CLASS_LIMIT values."""
    if target not in numeric_columns(df):
        return "classification"
    few = df.select(col(target)).where(col(target).isNotNull()).distinct().limit(CLASS_LIMIT).count() < CLASS_LIMIT
    return "classification" if few else "regression"


def prepare(df: DataFrame, config: Config) -> DataFrame:
    """Known targets, gaps by policy in the features, target as text for classes."""
    features = config.features or tuple(c for c in df.columns if c != config.target and c != ROW)
    keep = [c for c in (ROW,) if c in df.columns]
    known = df.where(col(config.target).isNotNull()).select(*[col(c) for c in [*keep, *features, config.target]])
    if config.missing == "keep":
        return known
    if config.missing == "drop":
        return known.dropna()
    from millrace.operators.missing import fill, fit_mean, fit_mode

    numbers = [c for c in features if c in numeric_columns(df)]
    others = [c for c in features if c not in numbers]
    return fill(known, {**fit_mean(known, numbers), **(fit_mode(known, others) if others else {})})


def feature_stages(df: DataFrame, features: Sequence[str]) -> list:
    """Index and one-hot the text columns, fitted on ``df``, then assemble everything.

    Of k categories k - 1 get a place; the first in alphabetic order, a null and a category that
    was not seen have zeros there. A gap in a number becomes NaN in the vector, so no row is lost.
    """
    numbers = set(numeric_columns(df))
    texts = [f for f in features if f not in numbers]
    stages, hot = [], set()
    if texts:
        idx = [f"__idx_{t}" for t in texts]
        indexer = StringIndexer(inputCols=texts, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetDesc").fit(df)
        stages.append(indexer)
        sizes = {t: len(labels) for t, labels in zip(texts, indexer.labelsArray)}
        hot = {t for t in texts if sizes[t] > 1}
        if hot:
            some = [t for t in texts if t in hot]
            stages.append(OneHotEncoder(inputCols=[f"__idx_{t}" for t in some], outputCols=[f"__all_{t}" for t in some], dropLast=False, handleInvalid="error"))
            # The order is descending: the first category is the last but one, the unseen ones are last.
            stages += [VectorSlicer(inputCol=f"__all_{t}", outputCol=f"__hot_{t}", indices=list(range(sizes[t] - 1))) for t in some]
    inputs = [f"__hot_{f}" if f in hot else f for f in features if f in hot or f in numbers]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="__features", handleInvalid="keep"))
    return stages


def _spread(pre: PipelineModel, df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with each place of the assembled vector as a column."""
    out = pre.transform(df)
    n = sum(size for _, size in _slots(pre))
    names = [f"__f{i}" for i in range(n)]
    values = vector_to_array(F.col("__features"))
    out = out.withColumns({c: F.get(values, F.lit(i)) for i, c in enumerate(names)})
    return out.select(*[col(c) for c in df.columns], *names), names


@dataclass
class Encoded:
    """A model of this package behind the encoding of text features."""

    pre: PipelineModel
    names: list[str]
    inner: object

    def transform(self, df: DataFrame) -> DataFrame:
        coded, _ = _spread(self.pre, df)
        return self.inner.transform(coded).drop(*self.names)


def complete(df: DataFrame, features: Sequence[str]):
    """Whether no number among the features is missing; texts have a place for that."""
    known = [col(f).isNotNull() & ~F.isnan(col(f).cast("double")) for f in features if f in set(numeric_columns(df))]
    return reduce(and_, known, F.lit(True))


def estimator(name: str, task: str, classes: int, width: int, params: dict | None = None):
    name = ALIASES.get(name, name)
    classifier, regressor, defaults = ALGORITHMS[name]
    kind = classifier if task == "classification" else regressor
    if kind is None:
        raise ValueError(f"{name} does not do {task}")
    known = {p.name for p in kind().params}
    given = {k: v for k, v in {**defaults, **(params or {})}.items() if k in known}
    est = kind(featuresCol="__features", labelCol="__label", **given)
    if name == "mlp" and "layers" not in given:
        est = est.setLayers([width, 100, classes])
    if classes > 2 and name == "gradient_boosting":
        return C.OneVsRest(classifier=est, featuresCol="__features", labelCol="__label")
    return est


def train(
    df: DataFrame, target: str, algorithm: str, task: str | None = None, features: Sequence[str] | None = None, params: dict | None = None
) -> Trained:
    """Fit one algorithm on a prepared table (no gaps); every row is used."""
    task = task or task_of(df, target)
    features = tuple(features or [c for c in df.columns if c not in (target, ROW)])
    started, own = time.time(), ALIASES.get(algorithm, algorithm)
    labels = None
    if task == "classification":
        from millrace.operators.encoding import categories

        labels = categories(df, target)
        names = F.array(*[F.lit(v) for v in labels])
        data = df.withColumn("__label", (F.array_position(names, col(target).cast("string")) - 1).cast("double"))
    else:
        data = df.withColumn("__label", col(target).cast("double"))
    data = data.where(F.col("__label").isNotNull() & (F.lit(True) if own in TAKES_GAPS else complete(df, features)))
    if own in OWN:
        from millrace.models import special

        if set(features) <= set(numeric_columns(df)):
            model = special.fit(own, data, features, labels, params or {})
        else:
            pre = Pipeline(stages=feature_stages(df, features)).fit(data)
            coded, names = _spread(pre, data)
            model = Encoded(pre, names, special.fit(own, coded, names, labels, params or {}))
    else:
        pre = Pipeline(stages=feature_stages(df, features)).fit(data)
        width = 0
        if algorithm == "mlp":
            width = pre.transform(data.limit(1)).first()["__features"].size
        est = estimator(algorithm, task, len(labels or []), width, params)
        wanted = pre.transform(data).select("__features", "__label").persist()  # a fit passes over it several times
        try:
            fitted = est.fit(wanted)
        finally:
            wanted.unpersist()
        model = PipelineModel(stages=[*pre.stages, fitted])
    return Trained(algorithm, task, target, features, labels, model, seconds=time.time() - started)


def measure(trained: Trained, train_df: DataFrame, test_df: DataFrame) -> dict:
    """Test metrics, plus the train score."""
    tested = trained.predict(test_df)
    seen = trained.predict(train_df)
    if trained.task == "classification":
        tested = tested.withColumn(trained.target, col(trained.target).cast("string"))
        seen = seen.withColumn(trained.target, col(trained.target).cast("string"))
        out = evaluate.classification_metrics(tested, trained.target).first().asDict()
        out["train_accuracy"] = evaluate.classification_metrics(seen, trained.target).first()["accuracy"]
        if len(trained.labels) == 2 and "probability" in tested.columns:
            scored = tested.withColumn("__score", F.get("probability", F.lit(1)))
            out["roc_auc"] = evaluate.roc_auc(scored, trained.target, "__score", trained.labels[1]).first()["auc"]
        return out
    out = evaluate.regression_metrics(tested, trained.target).first().asDict()
    before = evaluate.regression_metrics(seen, trained.target).first()
    return {**out, "train_mse": before["mse"], "train_r2": before["r2"]}


def split_for(df: DataFrame, config: Config, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    if config.task == "classification":
        return stratified_split(df, config.target, config.test_share, key, config.seed)
    return split(df, config.test_share, key, config.seed)


def _configured(df: DataFrame, config: Config) -> Config:
    from dataclasses import replace

    return config if config.task else replace(config, task=task_of(df, config.target))


RESULTS = (
    "model_name string, task_type string, target_column string, training_time double, "
    "feature_columns array<string>, metrics map<string,double>"
)


def results_table(spark, models: Sequence[Trained]) -> DataFrame:
    rows = [
        (m.name, m.task, m.target, m.seconds, list(m.features), {k: float(v) for k, v in m.metrics.items() if v is not None})
        for m in models
    ]
    return small_table(spark, rows, RESULTS)


def compare(df: DataFrame, config: Config, algorithms: Sequence[str], key: Sequence[str], params: dict | None = None) -> list[Trained]:
    """Train several algorithms on one split and measure them on its test part.

    ``key`` identifies rows for the split; it is no feature unless named as one.
    """
    config = _configured(df, config)
    features = config.features or tuple(c for c in df.columns if c not in (config.target, *key))
    needed = df.select(*[col(c) for c in dict.fromkeys([*key, *features, config.target])]).where(col(config.target).isNotNull())
    first, second = split_for(needed, config, key)
    from dataclasses import replace

    config = replace(config, features=features)
    # gaps are filled from the training part only, so nothing of the test part leaks
    train_df, test_df = _prepare_pair(first, second, config)
    train_df, test_df = train_df.persist(), test_df.persist()
    try:
        out = []
        for name in algorithms:
            fitted = train(train_df, config.target, name, config.task, features, (params or {}).get(name))
            fitted.metrics = measure(fitted, train_df, test_df)
            out.append(fitted)
        return out
    finally:
        train_df.unpersist()
        test_df.unpersist()


def _prepare_pair(first: DataFrame, second: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    columns = [*config.features, config.target]
    a, b = first.select(*[col(c) for c in columns]), second.select(*[col(c) for c in columns])
    if config.missing == "keep":
        return a, b
    if config.missing == "drop":
        return a.dropna(), b.dropna()
    from millrace.operators.missing import fill, fit_mean, fit_mode

    numbers = [c for c in config.features if c in numeric_columns(a)]
    others = [c for c in config.features if c not in numbers]
    values = {**fit_mean(a, numbers), **(fit_mode(a, others) if others else {})}
    return fill(a, values), fill(b, values)


def best_of(models: Sequence[Trained]) -> Trained:
    """Highest accuracy or R2."""
    score = "accuracy" if models[0].task == "classification" else "r2"
    return max(models, key=lambda m: m.metrics[score])


def cross_validate(df: DataFrame, target: str, algorithm: str, k: int, key: Sequence[str], task=None, params=None, features=None) -> DataFrame:
    """Score per fold (accuracy or R2)."""
    task = task or task_of(df, target)
    features = tuple(features or [c for c in df.columns if c not in (target, *key)])
    folded = with_folds(df, k, key).persist()
    rows = []
    try:
        for fold in range(k):
            fitted = train(folded.where(F.col("fold") != fold), target, algorithm, task, features, params)
            tested = fitted.predict(folded.where(F.col("fold") == fold))
            if task == "classification":
                score = evaluate.classification_metrics(tested.withColumn(target, col(target).cast("string")), target).first()["accuracy"]
            else:
                score = evaluate.regression_metrics(tested, target).first()["r2"]
            rows.append((fold, score))
    finally:
        folded.unpersist()
    return small_table(df.sparkSession, rows, "fold int, score double")


def cv_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


#: Default search grids.
GRIDS = {
    "logistic_regression": {"regParam": [0.0, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15]},
    "decision_tree": {"maxDepth": [3, 5, 10], "minInstancesPerNode": [1, 2, 5]},
    "gradient_boosting": {"maxIter": [20, 50], "stepSize": [0.05, 0.1, 0.2], "maxDepth": [3, 5]},
    "svm": {"regParam": [0.01, 0.1, 1.0]},
    "svr": {"C": [0.1, 1.0, 10.0], "epsilon": [0.01, 0.1]},
    "extra_trees": {"numTrees": [50, 100], "maxDepth": [5, 10]},
    "newton_boosting": {"maxIter": [20, 50], "stepSize": [0.05, 0.1, 0.3], "maxDepth": [3, 5]},
    "adaboost": {"rounds": [10, 20], "rate": [0.5, 1.0]},
    "ridge": {"regParam": [0.1, 1.0, 10.0]},
    "lasso": {"regParam": [0.1, 1.0, 10.0]},
    "elastic_net": {"regParam": [0.1, 1.0, 10.0], "elasticNetParam": [0.2, 0.5, 0.8]},
}


def tune(
    df: DataFrame, target: str, algorithm: str, key: Sequence[str], grid: dict | None = None, cv: int = 3, random: int | None = None,
    task: str | None = None, features=None, parallelism: int = 2, seed: int = 42,
) -> tuple[Trained, DataFrame]:
    """Grid search (or ``random`` draws from the grid) by cross-validation, then a fit on all rows."""
    task = task or task_of(df, target)
    features = tuple(features or [c for c in df.columns if c not in (target, *key)])
    own = ALIASES.get(algorithm, algorithm)
    grid = grid or GRIDS[own]
    combos = [dict(zip(grid, values)) for values in product(*grid.values())]
    if random is not None and random < len(combos):
        combos = Random(seed).sample(combos, random)
    if own in OWN:
        return _tune_own(df, target, algorithm, key, combos, cv, task, features)
    from millrace.operators.encoding import categories

    labels = categories(df, target) if task == "classification" else None
    label = col(target).cast("double")
    if labels:
        label = (F.array_position(F.array(*[F.lit(v) for v in labels]), col(target).cast("string")) - 1).cast("double")
    data = with_folds(df, cv, key).withColumn("__label", label)
    data = data.where(F.col("__label").isNotNull() & complete(df, features))
    pre = Pipeline(stages=feature_stages(df, features)).fit(data)
    ready = pre.transform(data).select("__features", "__label", F.col("fold")).persist()  # every fold and the last fit read it
    try:
        search, combos = _searched(ready, algorithm, task, labels, combos, cv, parallelism)
    finally:
        ready.unpersist()
    rows = [(str(c), float(s)) for c, s in zip(combos, search.avgMetrics)]
    table = small_table(df.sparkSession, rows, "params string, score double").orderBy(F.desc("score"), "params")
    model = PipelineModel(stages=[*pre.stages, search.bestModel])
    return Trained(algorithm, task, target, features, labels, model, {"score": max(search.avgMetrics)}), table


def _searched(ready: DataFrame, algorithm: str, task: str, labels: list[str] | None, combos: list[dict], cv: int, parallelism: int):
    """Cross-validation of every setting on assembled rows with the best one fitted on all of them, and the whole settings."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator

    width = 0
    if algorithm == "mlp":
        first = ready.first()
        width = first["__features"].size if first else 0
        given = {tuple(c["layers"]) if "layers" in c else None for c in combos}
        if given - {None}:  # hidden layers; the ends are those of the data
            combos = [{**c, "layers": [width, *c["layers"], len(labels or [])]} if "layers" in c else c for c in combos]
    est = estimator(algorithm, task, len(labels or []), width)
    inner = est.getClassifier() if isinstance(est, C.OneVsRest) else est
    maps = [{inner.getParam(k): v for k, v in c.items()} for c in combos]
    if labels:
        judge = MulticlassClassificationEvaluator(labelCol="__label", metricName="accuracy")
    else:
        judge = RegressionEvaluator(labelCol="__label", metricName="r2")
    search = CrossValidator(
        estimator=est, estimatorParamMaps=maps, evaluator=judge, numFolds=cv, foldCol="fold", parallelism=parallelism
    ).fit(ready)
    return search, combos


def _tune_own(df: DataFrame, target: str, algorithm: str, key, combos: list[dict], cv: int, task: str, features) -> tuple[Trained, DataFrame]:
    """Search for models of this package. Support vector machines fit all settings and folds in the same scans."""
    if algorithm in ("svm", "svr"):
        means = _margin_scores(df, target, key, combos, cv, task, features)
    else:
        means = [cv_summary(cross_validate(df, target, algorithm, cv, key, task, c, features)).first()["mean"] for c in combos]
    best = max(range(len(combos)), key=lambda i: means[i])
    fitted = train(df.select(*[col(c) for c in dict.fromkeys([*features, target])]), target, algorithm, task, features, combos[best])
    fitted.metrics = {"score": float(means[best])}
    table = small_table(df.sparkSession, [(str(c), float(m)) for c, m in zip(combos, means)], "params string, score double")
    return fitted, table.orderBy(F.desc("score"), "params")


def _margin_scores(df: DataFrame, target: str, key, combos: list[dict], cv: int, task: str, features) -> list[float]:
    """Mean over the folds of accuracy, or of R2, for each setting: one optimisation of all, one aggregate."""
    from millrace.models.margin import fit_many
    from millrace.operators.encoding import categories

    labels = categories(df, target) if task == "classification" else []
    label = col(target).cast("double")
    if labels:
        label = (F.array_position(F.array(*[F.lit(v) for v in labels]), col(target).cast("string")) - 1).cast("double")
    data = with_folds(df, cv, key).withColumn("__label", label).where(F.col("__label").isNotNull() & complete(df, features))
    names = list(features)
    if not set(features) <= set(numeric_columns(df)):
        data, names = _spread(Pipeline(stages=feature_stages(df, features)).fit(data), data)
    from millrace.session import cut_lineage

    data = cut_lineage(data.select("fold", "__label", *[col(c) for c in names]))
    specs = [{**c, "skip": fold} for c in combos for fold in range(cv)]
    models = fit_many(data, names, len(labels), specs, "fold")
    worth = []
    for i, (spec, model) in enumerate(zip(specs, models)):
        guess = model.prediction()
        here = F.col("fold") == spec["skip"]
        off = F.col("__label") - guess
        value = F.avg(F.when(here, (off == 0).cast("double"))) if labels else 1 - F.avg(F.when(here, off * off)) / F.var_pop(F.when(here, F.col("__label")))
        worth.append(value.alias(f"v{i}"))
    got = data.agg(*worth).first()
    return [sum(got[j * cv + f] or 0.0 for f in range(cv)) / cv for j in range(len(combos))]


def save_model(trained: Trained, path: str) -> None:
    """Write a trained model of any kind, with its labels and metrics."""
    store.save(trained, path)


def load_model(spark: SparkSession, path: str) -> Trained:
    return store.load(spark, path)


def score_saved(path: str, df: DataFrame) -> DataFrame:
    """Batch scoring with a saved model; classes by name, as ``predict``."""
    return load_model(df.sparkSession, path).predict(df)


# --- ensembles --------------------------------------------------------------------------------


def voting(members: Sequence[Trained], df: DataFrame, row: Sequence[str]) -> DataFrame:
    """Soft vote: mean class probability (or mean prediction) of several models, in one projection chain."""
    out = df
    names = []
    for i, m in enumerate(members):
        scored = m.predict(out)
        value = F.col("probability") if m.task == "classification" else F.col("prediction")
        names.append(f"__member{i}")
        out = scored.withColumn(names[-1], value).drop("prediction", "probability")
    if members[0].task == "classification":
        labels = members[0].labels
        means = [
            F.struct(
                (sum(F.get(F.col(n), F.lit(j)) for n in names) / len(names)).alias("p"), F.lit(-j).alias("j"), F.lit(v).alias("v")
            )
            for j, v in enumerate(labels)
        ]
        out = out.withColumns(
            {"prediction": F.array_max(F.array(*means))["v"], "probability": F.array(*[m.getField("p") for m in means])}
        )
    else:
        out = out.withColumn("prediction", sum(F.col(n) for n in names) / len(names))
    return out.drop(*names)


@dataclass
class Stacked:
    members: list[Trained]
    meta: Trained

    def predict(self, df: DataFrame) -> DataFrame:
        return self.meta.predict(_member_features(self.members, df)).drop(*_member_names(self.members))


def _member_names(members: Sequence[Trained]) -> list[str]:
    names = []
    for i, m in enumerate(members):
        width = len(m.labels) if m.labels else 1
        names += [f"__m{i}_{j}" for j in range(width)]
    return names


def _member_features(members: Sequence[Trained], df: DataFrame) -> DataFrame:
    out = df
    for i, m in enumerate(members):
        scored = m.predict(out)
        if m.labels:
            values = {f"__m{i}_{j}": F.get("probability", F.lit(j)) for j in range(len(m.labels))}
        else:
            values = {f"__m{i}_0": F.col("prediction")}
        out = scored.withColumns(values).drop("prediction", "probability")
    return out


def stack(df: DataFrame, target: str, algorithms: Sequence[str], key: Sequence[str], k: int = 5, task: str | None = None, features=None) -> Stacked:
    """Out-of-fold predictions of the members feed a logistic or linear model."""
    task = task or task_of(df, target)
    features = tuple(features or [c for c in df.columns if c not in (target, *key)])
    folded = with_folds(df, k, key).persist()
    try:
        parts = []
        for fold in range(k):
            rest = folded.where(F.col("fold") != fold)
            fitted = [train(rest, target, a, task, features) for a in algorithms]
            parts.append(_member_features(fitted, folded.where(F.col("fold") == fold)))
        level = parts[0]
        for p in parts[1:]:
            level = level.unionByName(p)
        members = [train(folded, target, a, task, features) for a in algorithms]
        names = _member_names(members)
        meta = "logistic_regression" if task == "classification" else "linear_regression"
        return Stacked(members, train(level.select(*names, col(target)), target, meta, task, names))
    finally:
        folded.unpersist()


def ensemble_comparison(members: Sequence[Trained], ensemble, test: DataFrame, name: str = "ensemble") -> DataFrame:
    """Test score of every member and of the ensemble."""
    target, task = members[0].target, members[0].task
    rows = []
    for label, predict in [(m.name, m.predict) for m in members] + [(name, ensemble)]:
        scored = predict(test)
        if task == "classification":
            value = evaluate.classification_metrics(scored.withColumn(target, col(target).cast("string")), target).first()["accuracy"]
        else:
            value = evaluate.regression_metrics(scored, target).first()["r2"]
        rows.append((label, float(value)))
    return small_table(test.sparkSession, rows, "model string, score double")


def problem_summary(df: DataFrame, target: str) -> DataFrame:
    """Task and target statistics: class balance, or describe."""
    from millrace.operators.aggregate import class_balance, describe

    if task_of(df, target) == "classification":
        return class_balance(df, target).select(F.lit("classification").alias("task"), F.col("class").alias("item"), F.col("count").cast("double").alias("value"))
    stats = describe(df, [target])
    names = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    pairs = F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("value")) for n in names])
    return stats.select(F.lit("regression").alias("task"), F.inline(pairs))
