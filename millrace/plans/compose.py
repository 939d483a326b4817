"""Composite plans: cleaning, preparation and automatic training as chains of operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col, numeric_columns, small_table, text_columns
from millrace.operators import convert, encoding, missing, outliers, project, scaling, selection
from millrace.operators.dedup import drop_duplicates
from millrace.operators.stats import aggregate_in_jobs
from millrace.session import cut_lineage

REPORT = "step int, action string, affected bigint"


def auto_clean(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Empty data, types, gaps, duplicates, isolated values, text, storage; with a report and next steps."""
    from millrace.models.isolation import clip_isolated
    from millrace.operators.validation import next_steps

    rows = []
    shape = (df.count(), len(df.columns))
    out = project.drop_empty(df)
    rows.append((1, "empty columns dropped", shape[1] - len(out.columns)))
    types = convert.auto_types(out)
    out = convert.apply_types(out, types)
    rows.append((2, "columns converted", len(types)))
    _, gaps, _ = missing.with_nulls(out)
    out = cut_lineage(missing.smart_missing(out))
    rows.append((3, "missing cells handled", sum(gaps.values())))
    before = out.count()
    out = cut_lineage(drop_duplicates(out))
    rows.append((4, "duplicate rows dropped", before - out.count()))
    numbers = numeric_columns(out)
    out = clip_isolated(out, numbers)
    rows.append((5, "columns checked for isolated values", len(numbers)))
    texts = text_columns(out)
    out = convert.clean_text(out, texts)
    rows.append((6, "text columns cleaned", len(texts)))
    out = cut_lineage(out)
    plan = convert.storage_plan(out).agg((F.sum("bytes_before") - F.sum("bytes_after")).cast("bigint").alias("saved"))
    saved = plan.first()["saved"]
    out = convert.shrink(out)
    rows.append((7, "bytes saved", saved or 0))
    return out, small_table(df.sparkSession, rows, REPORT), next_steps(out)


def quick_clean(df: DataFrame) -> DataFrame:
    """Duplicates, median or mode for gaps, stripped text, text that is mostly numbers as numbers."""
    # several fits follow, which would each repeat the shuffle
    out = cut_lineage(drop_duplicates(df))
    out = missing.fill(out, missing.fit_median_or_mode(out))
    out = convert.clean_text(out, blanks=False, title_below=None)
    return convert.auto_convert(out, "number")


def auto_fix(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rule-based fixes by column name and type, with the number of cells or rows each one touched."""
    rows = []
    amounts = project.named_like(numeric_columns(df), project.AMOUNT_WORDS)
    negatives = aggregate_in_jobs(df, [F.count_if(col(c) < 0).alias(c) for c in amounts]) if amounts else {}
    fixed = [c for c in amounts if negatives[c]]
    out = df.withColumns({c: F.abs(col(c)) for c in fixed}) if fixed else df
    rows += [(1, f"negative values in {c}", negatives[c]) for c in fixed]
    before = out.count()
    out = project.drop_zero_rows(out)
    after = out.count()
    rows.append((2, "rows with a zero amount", before - after))
    bounds = {c: d for c, d in outliers.fit(out, numeric_columns(out), "iqr", 3.0).items() if d.low is not None and d.high > d.low}
    if bounds:
        far = aggregate_in_jobs(out, [F.count_if(d.flag()).alias(c) for c, d in bounds.items()])
        rows += [(3, f"far values in {c}", far[c]) for c in bounds if far[c]]
        out = outliers.cap(out, {c: d for c, d in bounds.items() if far[c]})
    _, gaps, _ = missing.with_nulls(out)
    out = missing.fill(out, missing.fit_median_or_mode(out))
    rows += [(4, f"missing values in {c}", n) for c, n in gaps.items() if n]
    out = cut_lineage(drop_duplicates(out))
    rows.append((5, "duplicate rows", after - out.count()))
    out = convert.clean_text(out, blanks=False, title_below=50)
    dates = project.named_like(out.columns, project.DATE_WORDS)
    out = convert.convert_date_columns(out)
    rows.append((7, "date columns", len(dates)))
    return out, small_table(df.sparkSession, rows, REPORT)


def prepare_features(df: DataFrame, target: str, task: str = "classification") -> DataFrame:
    """Smart gaps, capped outliers, standard scale, one-hot, then the best 75 % of features; the target stays as it is."""
    inputs = df.drop(target)
    numbers = numeric_columns(inputs)
    out = missing.fill(df, missing.fit_smart(inputs))
    bounds = outliers.fit(out, numbers, "iqr")
    out = outliers.cap(out, {c: d for c, d in bounds.items() if d.low is not None})
    out = scaling.transform(out, scaling.fit(out, numbers, "standard"))
    texts = [c for c in text_columns(out) if c != target]
    out = encoding.one_hot(out, texts) if texts else out
    features = [c for c in out.columns if c != target]
    keep = max(1, int(len(features) * 0.75))
    return selection.select_features(out, features, target, "f_statistic", keep, task)[0]


def prepare_for_ml(df: DataFrame, target: str | None = None) -> tuple[DataFrame, str]:
    """One-hot without the first category, numeric target codes, standard scale; the target defaults to the last column."""
    target = target or df.columns[-1]
    texts = [c for c in text_columns(df) if c != target]
    numbers = [c for c in numeric_columns(df) if c != target]
    out = encoding.one_hot(df, texts, drop_first=True) if texts else df
    out = scaling.transform(out, scaling.fit(out, numbers, "standard"))
    if target in text_columns(df):
        out = encoding.label_encode(out, [target])
    features = [c for c in out.columns if c != target]
    return out.select(*[col(c) for c in features], col(target)), target


def auto_train(df: DataFrame, target: str, key: Sequence[str], trees: int = 100):
    """Random forest on an 80/20 split: (model, score table, five most important features)."""
    from millrace.models.supervised import Config, compare

    config = Config(target=target)
    model = compare(df, config, ["random_forest"], key, {"random_forest": {"numTrees": trees}})[0]
    name = "accuracy" if model.task == "classification" else "r2"
    score = small_table(df.sparkSession, [(model.task, name, float(model.metrics[name]))], "task string, metric string, value double")
    return model, score, model.importances().limit(5)
