"""The statistics kernel: few scans, many columns, exact results, bounded state.

* ``moments``          one aggregate for all columns (no distinct, so no row expansion)
* ``value_counts_long``one shuffle of (column, value) counts; distinct, mode and entropy follow
* ``exact_quantiles``  order statistics; exact at any size (see below)
* ``grouped_quantiles``order statistics per group, safe for hot groups
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.semantics import INTEGRAL, col, sample_kurtosis, sample_skewness
from millrace.operators.joins import small_side
from millrace.operators.ordering import CHUNK, _before, _shared, with_chunks
from millrace.session import cut_lineage

#: Histogram rows per scan of ``order_statistics``.
BINS_PER_SCAN = 65_536
#: Aggregate expressions per job. The JVM does not compile methods beyond a size a few dozen
#: aggregates reach; since a job reads only its own columns, more jobs read no more data.
EXPRESSIONS_PER_JOB = 24
JOBS_AT_ONCE = 4


def aggregate_in_jobs(df: DataFrame, exprs: Sequence[Column], limit: int = EXPRESSIONS_PER_JOB) -> dict:
    """Run many aggregates over one table and return name -> value."""
    batches = [exprs[at : at + limit] for at in range(0, len(exprs), limit)]
    run = lambda batch: df.agg(*batch).first().asDict()
    if len(batches) == 1:
        return run(batches[0])
    out: dict = {}
    for values in at_once(*[lambda b=b: run(b) for b in batches]):
        out.update(values)
    return out


def at_once(*jobs) -> list:
    """Results of independent jobs; Spark shares its slots among the ones submitted together."""
    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        return list(pool.map(lambda job: job(), jobs))


#: What ``moments`` can compute, by name.
MEASURES = {
    "count": lambda c: F.count(c),
    "mean": lambda c: F.avg(c),
    "sum": lambda c: F.sum(c),
    "std": lambda c: F.stddev_samp(c),
    "std_pop": lambda c: F.stddev_pop(c),
    "var_pop": lambda c: F.var_pop(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "max_abs": lambda c: F.max(F.abs(c)),
    "skew": sample_skewness,
    "kurt": sample_kurtosis,
}


def moments(df: DataFrame, columns: Sequence[str], want: Sequence[str]) -> dict[str, dict]:
    """``{column: {measure: value}}`` from one scan; ``rows`` of the table is under key ``""``."""
    exprs = [F.count(F.lit(1)).alias("rows")]
    names = []
    for i, c in enumerate(columns):
        for m in want:
            names.append((c, m, f"m{i}_{m}"))
            exprs.append(MEASURES[m](col(c)).alias(f"m{i}_{m}"))
    values = aggregate_in_jobs(df, exprs)
    out: dict[str, dict] = {c: {} for c in columns}
    for c, m, key in names:
        out[c][m] = values[key]
    out[""] = {"rows": values["rows"]}
    return out


def value_counts_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, l, d, s, n)``: counts of the non-null values of many columns, in one shuffle.

    A value sits in the field of its type (integer, fraction, else text), so numbers are
    grouped as numbers. Counting combines before the shuffle: a hot value costs one row per task.
    """
    pairs = []
    for c in columns:
        dtype, x = df.schema[c].dataType, col(c)
        whole = isinstance(dtype, INTEGRAL)
        part = isinstance(dtype, (T.FloatType, T.DoubleType))
        pairs.append(
            F.struct(
                F.lit(c).alias("column"),
                (x.cast("bigint") if whole else F.lit(None).cast("bigint")).alias("l"),
                (x.cast("double") if part else F.lit(None).cast("double")).alias("d"),
                (F.lit(None).cast("string") if whole or part else x.cast("string")).alias("s"),
            )
        )
    return (
        df.select(F.explode(F.array(*pairs)).alias("__pair"))
        .select("__pair.*")
        .where("l IS NOT NULL OR d IS NOT NULL OR s IS NOT NULL")
        .groupBy("column", "l", "d", "s")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def value_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: distinct values, mode (smallest on ties), its frequency, entropy in bits, count."""
    counts = value_counts_long(df, columns)
    n = F.col("n").cast("double")
    value = F.struct("l", "d", "s")
    out = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique"),
        F.min_by(value, F.struct(-F.col("n"), value)).alias("top"),
        F.max("n").alias("freq"),
        F.sum("n").alias("total"),
        (F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy"),
    )
    return out.withColumn("top", F.coalesce("top.s", F.col("top.l").cast("string"), F.col("top.d").cast("string")))


def value_facts(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """``value_summary`` as ``{column: {...}}``; a column of nulls only gets zeros."""
    facts = {c: {"unique": 0, "top": None, "freq": 0, "total": 0, "entropy": 0.0} for c in columns}
    if columns:
        for row in value_summary(df, columns).collect():
            facts[row["column"]] = row.asDict()
    return facts


def modes(df: DataFrame, columns: Sequence[str]) -> dict:
    """Most frequent value per column in the column's own type, the smallest on ties."""

    def mode(c):
        counts = df.where(col(c).isNotNull()).groupBy(col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v")).first()["v"]

    return dict(zip(columns, at_once(*[lambda c=c: mode(c) for c in columns])))


def order_statistics(
    df: DataFrame, wanted: dict[str, set[int]], ends: dict[str, tuple[float, float, int]]
) -> dict[tuple[str, int], float]:
    """Exact values at given ranks (from 0) of the finite values of numeric columns, by refining histograms.

    ``ends`` holds min, max and count of them per column. The first scan counts all columns in equal-width
    bins and keeps the smallest and largest value of each; a rank is found once its bin holds one
    value. Later scans look only into the bins that still hide a rank (a broadcast of at most one
    row per rank). Counts combine before the shuffle and the driver sees at most BINS_PER_SCAN
    rows. Three scans for a million values, five for 10^12. The smallest and the largest value of a
    bin never share a bin of the next scan, so every scan gets on and the search ends.
    """
    found: dict[tuple[str, int], float] = {}
    names, searched = [], {}
    for c, ranks in wanted.items():
        low, high, n = ends[c]
        found.update({(c, k): low if k == 0 else high for k in ranks if k == 0 or k == n - 1 or low == high})
        left = {k for k in ranks if (c, k) not in found}
        if left:
            searched[len(names)] = left
            names.append(c)
    if not names:
        return found
    spark = df.sparkSession
    first = max(64, min(4096, BINS_PER_SCAN // len(names)))
    pairs = [F.struct(F.lit(i).alias("c"), col(c).cast("double").alias("v")) for i, c in enumerate(names)]
    lows = F.array(*[F.lit(float(ends[c][0])) for c in names])
    widths = F.array(*[F.lit(float(ends[c][1]) / 2 - float(ends[c][0]) / 2) for c in names])
    values = (
        df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where(_finite(F.col("v")))
        .withColumn("b", _bin(F.col("v"), F.get(lows, F.col("c")), F.get(widths, F.col("c")), first))
    )
    counted = [F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")]
    rows = [((x["c"], x["b"]), x) for x in values.groupBy("c", "b").agg(*counted).collect()]
    # a span: (column number, first bin, bounds, ranks below it, ranks to find)
    spans = []
    for i, ranks in searched.items():
        mine = sorted((x for (c, _), x in rows if c == i), key=lambda x: x["b"])
        spans += [(i, x["b"], *s) for x, s in _hits(found, names[i], mine, 0, ranks)]
    while spans:
        bins = max(2, min(1024, BINS_PER_SCAN // len(spans)))
        table = spark.createDataFrame(
            [(k, c, b, low, high / 2 - low / 2, high) for k, (c, b, low, high, _, _) in enumerate(spans)],
            "span int, c int, b int, low double, width double, high double",
        )
        inside = values.join(F.broadcast(table), ["c", "b"]).where("v BETWEEN low AND high")
        inside = inside.select("span", "v", _bin(F.col("v"), F.col("low"), F.col("width"), bins).alias("bin"))
        by_span: dict[int, list] = {}
        for x in inside.groupBy("span", "bin").agg(*counted).collect():
            by_span.setdefault(x["span"], []).append(x)
        deeper = []
        for k, (c, b, _, _, base, ranks) in enumerate(spans):
            mine = sorted(by_span[k], key=lambda x: x["bin"])
            deeper += [(c, b, *s) for _, s in _hits(found, names[c], mine, base, ranks)]
        spans = deeper
    return found


def _finite(v: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return v.between(F.lit(-1.7976931348623157e308), F.lit(1.7976931348623157e308))


def _bin(v: Column, low: Column, width: Column, bins: int) -> Column:
    """The bin from 0; ``width`` is half of high - low, which may be too large for a double or too small to halve."""
    equal = F.least(F.floor((v / 2 - low / 2) / width * bins), F.lit(bins - 1))
    return F.when(width > 0, equal).otherwise((v > low).cast("long")).cast("int")


def _hits(found: dict, name: str, rows: list, at: int, ranks: set[int]):
    """Settle the ranks whose bin shows their value; yield the bins to look into."""
    for x in rows:
        low, high, last = x["low"], x["high"], at + x["n"] - 1
        left = set()
        for k in ranks:
            if at <= k <= last:
                if k == at or low == high:
                    found[name, k] = low
                elif k == last:
                    found[name, k] = high
                else:
                    left.add(k)
        if left:
            yield x, (low, high, at, left)
        at = last + 1


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    """Linearly interpolated quantiles of whole columns, exact and by one way at any size.

    NaN counts as null. Infinities come before and behind all other values; between an infinite and
    another value the quantile is infinite. A column without values gets None.
    """
    columns = list(columns)
    if not columns:
        return {}
    exprs = []
    for i, c in enumerate(columns):
        v = col(c).cast("double")
        inside = F.when(_finite(v), v)
        exprs += [
            F.min(inside).alias(f"lo{i}"),
            F.max(inside).alias(f"hi{i}"),
            F.count(inside).alias(f"n{i}"),
            F.count_if(v == float("-inf")).alias(f"below{i}"),
            F.count_if(v == float("inf")).alias(f"above{i}"),
        ]
    facts = aggregate_in_jobs(df, exprs)
    ends, parts, wanted = {}, {}, {}
    for i, c in enumerate(columns):
        n = facts[f"n{i}"]
        ends[c] = (facts[f"lo{i}"], facts[f"hi{i}"], n)
        parts[c] = (facts[f"below{i}"] or 0, n, (facts[f"below{i}"] or 0) + n + (facts[f"above{i}"] or 0))
        below, _, total = parts[c]
        ranks = {k for p in probs for k in (int((total - 1) * p), min(int((total - 1) * p) + 1, total - 1))}
        if n:
            wanted[c] = {k - below for k in ranks if below <= k < below + n}
    found = order_statistics(df, wanted, ends)

    def at_rank(c: str, k: int) -> float:
        below, n, _ = parts[c]
        return float("-inf") if k < below else found[c, k - below] if k < below + n else float("inf")

    out = {}
    for c in columns:
        total = parts[c][2]
        values = []
        for p in probs:
            if not total:
                values.append(None)
                continue
            at = (total - 1) * p
            low, high = at_rank(c, int(at)), at_rank(c, min(int(at) + 1, total - 1))
            values.append(low if low == high or at == int(at) else low + (high - low) * (at - int(at)))
        out[c] = values
    return out


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Exact quantiles per group, one output column per entry of ``probs``.

    Equal values are counted before the shuffle, the (group, value) order is numbered across
    chunks, and each group keeps the two values around every wanted rank: no group has to fit in
    one task. NaN counts as null; infinities come first and last.
    """
    data = df.select(*[col(k) for k in keys], col(value).cast("double").alias("__v"))
    data = data.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    counts = cut_lineage(data.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n")))
    chunked, chunks = with_chunks(counts, keys, ["__v"], rows_per_chunk)
    order = [col(k) for k in [*keys, "__v"]]
    here = F.sum("__n").over(Window.partitionBy(CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    totals = _before(chunked.groupBy(CHUNK).agg(F.sum("__n").alias("__carry")), ["__carry"], chunks)
    carry = _shared(totals.select(CHUNK, F.coalesce("__carry", F.lit(0)).alias("__carry")), chunks)
    placed = chunked.withColumn("__here", here).join(carry, CHUNK)
    placed = placed.withColumn("__end", F.col("__here") + F.col("__carry"))
    groups = placed.groupBy(*[col(k).alias(f"__key_{k}") for k in keys]).agg(
        F.sum("__n").alias("__size"), F.min(F.col("__end") - F.col("__n")).alias("__base")
    )
    same = reduce(and_, [col(k).eqNullSafe(col(f"__key_{k}")) for k in keys])
    both = placed.join(small_side(groups), same).withColumn("__upto", F.col("__end") - F.col("__base"))
    outs = []
    for n, p in probs.items():
        at = (F.col("__size") - 1) * F.lit(float(p))
        low_rank = F.floor(at)
        high_rank = F.least(low_rank + 1, F.col("__size") - 1)
        covers = lambda r: (F.col("__upto") - F.col("__n") <= r) & (r < F.col("__upto"))
        low, high = F.max(F.when(covers(low_rank), F.col("__v"))), F.max(F.when(covers(high_rank), F.col("__v")))
        part = F.max(at - low_rank)
        outs.append(F.when((low == high) | (part == 0), low).otherwise(low + (high - low) * part).alias(n))
    return both.groupBy(*keys).agg(*outs)
