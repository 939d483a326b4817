"""Exact nearest rows for imputation and KNN models, without comparing all pairs.

Donors are cut into cells by a tree of cells: at most ``FAN`` of them by a k-d tree on sampled cut points, and each
that is still large into as many again, level by level. The cells of a level are a table with a box (value range per
column, and which columns have gaps) and a count each, so a query knows a lower bound of its distance to every cell. First it
searches its nearest cells, which bounds its k-th distance; then it visits only the cells whose bound is below that. Both
searches go down the levels by joins, and are exact whatever the cut points.

Skew: equal donors are counted before they are shuffled; a cell with many donors is cut into
blocks, one with many queries into chunks, so no task gets more than BLOCK x CHUNK rows.
Distance is Euclidean over the columns both rows have, scaled up for the missing ones; or, for columns without gaps, the
largest difference of any column.
Of equally distant donors the smaller value goes first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.session import cut_lineage

CELL_ROWS = 4_000
#: Cells that one level of the tree makes of a cell, and levels at most: a box's number has to fit 63 bits.
FAN, LEVELS = 1_024, 6
#: Sampled donors for each cell that a level makes.
SAMPLE = 64
#: A column with gaps in this share of a cell's rows, or known in no more of them, splits the cell by the gaps.
MIXED = 0.125
BLOCK = 20_000
CHUNK = 50_000
TILE = 4_000_000


def _vector(columns: Sequence[Column]) -> Column:
    return F.array(*[F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in columns])


def _cut(rows: np.ndarray) -> tuple[int, float] | None:
    """Column and value that split the rows; the value is NaN if gaps go left and known values right."""
    share = np.isnan(rows).mean(axis=0)
    mixed = np.minimum(share, 1 - share)
    by_gap = int(np.argmax(mixed))
    if mixed[by_gap] >= MIXED:
        return by_gap, float("nan")
    low, high = np.fmin.reduce(rows, axis=0), np.fmax.reduce(rows, axis=0)
    with np.errstate(invalid="ignore"):
        spread = np.where(high > low, high - low, 0.0)
    c = int(np.argmax(spread))
    if spread[c] > 0:
        known = np.sort(rows[~np.isnan(rows[:, c]), c])
        middle = known[len(known) // 2]
        return c, float(middle if middle > known[0] else known[known > known[0]][0])
    return (by_gap, float("nan")) if mixed[by_gap] > 0 else None


def _right(v: np.ndarray, cut) -> np.ndarray:
    return np.where(np.isnan(cut), ~np.isnan(v), v >= cut)


def _grow(sample: np.ndarray, leaves: int) -> tuple[list[int], list[float], list[int]]:
    """Column, cut and left child of every node, the largest split first; a leaf has column -1 and its own number."""
    column, cut, kid = [-1], [0.0], [0]
    open_ = [(-len(sample), 0, sample)] if len(sample) > 1 else []
    made = 1
    while open_ and made < leaves:
        _, node, rows = heapq.heappop(open_)
        found = _cut(rows)
        if found is None:
            continue
        column[node], cut[node], kid[node] = *found, len(column)
        right = _right(rows[:, found[0]], found[1])
        for some in (rows[~right], rows[right]):
            if len(some) > 1:
                heapq.heappush(open_, (-len(some), len(column), some))
            column.append(-1)
            cut.append(0.0)
            kid.append(0)
        made += 1
    for number, node in enumerate(i for i, c in enumerate(column) if c < 0):
        kid[node] = number
    return column, cut, kid


def _leaf(tree, x: np.ndarray) -> np.ndarray:
    """The number of the leaf of every row."""
    column, cut, kid = np.asarray(tree[0]), np.asarray(tree[1], float), np.asarray(tree[2])
    node = np.zeros(len(x), np.int64)
    rows = np.flatnonzero(column[node] >= 0)
    while len(rows):
        at = node[rows]
        node[rows] = kid[at] + _right(x[rows, column[at]], cut[at])
        rows = rows[column[node[rows]] >= 0]
    return kid[node]


def _matrix(lists, width: int) -> np.ndarray:
    return np.array(list(lists), dtype=float).reshape(len(lists), width)


class _Boxes:
    """Bounds and counts of cells with one parent, at most ``FAN``."""

    def __init__(self, rows: pd.DataFrame, width: int, largest: bool = False):
        self.ids = rows["box"].to_numpy(np.int64)
        self.low, self.high = _matrix(rows["low"], width), _matrix(rows["high"], width)
        known = _matrix(rows["known"], width)
        self.some, self.full = known > 0, known == rows["kinds"].to_numpy()[:, None]
        self.counts = np.array(rows["counts"].tolist(), dtype=np.int64).reshape(len(rows), -1)
        self.width, self.largest = width, largest

    def lower(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bound of the squared distance of each query to each box, infinite where nothing compares, and whether all rows compare.

        The distance is a mean over the columns that both have. Of columns that only some rows of the box have, those with
        the least gaps are taken as long as they lower the mean: no row of the box is nearer.
        """
        total = np.zeros((len(x), len(self.ids)))
        shared = np.zeros_like(total)
        maybe = []
        for i in range(self.width):
            v = x[:, i : i + 1]
            with np.errstate(invalid="ignore"):
                gap = np.fmax(np.fmax(self.low[None, :, i] - v, v - self.high[None, :, i]), 0.0) ** 2
            known = ~np.isnan(v) & self.some[None, :, i]
            sure = known & self.full[None, :, i]
            total = np.maximum(total, gap) if self.largest else total + np.where(sure, gap, 0.0)
            shared += sure
            if not self.full[:, i].all():
                maybe.append(np.where(known & ~sure, gap, np.inf))
        compares = shared > 0
        if self.largest:
            return total, compares
        with np.errstate(divide="ignore", invalid="ignore"):
            best = np.where(compares, total / shared, np.inf)
        for gap in np.sort(np.array(maybe), axis=0) if maybe else ():
            total, shared = total + gap, shared + 1
            best = np.minimum(best, total / shared)
        return best * self.width, compares


def _choose(boxes: _Boxes, queries: pd.DataFrame, k: int, first: bool) -> Iterator[pd.DataFrame]:
    """The cells that each (query, wanted value) visits: the nearest that hold k, or those below its radius.

    ``was`` says that the first search goes to the cell too.
    """
    step = max(1, TILE // max(1, len(boxes.ids) * (4 + boxes.width)))
    for at in range(0, len(queries), step):
        part = queries.iloc[at : at + step]
        x = _matrix(part["x"], boxes.width)
        slots = part["slot"].to_numpy()
        bound, compares = boxes.lower(x)
        have = boxes.counts[:, slots].T
        bound = np.where(have > 0, bound, np.inf)
        order = np.argsort(bound, axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        # a box in which some rows have nothing to compare by never counts toward k
        counted = np.where(np.isfinite(bound) & compares, have, 0)
        ahead = np.take_along_axis(np.cumsum(np.take_along_axis(counted, order, 1), 1), rank, 1)
        near = (ahead - counted < k) & np.isfinite(bound)
        if first:
            visit = near
        else:
            r2 = part["radius"].to_numpy(dtype=float)[:, None] ** 2
            r2 = np.where(np.isnan(r2), np.inf, r2)
            visit = np.isfinite(bound) & (bound <= r2 * (1 + 1e-9) + 1e-12)
        q, b = np.nonzero(visit)
        yield pd.DataFrame(
            {
                "q": part["q"].to_numpy()[q],
                "slot": slots[q].astype(np.int32),
                "x": pd.Series(list(x[q]), dtype=object),
                "radius": part["radius"].to_numpy(dtype=float)[q],
                "was": part["was"].to_numpy(dtype=bool)[q] & near[q, b],
                "box": boxes.ids[b],
            }
        )


ROUTED = "q bigint, slot int, x array<double>, radius double, was boolean, box bigint"


def _dealt(rows: DataFrame, boxes: DataFrame, per_part: int, name: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the part of their box, and ``boxes`` (box, ...) once for each part of at most about so many rows."""
    sizes = rows.groupBy("box").agg(F.ceil(F.count(F.lit(1)) / per_part).cast("int").alias("parts"))
    many = sizes.where("parts > 1")
    part = F.coalesce(F.pmod(name, F.col("parts")).cast("int"), F.lit(0))
    left = rows.join(many, "box", "left").withColumn("part", part).drop("parts")
    right = boxes.join(sizes, "box").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left, right


def _route(queries: DataFrame, top: pd.DataFrame, levels: list[DataFrame], width: int, k: int, first: bool, largest: bool) -> DataFrame:
    """Queries (q, slot, x, radius) once for each leaf cell they visit; the second search leaves out those of the first."""
    boxes = _Boxes(top, width, largest)

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _choose(boxes, batch, k, first)

    def down(key: tuple, some: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
        if not len(some):  # a part that the hash left empty
            return some[["q", "slot", "x", "radius", "was", "box"]]
        return pd.concat(list(_choose(_Boxes(below, width, largest), some, k, first)))

    at = cut_lineage(queries.withColumn("was", F.lit(True)).mapInPandas(start, ROUTED))
    leaves = None
    for level in levels:
        parents = level.select(F.col("parent").alias("box")).distinct()
        ends = at.join(parents, "box", "left_anti")
        leaves = ends if leaves is None else leaves.unionByName(ends)
        inner, heads = _dealt(at.join(parents, "box", "left_semi"), parents, CHUNK, F.xxhash64("q", "slot"))
        below = level.withColumnRenamed("box", "child").withColumnRenamed("parent", "box").join(heads, "box")
        below = below.withColumnRenamed("box", "parent").withColumnRenamed("child", "box")
        at = cut_lineage(inner.groupBy("box", "part").cogroup(below.groupBy("parent", "part")).applyInPandas(down, ROUTED))
    out = at if leaves is None else leaves.unionByName(at)
    return out if first else out.where("NOT was")


def _facts(placed: DataFrame, width: int, slots: int) -> DataFrame:
    """One row for each cell: bounds, known values of each column, weight of each wanted value, different donors."""
    real = lambda a, i: F.when(~F.isnan(F.get(a, F.lit(i))), F.get(a, F.lit(i)))
    gap = F.lit(float("nan"))
    return placed.groupBy("parent", "box").agg(
        F.array(*[F.coalesce(F.min(real("x", i)), gap) for i in range(width)]).alias("low"),
        F.array(*[F.coalesce(F.max(real("x", i)), gap) for i in range(width)]).alias("high"),
        F.array(*[F.count(real("x", i)) for i in range(width)]).alias("known"),
        F.array(*[F.coalesce(F.sum(F.when(real("values", i).isNotNull(), F.col("w"))), F.lit(0)) for i in range(slots)]).alias("counts"),
        F.count(F.lit(1)).alias("kinds"),
    )


def _partition(donors: DataFrame, kinds: int, width: int, slots: int, cell_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """Donors with the number of their leaf cell, and the cells of each level (parent, box and :func:`_facts`).

    A cell with more than twice ``cell_rows`` different donors is cut again, until none is left or its sample has one
    kind of x only; such a cell is met in blocks. Tasks hold a sample of one cell, or a part of its rows.
    """
    base = FAN + 1
    leaves = min(FAN, max(1, kinds // cell_rows))
    sample = donors.select("x").sample(fraction=min(1.0, SAMPLE * leaves / kinds), seed=11).limit(2 * SAMPLE * leaves).collect() if leaves > 1 else []
    tree = _grow(_matrix([r["x"] for r in sample], width), leaves)

    @F.pandas_udf("bigint")
    def leaf(x: pd.Series) -> pd.Series:
        return pd.Series(_leaf(tree, _matrix(x, width)) + 1)

    def grow(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        made = _grow(_matrix(some["x"], width), int(some["leaves"].iloc[0]))
        return pd.DataFrame({"box": [key[0]], "columns": [made[0]], "cuts": [made[1]], "kids": [made[2]]})

    def move(key: tuple, rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if not len(trees):
            return rows[:0].assign(parent=key[0])[["parent", "box", "x", "values", "w"]]
        found = trees.iloc[0]
        child = key[0] * base + _leaf((found["columns"], found["cuts"], found["kids"]), _matrix(rows["x"], width)) + 1
        return rows.assign(parent=key[0], box=child)[["parent", "box", "x", "values", "w"]]

    schema = "parent bigint, box bigint, x array<double>, values array<double>, w bigint"
    placed = donors.select(F.lit(0).cast("bigint").alias("parent"), (leaf("x") if leaves > 1 else F.lit(1).cast("bigint")).alias("box"), "x", "values", "w")
    placed = cut_lineage(placed)
    levels = [cut_lineage(_facts(placed, width, slots))]
    placed = placed.drop("parent")
    while len(levels) < LEVELS:
        large = levels[-1].where(F.col("kinds") > 2 * cell_rows).select("box", "kinds", F.least(F.lit(FAN), F.floor(F.col("kinds") / cell_rows)).cast("int").alias("leaves"))
        if large.isEmpty():
            break
        drawn = placed.join(large, "box")
        drawn = drawn.where(F.pmod(F.xxhash64("values", "x"), F.lit(1 << 30)) < SAMPLE * F.col("leaves") / F.col("kinds") * (1 << 30)).select("box", "x", "leaves")
        trees = drawn.groupBy("box").applyInPandas(grow, "box bigint, columns array<int>, cuts array<double>, kids array<int>")
        trees = cut_lineage(trees.where(F.size("columns") > 1))
        if trees.isEmpty():
            break
        rows, heads = _dealt(placed.join(trees.select("box"), "box", "left_semi"), trees, BLOCK * 10, F.xxhash64("x", "values"))
        moved = rows.groupBy("box", "part").cogroup(heads.groupBy("box", "part")).applyInPandas(move, schema)
        moved = cut_lineage(moved)
        levels.append(cut_lineage(_facts(moved, width, slots)))
        placed = cut_lineage(placed.join(trees.select("box"), "box", "left_anti").unionByName(moved.drop("parent")))
    return placed, levels


def _search(k: int, largest: bool = False):
    """Up to k nearest donors of each query within one (cell, block)."""

    def run(queries: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "slot": [], "d": [], "v": [], "w": []}
        if len(queries) and len(donors):
            dx = np.array(donors["x"].tolist(), dtype=float)
            dv = np.array(donors["values"].tolist(), dtype=float)
            dw = donors["w"].to_numpy()
            width = dx.shape[1]
            for slot, mine in queries.groupby("slot"):
                have = ~np.isnan(dv[:, slot])
                x, v, w = dx[have], dv[have, slot], dw[have]
                if not len(v):
                    continue
                by_value = np.argsort(v, kind="stable")
                x, v, w = x[by_value], v[by_value], w[by_value]
                ids = mine["q"].to_numpy()
                qx = np.array(mine["x"].tolist(), dtype=float)
                step = max(1, TILE // (len(v) * 2))
                for at in range(0, len(ids), step):
                    some = qx[at : at + step]
                    total = np.zeros((len(some), len(v)))
                    shared = np.zeros_like(total)
                    for i in range(width):
                        gap = some[:, i : i + 1] - x[None, :, i]
                        known = ~np.isnan(gap)
                        total = np.maximum(total, gap * gap) if largest else total + np.where(known, gap * gap, 0.0)
                        shared += known
                    with np.errstate(divide="ignore", invalid="ignore"):
                        d = np.sqrt(total) if largest else np.where(shared > 0, np.sqrt(total * (width / shared)), np.inf)
                    # donors are in value order, so a stable sort breaks distance ties by value
                    take = min(k, d.shape[1])
                    if take < d.shape[1]:
                        kth = np.partition(d, take - 1, axis=1)[:, take - 1]
                    else:
                        kth = np.full(len(d), np.inf)
                    for j in range(len(d)):
                        near = np.flatnonzero((d[j] <= kth[j]) & np.isfinite(d[j]))
                        near = near[np.argsort(d[j][near], kind="stable")][:take]
                        out["q"].append(np.full(len(near), ids[at + j]))
                        out["slot"].append(np.full(len(near), slot))
                        out["d"].append(d[j][near])
                        out["v"].append(v[near])
                        out["w"].append(w[near])
        joined = {n: np.concatenate(a) if a else np.array([]) for n, a in out.items()}
        return pd.DataFrame(joined).astype({"q": "int64", "slot": "int32", "d": float, "v": float, "w": "int64"})

    return lambda key, queries, donors: run(queries, donors)


FOUND = "q bigint, slot int, d double, v double, w bigint"


def _visit(routed: DataFrame, donors: DataFrame, sizes: DataFrame, k: int, largest: bool) -> DataFrame:
    """Run the search where routed queries and donors meet, in blocks and chunks of bounded size."""
    asked = routed.groupBy("box").agg(F.count(F.lit(1)).alias("n")).join(sizes, "box")
    plan = asked.select("box", F.ceil(F.col("kinds") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    plan = cut_lineage(plan)
    queries = (
        routed.join(plan, "box")
        .withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("box", "block", "chunk", "q", "slot", "x")
    )
    sides = (
        donors.join(plan, "box")
        .withColumn("block", F.pmod(F.xxhash64("x", "values"), F.col("blocks")).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("box", "block", "chunk", "x", "values", "w")
    )
    keys = ["box", "block", "chunk"]
    return queries.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInPandas(_search(k, largest), FOUND)


def nearest(
    queries: DataFrame, donors: DataFrame, width: int, k: int, cell_rows: int | None = None, largest: bool = False
) -> DataFrame:
    """``(q, slot, near)``: the k nearest donors that have value number ``slot``.

    ``queries``: q bigint, slot int, x array<double>. ``donors``: x and values, both array<double>,
    NaN where missing, and w bigint if a row stands for several. ``near`` is an array of (d, v, w) in order, whose weights reach k. Without donors there is no row.
    ``largest``: the distance is the largest difference of any column; x has no gaps then.
    """
    weight = F.sum("w") if "w" in donors.columns else F.count(F.lit(1))
    donors = cut_lineage(donors.groupBy("x", "values").agg(weight.alias("w")))
    queries = cut_lineage(queries.select("q", "slot", "x"))
    kinds = donors.count()
    if not kinds:
        return _merge(queries.sparkSession.createDataFrame([], FOUND), k)
    placed, levels = _partition(donors, kinds, width, len(donors.first()["values"]), cell_rows or CELL_ROWS)
    top = pd.DataFrame([r.asDict() for r in levels[0].collect()])  # at most FAN rows
    sizes = reduce(DataFrame.unionByName, [level.select("box", "kinds") for level in levels])
    first = _route(queries.withColumn("radius", F.lit(None).cast("double")), top, levels[1:], width, k, True, largest)
    hits = _visit(first, placed, sizes, k, largest)
    if len(top) > 1 or len(levels) > 1:
        hits = cut_lineage(hits)
        radius = _merge(hits, k).select("q", "slot", _reach(k).alias("radius"))
        second = _route(queries.join(radius, ["q", "slot"], "left"), top, levels[1:], width, k, False, largest)
        hits = hits.unionByName(_visit(second, placed, sizes, k, largest))
    return _merge(hits, k)


def _merge(hits: DataFrame, k: int) -> DataFrame:
    """At most k entries per visited block come together per query."""
    near = F.sort_array(F.collect_list(F.struct("d", "v", "w")))
    merged = hits.groupBy("q", "slot").agg(near.alias("near"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<struct<d:double,v:double,w:bigint>>").alias("a"))

    def take(acc, x):
        room = F.lit(k) - acc["n"]
        used = F.least(room, x["w"])
        item = F.struct(x["d"].alias("d"), x["v"].alias("v"), used.alias("w"))
        more = F.struct((acc["n"] + used).alias("n"), F.concat(acc["a"], F.array(item)).alias("a"))
        return F.when(room > 0, more).otherwise(acc)

    return merged.withColumn("near", F.aggregate("near", start, take, lambda acc: acc["a"]))


def _reach(k: int) -> Column:
    """Distance of the k-th donor, or null while fewer were found."""
    found = F.aggregate("near", F.lit(0).cast("bigint"), lambda a, x: a + x["w"])
    return F.when(found >= k, F.element_at("near", -1)["d"])


def mean_of_near() -> Column:
    total = F.aggregate("near", F.lit(0.0), lambda a, x: a + x["v"] * x["w"])
    return total / F.aggregate("near", F.lit(0).cast("bigint"), lambda a, x: a + x["w"])


def vote_of_near() -> Column:
    """Value with the largest weight among the nearest, the smallest on ties."""
    values = F.array_sort(F.array_distinct(F.transform("near", lambda x: x["v"])))
    weigh = lambda v: F.aggregate(
        F.filter("near", lambda x: x["v"] == v), F.lit(0).cast("bigint"), lambda a, x: a + x["w"]
    )
    ranked = F.transform(values, lambda v: F.struct((-weigh(v)).alias("n"), v.alias("v")))
    return F.array_min(ranked)["v"]


def knn_impute(df: DataFrame, columns: Sequence[str], k: int = 5, cell_rows: int | None = None) -> DataFrame:
    """Fill gaps in ``columns`` with the mean of the k nearest rows that have the value.

    Rows with the same gaps and values need the same answer, so each kind of row asks once. A row
    with nothing to compare by gets the column mean.
    """
    columns = list(columns)
    x = _vector([col(c) for c in columns])
    gaps = reduce(or_, [col(c).isNull() for c in columns])
    donors = df.select(x.alias("x"), x.alias("values"))
    if df.where(gaps).limit(1).count() == 0:
        return df
    # the ids are drawn once: the checkpoint keeps them
    short = cut_lineage(df.where(gaps).select(x.alias("x")).distinct().withColumn("q", F.monotonically_increasing_id()))
    asked = short.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))))
    asked = asked.where(F.isnan(F.get("x", F.col("slot"))))
    answers = nearest(asked.select("q", "slot", "x"), donors, len(columns), k, cell_rows)
    filled = answers.groupBy("q").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", mean_of_near().alias("v")))).alias("__fill")
    )
    per_row = short.join(filled, "q").select(F.col("x").alias("__x"), "__fill")
    means = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    # Only rows with a gap meet the answers; the others go on as they are, without a shuffle.
    whole = df.where(~gaps).withColumns({c: col(c).cast("double") for c in columns})
    out = df.where(gaps).withColumn("__q", x).join(per_row, F.col("__q") == F.col("__x"), "left")
    fill = {
        c: F.coalesce(col(c).cast("double"), F.col("__fill")[i], F.lit(means[f"m{i}"])) for i, c in enumerate(columns)
    }
    return whole.unionByName(out.withColumns(fill).select(*[col(c) for c in df.columns]))


def knn_predict(
    train: DataFrame,
    rows: DataFrame,
    features: Sequence[str],
    target: str,
    k: int = 5,
    task: str = "classification",
    cell_rows: int | None = None,
) -> DataFrame:
    """``rows`` with a ``prediction``: the vote or the mean of the k nearest training rows."""
    x = _vector([col(f) for f in features])
    label = col(target)
    names = None
    if task == "classification":
        from millrace.operators.encoding import categories

        names = categories(train.where(label.isNotNull()), target)
        code = F.array_position(F.array(*[F.lit(n) for n in names]), label.cast("string")) - 1
    else:
        code = label
    donors = train.where(label.isNotNull()).select(x.alias("x"), F.array(code.cast("double")).alias("values"))
    asked = cut_lineage(rows.select(x.alias("x")).distinct().withColumn("q", F.monotonically_increasing_id()))
    found = nearest(asked.select("q", F.lit(0).alias("slot"), "x"), donors, len(features), k, cell_rows)
    value = vote_of_near() if names else mean_of_near()
    answers = asked.join(found, "q").select(F.col("x").alias("__x"), value.alias("prediction"))
    out = rows.withColumn("__q", x).join(answers, F.col("__q") == F.col("__x"), "left").drop("__q", "__x")
    if names:
        label_of = F.array(*[F.lit(n) for n in names])
        out = out.withColumn("prediction", F.get(label_of, F.col("prediction").cast("int")))
    return out
