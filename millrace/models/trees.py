"""Trees grown level by level over a distributed table: extra trees, and boosting with gradients and curvatures.

A level of all trees takes one aggregate (extra trees: two). Tasks send their rows down the trees that are known, add up what
the open nodes need in numpy and emit one row for each (node, candidate) or (node, feature, bin); Spark adds these up, and the
driver, which holds the trees alone, chooses the splits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.operators.stats import exact_quantiles
from millrace.session import cut_lineage

#: Nodes that one aggregate serves; more open nodes of a level take several.
NODES_AT_ONCE = 50_000
#: Rounds of boosting after which the scores of rows are written, so that scans only walk the trees of fewer rounds.
WRITE_EVERY = 8


@dataclass
class Tree:
    """Nodes by number; a leaf has feature -1. A missing value goes left where ``gap_left`` says so."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    gap_left: list[bool] = field(default_factory=lambda: [True])
    value: list[list[float]] = field(default_factory=lambda: [[0.0]])

    def split(self, node: int, feature: int, cut: float, gap_left: bool, values) -> int:
        """Make two leaves below ``node``; returns the number of the left one."""
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.gap_left[node] = feature, cut, at, gap_left
        for v in values:
            self.feature.append(-1)
            self.cut.append(0.0)
            self.left.append(0)
            self.gap_left.append(True)
            self.value.append(v)
        return at


def _packed(tree: Tree) -> tuple:
    return np.array(tree.feature), np.array(tree.cut), np.array(tree.left), np.array(tree.gap_left), np.array(tree.value, float)


def _walk(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    feature, cut, left, gap_left, _ = tree
    node = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while len(rows):
        f = feature[node[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        if not len(rows):
            break
        at = node[rows]
        v = x[rows, f]
        goes_left = np.where(np.isnan(v), gap_left[at], v <= cut[at])
        node[rows] = left[at] + ~goes_left
    return node


@dataclass
class Trees:
    """``base`` plus the sum of the trees' leaves, or their mean; probabilities by the ``link``."""

    features: tuple[str, ...]
    trees: list[Tree]
    places: list[int]
    base: list[float]
    mean: bool
    link: str
    gains: list[float]

    def raw(self):
        """An array of scores, by an Arrow function over the feature columns."""
        packed, places, base, mean = [_packed(t) for t in self.trees], self.places, np.array(self.base), self.mean

        def score(columns: pd.DataFrame) -> pd.Series:
            x = columns.to_numpy(dtype=float)
            return pd.Series(list(_scores(packed, places, base, mean, x)))

        return F.pandas_udf(score, "array<double>")(F.struct(*[col(f).cast("double").alias(f"x{i}") for i, f in enumerate(self.features)]))

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("__raw", self.raw())
        if self.link == "number":
            return out.withColumn("prediction", F.get("__raw", F.lit(0))).drop("__raw")
        if self.link == "logistic":
            p = 1 / (1 + F.exp(-F.get("__raw", F.lit(0))))
            chances = F.array(1 - p, p)
        elif self.link == "softmax":
            top = F.array_max("__raw")
            shifted = F.transform("__raw", lambda s: F.exp(s - top))
            chances = F.transform(shifted, lambda s: s / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))
        else:
            chances = F.col("__raw")
        out = out.withColumn("probability", chances)
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double")).drop("__raw")

    def importance(self) -> list[tuple[str, float]]:
        total = sum(self.gains) or 1.0
        return [(f, g / total) for f, g in zip(self.features, self.gains)]


def _scores(packed, places, base, mean: bool, x: np.ndarray) -> np.ndarray:
    out = np.tile(base, (len(x), 1))
    for tree, place in zip(packed, places):
        found = tree[4][_walk(tree, x)]
        if place < 0:
            out += found
        else:
            out[:, place] += found[:, 0]
    return out / max(len(packed), 1) if mean else out


def _columns(data: DataFrame, features: Sequence[str]) -> DataFrame:
    return cut_lineage(data.select(*[col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col("__label").cast("double").alias("y")))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Feature columns as a matrix; a null is a NaN."""
    if not width:
        return np.zeros((batch.num_rows, 0))
    return np.stack([batch[f"x{i}"].to_numpy(zero_copy_only=False).astype(float) for i in range(width)], axis=1)


# --- extra trees ------------------------------------------------------------------------------


def _impurity(sums: np.ndarray, classes: int) -> np.ndarray:
    """Rows times Gini impurity, or the sum of squares around the mean, of sums over rows (last axis)."""
    if classes:
        n = sums.sum(axis=-1)
        return n - (sums**2).sum(axis=-1) / np.maximum(n, 1)
    return sums[..., 2] - sums[..., 1] ** 2 / np.maximum(sums[..., 0], 1)


def _counted(y: np.ndarray, classes: int) -> np.ndarray:
    return np.eye(classes)[y.astype(int)] if classes else np.stack([np.ones(len(y)), y, y * y], axis=1)


def _gather(rows: DataFrame, width: int, packed: list, slots: list[np.ndarray], wanted: np.ndarray, cuts: np.ndarray | None, classes: int) -> dict[int, np.ndarray]:
    """For each (open node, candidate): lowest and highest value, or if ``cuts`` are given the sums left of them.

    ``slots`` has for each tree the place of every node among the open ones, or -1; ``wanted`` the candidate features of these.
    """
    k = wanted.shape[1]
    sums = classes or 3

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if cuts is None:
            state = np.full((len(wanted), k, 2), np.inf)
        else:
            state = np.zeros((len(wanted), k, sums))
        for batch in batches:
            x, y = _matrix(batch, width), np.asarray(batch["y"], float)
            each = _counted(y, classes)
            for tree, slot in zip(packed, slots):
                at = slot[_walk(tree, x)]
                order = np.argsort(at, kind="stable")
                order = order[at[order] >= 0]
                if not len(order):
                    continue
                here = at[order]
                starts = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
                nodes = here[starts]
                for j in range(k):
                    v = x[order, wanted[here, j]]
                    if cuts is None:
                        state[nodes, j, 0] = np.minimum(state[nodes, j, 0], np.minimum.reduceat(v, starts))
                        state[nodes, j, 1] = np.minimum(state[nodes, j, 1], np.minimum.reduceat(-v, starts))
                    else:
                        state[nodes, j] += np.add.reduceat(each[order] * (v <= cuts[here, j])[:, None], starts, axis=0)
        flat = state.reshape(-1, state.shape[2])
        some = np.flatnonzero(np.isfinite(flat[:, 0]) if cuts is None else flat.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(flat[some, c]) for c in range(flat.shape[1]))], ["id", *(f"v{c}" for c in range(flat.shape[1]))])

    names = [f"v{c}" for c in range(2 if cuts is None else sums)]
    parts = rows.mapInArrow(add, "id long, " + ", ".join(f"{n} double" for n in names))
    join = F.min if cuts is None else F.sum
    got = parts.groupBy("id").agg(*[join(n).alias(n) for n in names]).toPandas()
    return dict(zip(got["id"].tolist(), got[names].to_numpy(float)))


def fit_extra_trees(data: DataFrame, features: Sequence[str], classes: int, numTrees: int = 100, maxDepth: int = 10, minInstances: int = 1, tries: int | None = None, seed: int = 43, **_) -> Trees:
    """Extremely randomised trees (Geurts et al. 2006): each open node draws ``tries`` features and for each a cut between the
    lowest and highest value in it; the best cut splits. Every tree sees all rows. ``classes`` is 0 for numbers.

    ``tries`` is the root of the number of features for classes and all of them for numbers, unless given.
    """
    rows, width = _columns(data, features), len(features)
    k = tries or (max(1, int(width**0.5)) if classes else width)
    total = rows.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([c]) for c in _counted(np.asarray(b["y"], float), classes).sum(axis=0)], [f"v{i}" for i in range(classes or 3)]) for b in bs if b.num_rows), ", ".join(f"v{i} double" for i in range(classes or 3)))
    root = np.array([x or 0.0 for x in total.agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(classes or 3)]).first()])

    def leaf(sums):
        return (sums / max(sums.sum(), 1)).tolist() if classes else [float(sums[1] / max(sums[0], 1))]

    size = lambda s: s.sum() if classes else s[0]
    forest = [Tree(value=[leaf(root)]) for _ in range(numTrees)]
    gains = np.zeros(width)
    open_ = [(t, 0, root) for t in range(numTrees)] if width and _impurity(root, classes) > 1e-12 else []
    for level in range(maxDepth):
        after = []
        for start in range(0, len(open_), NODES_AT_ONCE):
            some = open_[start : start + NODES_AT_ONCE]
            wanted = np.zeros((len(some), k), np.int64)
            draws = np.zeros((len(some), k))
            slots = [np.full(len(t.feature), -1) for t in forest]
            for i, (t, node, _) in enumerate(some):
                r = np.random.default_rng((seed, t, node))
                wanted[i], draws[i] = r.permutation(width)[:k], r.random(k)
                slots[t][node] = i
            packed = [_packed(t) for t in forest]
            ends = _gather(rows, width, packed, slots, wanted, None, classes)
            cuts = np.full((len(some), k), np.nan)
            for at, (low, minus_high) in ends.items():
                if -minus_high > low:
                    cuts[at // k, at % k] = low + (-minus_high - low) * draws[at // k, at % k]
            sums = _gather(rows, width, packed, slots, wanted, cuts, classes)
            for i, (t, node, whole) in enumerate(some):
                best = None
                for j in range(k):
                    left = sums.get(i * k + j)
                    if left is None or np.isnan(cuts[i, j]):
                        continue
                    right = whole - left
                    if min(size(left), size(right)) < minInstances:
                        continue
                    gain = float(_impurity(whole, classes) - _impurity(left, classes) - _impurity(right, classes))
                    if best is None or gain > best[0] + 1e-9 * (1 + abs(best[0])):  # equal up to rounding: the first
                        best = (gain, j, left, right)
                if best is None:
                    continue
                gain, j, left, right = best
                gains[wanted[i, j]] += max(gain, 0.0) / max(size(root), 1)
                at = forest[t].split(node, int(wanted[i, j]), float(cuts[i, j]), True, [leaf(left), leaf(right)])
                after += [(t, at + b, s) for b, s in enumerate((left, right)) if size(s) >= 2 * minInstances and _impurity(s, classes) > 1e-9 * max(size(s), 1)]
        open_ = after
        if not open_:
            break
    return Trees(tuple(features), forest, [-1] * numTrees, [0.0] * (classes or 1), True, "share" if classes else "number", gains.tolist())


# --- boosting with gradients and curvatures ---------------------------------------------------


def slopes(scores: np.ndarray, y: np.ndarray, link: str) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss at the scores, one column for each tree of a round."""
    if link == "number":
        return scores - y[:, None], np.ones_like(scores)
    if link == "logistic":
        p = 1 / (1 + np.exp(-scores))
        return p - y[:, None], p * (1 - p)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return p - np.eye(scores.shape[1])[y.astype(int)], p * (1 - p)


def best_split(hist: np.ndarray, lam: float, gamma: float, least: float) -> tuple | None:
    """(gain, feature, bin, gap_left) of a node's histogram [feature, bin, (g, h)], whose last bin holds the missing values."""
    gap = hist[:, -1:, :]
    run = np.cumsum(hist[:, :-1, :], axis=1)
    whole = hist[0].sum(axis=0) if len(hist) else np.zeros(2)
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + lam)
    best = None
    for gap_left in (True, False):
        left = run + gap if gap_left else run
        right = whole - left
        gain = 0.5 * (worth(left) + worth(right) - worth(whole)) - gamma
        gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), gain, -np.inf)
        if gain.size and np.isfinite(gain).any():
            # Of splits that are equal up to rounding the first, whatever the order in which tasks were added up.
            most = float(gain.max())
            f, b = np.unravel_index(np.argmax(gain >= most - 1e-9 * (1 + abs(most))), gain.shape)
            if most > 1e-9 and (best is None or most > best[0] + 1e-9 * (1 + abs(most))):
                best = (most, int(f), int(b), gap_left)
    return best


def _histograms(rows: DataFrame, width: int, outputs: int, edges: list, base, done: list, places: list, grown: list, slots: list, count: int, bins: int, link: str) -> np.ndarray:
    """[node, feature, bin, (g, h)] of the nodes that are built; ``grown`` are this round's trees, ``done`` those since the last write."""
    packed, current = [_packed(t) for t in done], [_packed(t) for t in grown]
    shape = (count, width, bins + 1, 2)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.zeros(shape)
        for batch in batches:
            x, y = _matrix(batch, width), np.asarray(batch["y"], float)
            scores = _scores(packed, places, np.zeros(outputs), False, x) + np.stack([np.asarray(batch[f"s{i}"], float) for i in range(outputs)], axis=1)
            g, h = slopes(scores, y, link)
            binned = np.stack([np.where(np.isnan(x[:, f]), bins, np.searchsorted(edges[f], x[:, f], side="left")) for f in range(width)], axis=1)
            for i, (tree, slot) in enumerate(zip(current, slots)):
                at = slot[_walk(tree, x)]
                some = np.flatnonzero(at >= 0)
                for f in range(width):
                    place = at[some] * (bins + 1) + binned[some, f]
                    for c, w in enumerate((g[some, i], h[some, i])):
                        state[:, f, :, c] += np.bincount(place, w, count * (bins + 1)).reshape(count, bins + 1)
        flat = state.reshape(-1, 2)
        some = np.flatnonzero(flat.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some, 0]), pa.array(flat[some, 1])], ["id", "g", "h"])

    got = rows.mapInArrow(add, "id long, g double, h double").groupBy("id").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
    out = np.zeros(shape).reshape(-1, 2)
    out[got["id"].to_numpy(int)] = got[["g", "h"]].to_numpy(float)
    return out.reshape(shape)


def fit_newton_boosting(
    data: DataFrame, features: Sequence[str], classes: int, maxIter: int = 50, stepSize: float = 0.1, maxDepth: int = 4,
    regLambda: float = 1.0, gamma: float = 0.0, minChildWeight: float = 1.0, maxBins: int = 64, **_
) -> Trees:
    """Boosting in which leaves are Newton steps -G / (H + lambda) (Chen and Guestrin 2016); one tree a class and round.

    Splits are chosen in histograms of gradients and curvatures over quantile bins. Of two siblings the one with less curvature
    is added up, the other is the rest of its parent. A missing value goes to the side that gains more.
    """
    rows, width = _columns(data, features), len(features)
    link = "number" if not classes else "logistic" if classes <= 2 else "softmax"
    outputs = classes if classes > 2 else 1
    names = [f"x{i}" for i in range(width)]
    found = exact_quantiles(rows, names, [i / maxBins for i in range(1, maxBins)]) if width else {}
    edges = [np.unique([v for v in found[n] if v is not None]).astype(float) for n in names]
    bins = max([len(e) for e in edges], default=0) + 1
    base = [0.0] * outputs
    if link == "number":
        base = [float(rows.agg(F.avg("y")).first()[0] or 0.0)]
    elif link == "logistic":
        p = min(max(float(rows.agg(F.avg("y")).first()[0] or 0.5), 1e-6), 1 - 1e-6)
        base = [float(np.log(p / (1 - p)))]
    fields = [*names, "y", *(f"s{i}" for i in range(outputs))]
    rows = rows.withColumns({f"s{i}": F.lit(b) for i, b in enumerate(base)})
    forest, places, gains, written = [], [], np.zeros(width), 0
    for turn in range(maxIter if width else 0):
        grown = [Tree() for _ in range(outputs)]
        level = [(i, 0, None, None) for i in range(outputs)]  # tree, node, its parent's histogram, its sibling (built in its place)
        known: dict[tuple[int, int], np.ndarray] = {}
        for depth in range(maxDepth):
            build = [(i, node) for i, node, parent, _ in level if parent is None]
            slots = [np.full(len(t.feature), -1) for t in grown]
            for at, (i, node) in enumerate(build):
                slots[i][node] = at
            hist = _histograms(rows, width, outputs, edges, base, forest[written:], places[written:], grown, slots, len(build), bins, link) if build else None
            known = {key: hist[at] for at, key in enumerate(build)}
            known |= {(i, node): parent - known[i, sibling] for i, node, parent, sibling in level if parent is not None}
            if depth == 0:
                for i, t in enumerate(grown):
                    g, h = known[i, 0][0].sum(axis=0)
                    t.value[0] = [float(-stepSize * g / (h + regLambda))]
            after = []
            for i, node, _, _ in level:
                own = known[i, node]
                best = best_split(own, regLambda, gamma, minChildWeight)
                if best is None:
                    continue
                gain, f, b, gap_left = best
                cut = float(edges[f][b]) if b < len(edges[f]) else float("inf")  # beyond the edges: known values against missing ones
                left = own[f, : b + 1].sum(axis=0) + (own[f, -1] if gap_left else 0.0)
                right = own[f].sum(axis=0) - left
                values = [[float(-stepSize * s[0] / (s[1] + regLambda))] for s in (left, right)]
                at = grown[i].split(node, f, cut, gap_left, values)
                gains[f] += gain
                small, large = (at, at + 1) if left[1] <= right[1] else (at + 1, at)
                after += [(i, small, None, None), (i, large, own, small)]
            level = after
            if not level:
                break
        forest += grown
        places += list(range(outputs))
        if turn % WRITE_EVERY == WRITE_EVERY - 1 and turn < maxIter - 1:
            rows = cut_lineage(_rescored(rows, fields, width, outputs, forest[written:], places[written:]))
            written = len(forest)
    return Trees(tuple(features), forest, places, base, False, link, gains.tolist())


def _rescored(rows: DataFrame, fields: list[str], width: int, outputs: int, trees: list[Tree], places: list[int]) -> DataFrame:
    packed = [_packed(t) for t in trees]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = _scores(packed, places, np.zeros(outputs), False, _matrix(batch, width))
            new = [pa.array(np.asarray(batch[f"s{i}"], float) + more[:, i]) for i in range(outputs)]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in fields[: width + 1]), *new], fields)

    return rows.select(*fields).mapInArrow(add, ", ".join(f"{n} double" for n in fields))
