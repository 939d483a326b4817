"""Exact Shapley values of tree models, path by path.

The value of a set of features is what the trees give on average if these are known: at a split on a known feature a row
takes its side, at any other both, by the shares in which a background table takes them (Lundberg et al. 2020). On the way to one
leaf this is a product, one factor a feature: 1 or 0 if it is known, its share z otherwise. The Shapley weights of all subsets
of the other features are then an integral over t of the product of z (1 - t) + o t, a polynomial, so Gauss's rule
with half as many nodes as features has it exactly: no subset is drawn or listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.models.trees import Tree, Trees, _matrix, _packed, _walk


def _converted(node, classes: int, weight: float) -> Tree:
    """A tree of Spark's own library, from its root."""

    def value(n):
        if not classes:
            return [weight * n.prediction()]
        stats = np.array(list(n.impurityStats().stats()))
        return (stats / (stats.sum() or 1.0)).tolist()

    tree = Tree(value=[value(node)])
    open_ = [(0, node)]
    while open_:
        at, n = open_.pop()
        if n.subtreeDepth() == 0:
            continue
        split, left, right = n.split(), n.leftChild(), n.rightChild()
        if split.getClass().getSimpleName() == "CategoricalSplit":  # a 0/1 place of a text feature
            cut = 0.5
            if 0.0 not in list(split.leftCategories()):
                left, right = right, left
        else:
            cut = split.threshold()
        child = tree.split(at, split.featureIndex(), cut, True, [value(left), value(right)])
        open_ += [(child, left), (child + 1, right)]
    return tree


def _forest(trained) -> tuple[Trees, PipelineModel | None]:
    """The trees of a model and what comes before them."""
    from millrace.models.supervised import Encoded

    model = trained.model
    if isinstance(model, Encoded) and isinstance(model.inner, Trees):
        return model.inner, model.pre
    if isinstance(model, Trees):
        return model, None
    last = model.stages[-1] if isinstance(model, PipelineModel) else None
    if last is None or not (hasattr(last, "trees") or hasattr(last, "depth")):
        raise ValueError(f"{trained.name} is not made of trees; use shapley")
    boosted = type(last).__name__.startswith("GBT")
    classes = 0 if boosted or not trained.labels else last.numClasses
    members = list(last.trees) if hasattr(last, "trees") else [last]
    weights = list(last.treeWeights) if boosted else [1.0] * len(members)
    trees = [_converted(t._java_obj.rootNode(), classes, w) for t, w in zip(members, weights)]
    pre = PipelineModel(stages=model.stages[:-1])
    return Trees((), trees, [0 if boosted else -1] * len(trees), [0.0] * (classes or 1), not boosted, "", []), pre


def _shares(forest: Trees, rows: DataFrame, width: int) -> list[np.ndarray]:
    """For each tree the share of its parent's background rows that go to every node; a half where no row comes."""
    packed = [_packed(t) for t in forest.trees]
    starts = np.cumsum([0] + [len(t.feature) for t in forest.trees])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(starts[-1], np.int64)
        for batch in batches:
            x = _matrix(batch, width)
            for start, tree in zip(starts, packed):
                seen[start : start + len(tree[0])] += np.bincount(_walk(tree, x), minlength=len(tree[0]))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["node", "n"])

    got = rows.mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()
    all_ = np.zeros(starts[-1])
    for r in got:
        all_[r["node"]] = r["n"]
    out = []
    for start, tree in zip(starts, forest.trees):
        n = all_[start : start + len(tree.feature)]
        for node in reversed(range(len(n))):  # children come after their parent
            if tree.feature[node] >= 0:
                n[node] = n[tree.left[node]] + n[tree.left[node] + 1]
        share = np.ones(len(n))
        for node, f in enumerate(tree.feature):
            if f >= 0:
                for child in (tree.left[node], tree.left[node] + 1):
                    share[child] = n[child] / n[node] if n[node] else 0.5
        out.append(share)
    return out


def _paths(tree: Tree, share: np.ndarray, owner: list[int], output: int) -> list[tuple]:
    """(value, owners, z of each, [(place among the owners, node, goes left)]) of every leaf."""
    out = []
    open_ = [(0, [])]
    while open_:
        node, steps = open_.pop()
        if tree.feature[node] >= 0:
            left = tree.left[node]
            open_ += [(left, [*steps, (node, True, share[left])]), (left + 1, [*steps, (node, False, share[left + 1])])]
            continue
        owners = sorted({owner[tree.feature[n]] for n, _, _ in steps})
        z = np.ones(len(owners))
        sides = []
        for n, goes_left, part in steps:
            at = owners.index(owner[tree.feature[n]])
            z[at] *= part
            sides.append((at, n, goes_left))
        out.append((tree.value[node][output], owners, z, sides))
    return out


def _expected(paths: list[list[tuple]]) -> float:
    return float(sum(value * z.prod() for tree in paths for value, _, z, _ in tree))


def _contributions(packed: list[tuple], paths: list[list[tuple]], features: int, x: np.ndarray) -> np.ndarray:
    """The sum over trees of every feature's Shapley value, for each row."""
    out = np.zeros((len(x), features))
    for tree, leaves in zip(packed, paths):
        feature, cut, _, gap_left, _ = tree
        v = x[:, np.maximum(feature, 0)]
        left = np.where(np.isnan(v), gap_left, v <= cut)
        for value, owners, z, sides in leaves:
            d = len(owners)
            if not d or not value:
                continue
            o = np.ones((len(x), d))
            for at, node, goes_left in sides:
                o[:, at] *= left[:, node] == goes_left
            nodes, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
            for t, w in zip((nodes + 1) / 2, weights / 2):
                factor = z * (1 - t) + o * t
                before = np.cumprod(np.concatenate([np.ones((len(x), 1)), factor[:, :-1]], axis=1), axis=1)
                after = np.cumprod(np.concatenate([np.ones((len(x), 1)), factor[:, :0:-1]], axis=1), axis=1)[:, ::-1]
                out[:, owners] += value * w * (o - z) * before * after
    return out


def tree_shapley(trained, df: DataFrame, key: list[str], background: DataFrame | None = None, class_index: int = 1) -> DataFrame:
    """``key``, feature, contribution and expected, exact for single trees, forests, extra trees and boosted trees.

    The contributions of a row and ``expected`` add up to what the trees give: the number predicted, the probability of class
    ``class_index``, or for boosting of classes its score before the link. ``background`` (``df`` if not given; no more than
    counted once) says how often splits go left. The places of a text feature act as one feature. A row for which the model has no
    prediction, because of a gap, has null contributions; equal keys are explained each.
    """
    from millrace.models.supervised import ALIASES, TAKES_GAPS, _slots, _spread, complete

    forest, pre = _forest(trained)
    features = list(trained.features)
    whole = F.lit(True) if ALIASES.get(trained.name, trained.name) in TAKES_GAPS else complete(df, features)
    owner = list(range(len(features))) if pre is None else [features.index(f) for f, size in _slots(pre) for _ in range(size)]
    width = len(owner)

    def spread(table: DataFrame) -> tuple[DataFrame, list[str]]:
        return (table, features) if pre is None else _spread(pre, table)

    known = df if background is None else background
    known = known if ALIASES.get(trained.name, trained.name) in TAKES_GAPS else known.where(complete(known, features))
    table, names = spread(known)
    shares = _shares(forest, table.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]), width)
    output = class_index if len(forest.base) > 1 else 0
    mine = [i for i, place in enumerate(forest.places) if place in (-1, output)]
    at = lambda i: output if forest.places[i] < 0 else 0
    paths = [_paths(forest.trees[i], shares[i], owner, at(i)) for i in mine]
    packed = [_packed(forest.trees[i]) for i in mine]
    scale = 1.0 / max(len(forest.trees), 1) if forest.mean else 1.0
    expected = (_expected(paths) + forest.base[output]) * scale if forest.mean else _expected(paths) + forest.base[output]
    count = len(features)

    def explain(columns: pd.DataFrame) -> pd.Series:
        return pd.Series(list(scale * _contributions(packed, paths, count, columns.to_numpy(dtype=float))))

    rows, names = spread(df.withColumn("__whole", whole))
    x = F.struct(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    each = F.when(F.col("__whole"), F.pandas_udf(explain, "array<double>")(x)).otherwise(F.array_repeat(F.lit(None).cast("double"), count))
    told = F.posexplode(F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), each.alias("contribution")))
    out = rows.select(*[col(k).alias(f"__key{i}") for i, k in enumerate(key)], told.alias("__at", "__told"))
    named = [F.col(f"__key{i}").alias(k) for i, k in enumerate(key)]
    return out.select(*named, F.col("__told.feature").alias("feature"), F.col("__told.contribution").alias("contribution"), F.lit(expected).alias("expected"))
