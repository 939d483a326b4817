"""Clustering, components and density clusters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col, small_table
from millrace.session import cut_lineage


def vectors(df: DataFrame, features: Sequence[str], name: str = "__features") -> DataFrame:
    """All rows with their features as a vector; gaps become NaN."""
    return VectorAssembler(inputCols=list(features), outputCol=name, handleInvalid="keep").transform(df)


def whole(features: Sequence[str]) -> Column:
    """Whether a row has all its features. Others are not fitted on and get a null result."""
    return reduce(and_, [col(f).isNotNull() & ~F.isnan(col(f).cast("double")) for f in features])


def kmeans(df: DataFrame, features: Sequence[str], k: int = 3, seed: int = 42) -> tuple[DataFrame, object]:
    """Rows with ``cluster``, and the fitted model."""
    data = vectors(df, features)
    model = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="cluster").fit(data.where(whole(features)))
    return model.transform(data).withColumn("cluster", F.when(whole(features), F.col("cluster"))).drop("__features"), model


def principal_components(df: DataFrame, features: Sequence[str], k: int, scale: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with ``pc1..pck`` (centred), and the explained variance ratio per component."""
    data = vectors(df, features)
    known = data.where(whole(features))
    centred = StandardScaler(inputCol="__features", outputCol="__centred", withMean=True, withStd=scale).fit(known).transform(data)
    model = PCA(k=k, inputCol="__centred", outputCol="__pc").fit(centred.where(whole(features)))
    parts = vector_to_array(F.col("__pc"))
    out = model.transform(centred).withColumns({f"pc{i + 1}": F.when(whole(features), F.get(parts, F.lit(i))) for i in range(k)})
    ratio = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance.toArray())]
    return out.drop("__features", "__centred", "__pc"), small_table(df.sparkSession, ratio, "component int, explained double")


BLOCK = 50_000


def _distance2(a: str, b: str, d: int) -> Column:
    out = F.lit(0.0)
    for i in range(d):
        gap = F.get(F.col(a), F.lit(i)) - F.get(F.col(b), F.lit(i))
        out = out + gap * gap
    return out


def _within(a: str, b: str, d: int, eps: float) -> Column:
    return _distance2(a, b, d) <= F.lit(eps * eps)


def dbscan(df: DataFrame, features: Sequence[str], eps: float = 0.5, min_rows: int = 5) -> DataFrame:
    """Rows with ``cluster`` (from 0 by size of its smallest cell, -1 for noise, null with a gap); at most four features.

    Space is cut into cells of diameter ``eps``, so rows of one cell are all neighbours. A cell with
    ``min_rows`` rows is dense: all its rows are core, without comparing any. Only rows of thin cells
    (fewer than ``min_rows`` each) look at the rows of nearby cells. Cells are linked if two of their
    core rows are near; between two dense cells this is settled on ever finer sub-boxes, where most
    are decided by their bounds, and pairs of rows are never listed. Clusters are the connected cells.
    """
    d = len(features)
    if not 1 <= d <= 4:
        raise ValueError("grid density clusters take one to four features")
    side = eps / np.sqrt(d) * (1 - 1e-12)
    x = F.array(*[col(f).cast("double") + F.lit(0.0) for f in features])
    complete = df.where(whole(features))
    points = complete.select(x.alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    points = cut_lineage(points.withColumn("cell", F.transform("x", lambda v: F.floor(v / F.lit(side)))))
    cells = points.groupBy("cell").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("kinds"))
    reach = int(np.ceil(np.sqrt(d)))
    steps = [
        s for s in product(range(-reach, reach + 1), repeat=d)
        if sum(max(abs(v) - 1, 0) ** 2 for v in s) * side * side <= eps * eps
    ]
    offsets = F.array(*[F.array(*[F.lit(v).cast("bigint") for v in s]) for s in steps])
    around = F.transform(offsets, lambda o: F.zip_with("cell", o, lambda a, b: a + b))

    # a cell with very many distinct rows is met in blocks
    sized = points.join(cells, "cell").withColumn("blocks", F.ceil(F.col("kinds") / BLOCK).cast("int"))
    blocked = sized.withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    blocks = cells.select("cell", F.ceil(F.col("kinds") / BLOCK).cast("int").alias("blocks"))

    def meet(asking: DataFrame, others: DataFrame) -> DataFrame:
        """Rows of ``asking`` (near cell in ``at``) with the rows of that cell."""
        spread = asking.join(blocks.withColumnRenamed("cell", "at"), "at")
        spread = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = others.select(F.col("cell").alias("at"), "block", F.col("x").alias("ox"), F.col("w").alias("ow"))
        return spread.join(right, ["at", "block"])

    thin = sized.where(F.col("n") < min_rows).select("x", "cell")
    asking = thin.withColumn("at", F.explode(around))
    near = meet(asking, blocked).where(_within("x", "ox", d, eps))
    thin_core = near.groupBy("x", "cell").agg(F.sum("ow").alias("k")).where(F.col("k") >= min_rows).select("x", "cell")
    dense = sized.where(F.col("n") >= min_rows)
    thin_core = cut_lineage(thin_core.withColumn("dense", F.lit(False)))
    core = thin_core.unionByName(dense.select("x", "cell", F.lit(True).alias("dense")))
    core_blocked = core.join(blocked.select("x", "cell", "block", "w"), ["x", "cell"])

    # links that involve a thin core row
    asked = thin_core.select("x", "cell").withColumn("at", F.explode(around))
    links = meet(asked, core_blocked).where(_within("x", "ox", d, eps)).select(F.col("cell").alias("a"), F.col("at").alias("b"))
    links = links.unionByName(_dense_links(dense.select("x", "cell"), around, side, eps, d)).where("a <> b").distinct()
    core_cells = core.select("cell").distinct()
    labels = components(core_cells, cut_lineage(links))

    # names from 0; a thin row that is not core joins the first cluster of a core row near it
    from millrace.operators.ordering import with_position

    names = with_position(labels.select("label").distinct(), ["label"], "cluster")
    named = labels.join(names, "label").select("cell", (F.col("cluster") - 1).alias("cluster"))
    core_rows = core.join(named, "cell").select("x", "cluster")
    rest = asking.join(thin_core.select("x"), "x", "left_anti")
    edge = (
        meet(rest, core_blocked).where(_within("x", "ox", d, eps))
        .join(named.withColumnRenamed("cell", "at"), "at").groupBy("x").agg(F.min("cluster").alias("cluster"))
    )
    found = core_rows.unionByName(edge).select(F.col("x").alias("__x"), "cluster")
    out = complete.withColumn("__k", x).join(found, F.col("__k") == F.col("__x"), "left")
    out = out.withColumn("cluster", F.coalesce("cluster", F.lit(-1)).cast("int")).drop("__k", "__x")
    return out.unionByName(df.where(~whole(features)).withColumn("cluster", F.lit(None).cast("int")))


def _dense_links(rows: DataFrame, around: Column, side: float, eps: float, d: int) -> DataFrame:
    """Pairs of dense cells with two rows within ``eps``.

    Each level describes a cell by boxes half as wide: bounds and one row per box. A pair of boxes
    whose rows are near links its cells; one whose bounds are too far apart is dropped; the rest go
    to the next level, until boxes hold one row. Cells already linked ask no further.
    """
    spark = rows.sparkSession
    linked = None
    level, pairs = 1, None
    while True:
        width = side / (2**level)
        at = F.transform("x", lambda v: F.floor(v / F.lit(width)).cast("bigint"))
        used = rows if pairs is None else rows.join(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "cell"), "cell", "left_semi")
        value = lambda i: F.get("x", F.lit(i))
        boxes = used.withColumn("box", at).groupBy("cell", "box").agg(
            F.min("x").alias("row"),
            F.array(*[F.min(value(i)) for i in range(d)]).alias("low"),
            F.array(*[F.max(value(i)) for i in range(d)]).alias("high"),
        )
        boxes = cut_lineage(boxes)
        left = boxes.select(F.col("cell").alias("a"), F.col("box").alias("abox"), F.col("row").alias("arow"), F.col("low").alias("alow"), F.col("high").alias("ahigh"))
        right = boxes.select(F.col("cell").alias("b"), F.col("box").alias("bbox"), F.col("row").alias("brow"), F.col("low").alias("blow"), F.col("high").alias("bhigh"))
        if pairs is None:
            cells = boxes.select("cell").distinct()
            near = cells.withColumn("b", F.explode(around)).select(F.col("cell").alias("a"), "b").where("a < b")
            near = near.join(cells.select(F.col("cell").alias("b")), "b", "left_semi")
            met = near.join(left, "a").join(right, "b")
        else:
            up = lambda c: F.transform(c, lambda v: F.floor(v / 2).cast("bigint"))
            met = (
                pairs.join(left.withColumn("aup", up("abox")), ["a", "aup"]).join(right.withColumn("bup", up("bbox")), ["b", "bup"])
            )
        gap = F.lit(0.0)
        for i in range(d):
            g = lambda c: F.get(F.col(c), F.lit(i))
            apart = F.greatest(g("alow") - g("bhigh"), g("blow") - g("ahigh"), F.lit(0.0))
            gap = gap + apart * apart
        met = met.where(gap <= F.lit(eps * eps))
        met = cut_lineage(met.select("a", "b", "abox", "bbox", _within("arow", "brow", d, eps).alias("hit"),
                                     ((F.col("alow") == F.col("ahigh")) & (F.col("blow") == F.col("bhigh"))).alias("single")))
        hits = met.where("hit").select("a", "b").distinct()
        linked = hits if linked is None else linked.unionByName(hits)
        open_ = met.where("NOT single").join(hits, ["a", "b"], "left_anti")
        pairs = cut_lineage(open_.select("a", "b", F.col("abox").alias("aup"), F.col("bbox").alias("bup")))
        if pairs.limit(1).count() == 0:
            return linked
        level += 1


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(cell, label)``: label is the smallest cell of the connected component.

    Every round takes the smallest label among neighbours and then the label's own label, which
    halves the distance to the root. Labels are checkpointed each round.
    """
    both = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(nodes.select("cell", F.col("cell").alias("label")))
    while True:
        # neighbours with one label say the same thing, so each label goes out once per node
        offered = both.join(labels.select(F.col("cell").alias("a"), "label"), "a").select(F.col("b").alias("cell"), "label")
        best = labels.unionByName(offered).groupBy("cell").agg(F.min("label").alias("label"))
        roots = best.select(F.col("cell").alias("label"), F.col("label").alias("root"))
        jumped = best.join(roots, "label", "left").select("cell", F.least(F.coalesce("root", "label"), F.col("label")).alias("new"))
        step = cut_lineage(jumped.join(labels, "cell"))
        changed = step.where(F.col("new") != F.col("label")).limit(1).count()
        labels = step.select("cell", F.col("new").alias("label"))
        if not changed:
            return labels
