"""Order-dependent operators that stay distributed.

A window without a partition key, or with one hot key, would sort everything in
one task. Here the sort order itself is cut into ranges ("chunks") of about equal
size at sampled cut points, the windows run inside a chunk, and what has to cross
a chunk border travels in a table of one row per chunk. Beyond MAX_CHUNKS chunks both the cut
points and what they carry make a tree with so many branches at a node at most.
The cut points only steer the work; results do not depend on them.

``order_by`` must identify rows within ``partition_by``, or ties come out in any order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.semantics import col, quoted
from millrace.operators.joins import small_side
from millrace.session import cut_lineage

ROWS_PER_CHUNK = 1_000_000
MAX_CHUNKS = 1024
SAMPLES_PER_CHUNK = 32

CHUNK = "__chunk"


def _cut_points(df: DataFrame, keys: Sequence[str], chunks: int, rows: int) -> Column:
    share = min(1.0, 1.2 * chunks * SAMPLES_PER_CHUNK / max(rows, 1))
    picked = (
        df.select(*[col(k) for k in keys])
        .sample(fraction=share, seed=7)
        .orderBy(*[col(k) for k in keys])
        .select(*[col(k).cast("string") for k in keys])
        .collect()
    )
    step = max(1, len(picked) // chunks)
    cuts = picked[step::step][: chunks - 1]
    types = {f.name: f.dataType for f in df.schema.fields}
    return [
        F.struct(*[F.lit(value).cast(types[k]).alias(f"k{i}") for i, (k, value) in enumerate(zip(keys, cut))])
        for cut in cuts
    ]


def with_chunks(
    df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], rows_per_chunk: int | None = None
) -> tuple[DataFrame, int]:
    """Add ``__chunk``, the number of the sort range a row falls in, by binary search in the cut points.

    Returns the table and a bound of the numbers. Up to MAX_CHUNKS ranges are cut at once; more by a tree (``_tree``).
    """
    rows_per_chunk = rows_per_chunk or ROWS_PER_CHUNK
    rows = df.count()
    wanted = -(-rows // rows_per_chunk)
    keys = [*partition_by, *order_by]
    if wanted > MAX_CHUNKS:
        return _tree(df, keys, wanted, rows)
    cuts = _cut_points(df, keys, wanted, rows) if wanted > 1 else []
    if not cuts:
        return df.withColumn(CHUNK, F.lit(0)), 1
    return df.withColumn(CHUNK, _search(F.array(*cuts), len(cuts), keys)), len(cuts) + 1


def _search(bounds: Column, most: int, keys: Sequence[str]) -> Column:
    """How many of the sorted ``bounds`` (at most ``most``) are not above the row's keys."""
    row_key = F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    jumps = [1 << b for b in reversed(range(most.bit_length()))]

    def step(found: Column, jump: Column) -> Column:
        probe = found + jump
        inside = probe <= F.size(bounds)
        reached = F.get(bounds, F.least(probe, F.size(bounds)) - 1) <= row_key
        return F.when(inside & reached, probe).otherwise(found)

    return F.aggregate(F.array(*[F.lit(j) for j in jumps]), F.lit(0), step)


def _tree(df: DataFrame, keys: Sequence[str], wanted: int, rows: int) -> tuple[DataFrame, int]:
    """Ranges of ranges: each level cuts every range of the level above at points of its own part of one sample.

    The cut points of a level are a table with one row, an array of fewer than MAX_CHUNKS points, for each range above;
    rows meet it by the number of their range. So no plan, task or driver holds all borders.
    """
    levels = 2
    while MAX_CHUNKS**levels < wanted:
        levels += 1
    fan = max(2, math.ceil(wanted ** (1 / levels)))
    share = min(1.0, 1.2 * wanted * SAMPLES_PER_CHUNK / max(rows, 1))
    sample = cut_lineage(df.select(*[col(k) for k in keys]).sample(fraction=share, seed=7))
    cuts = _cut_points(sample, keys, fan, sample.count())
    top = _search(F.array(*cuts), len(cuts), keys).cast("bigint") if cuts else F.lit(0).cast("bigint")
    df, sample, chunks = df.withColumn(CHUNK, top), sample.withColumn(CHUNK, top), len(cuts) + 1
    width = 2 * fan  # of n sampled rows, each of the n // fan-th is a point: fewer than twice as many
    for level in range(1, levels):
        place = Window.partitionBy(CHUNK).orderBy(*[col(k) for k in keys])
        step = F.greatest(F.floor(F.count(F.lit(1)).over(Window.partitionBy(CHUNK)) / fan), F.lit(1))
        point = F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("__point")
        picked = sample.select(CHUNK, point, F.row_number().over(place).alias("__nth"), step.alias("__step"))
        picked = picked.where((F.col("__nth") % F.col("__step") == 0) & (F.col("__nth") < F.col("__step") * width))
        table = picked.groupBy(F.col(CHUNK).alias("__range")).agg(F.sort_array(F.collect_list("__point")).alias("__bounds"))
        table = small_side(table)
        below = F.coalesce(_search(F.col("__bounds"), width, keys), F.lit(0))
        finer = lambda t: t.join(table, F.col(CHUNK) == F.col("__range"), "left").withColumn(CHUNK, F.col(CHUNK) * width + below).drop("__range", "__bounds")  # noqa: E731, B023
        df, chunks = finer(df), chunks * width
        if level < levels - 1:
            sample = cut_lineage(finer(sample))
    return df, chunks


def _local(partition_by: Sequence[str], order_by: Sequence[str], forward: bool = True):
    order = [col(o).asc() if forward else col(o).desc() for o in order_by]
    return Window.partitionBy(*[col(p) for p in partition_by], F.col(CHUNK)).orderBy(*order)


def _before(table: DataFrame, names: Sequence[str], chunks: int, kind: str = "sum", forward: bool = True) -> DataFrame:
    """For each chunk what all chunks before it (after it, if not ``forward``) hold: sums, or the nearest known edge.

    ``table`` has one row a chunk. More than MAX_CHUNKS of them go up in groups of so many, get what is before their group
    from the level above, and take it down: no window has more rows than that. Edges are structs in sort order.
    """
    order, outer = (F.asc(CHUNK), F.max) if forward else (F.desc(CHUNK), F.min)
    rows = (Window.unboundedPreceding, -1)
    of = lambda n: F.sum(col(n)) if kind == "sum" else F.last(col(n), ignorenulls=True)
    if chunks <= MAX_CHUNKS:
        window = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(*rows)
        return table.select(CHUNK, *[of(n).over(window).alias(n) for n in names])
    grouped = table.withColumn("__group", F.floor(F.col(CHUNK) / MAX_CHUNKS).cast("bigint"))
    whole = grouped.groupBy("__group").agg(*[(F.sum(col(n)) if kind == "sum" else outer(col(n))).alias(n) for n in names])
    above = _before(whole.withColumnRenamed("__group", CHUNK), names, -(-chunks // MAX_CHUNKS), kind, forward)
    above = above.select(F.col(CHUNK).alias("__group"), *[col(n).alias(f"__above_{n}") for n in names])
    window = Window.partitionBy("__group").orderBy(order).rowsBetween(*rows)
    here = grouped.select(CHUNK, "__group", *[of(n).over(window).alias(n) for n in names]).join(above, "__group")

    def both(n):
        own, up = col(n), F.col(quoted(f"__above_{n}"))
        if kind == "sum":
            return F.coalesce(own + up, own, up)
        return F.coalesce(own, up)

    return here.select(CHUNK, *[both(n).alias(n) for n in names])


def _shared(table: DataFrame, chunks: int) -> DataFrame:
    """A per-chunk table for a join: broadcast if it is bounded, else if it is measured to be small."""
    return F.broadcast(table) if chunks <= MAX_CHUNKS else small_side(table)


def _chunk_starts(chunked: DataFrame, chunks: int) -> DataFrame:
    sizes = chunked.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("__start"))
    before = _before(sizes, ["__start"], chunks)
    return _shared(before.select(CHUNK, F.coalesce("__start", F.lit(0)).cast("bigint").alias("__start")), chunks)


def with_position(
    df: DataFrame,
    order_by: Sequence[str],
    name: str = "position",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Number all rows 1..n in sort order without gathering them in one task."""
    chunked, chunks = with_chunks(df, [], order_by, rows_per_chunk)
    here = F.row_number().over(_local([], order_by)).cast("bigint")
    if chunks == 1:
        return chunked.withColumn(name, here).drop(CHUNK)
    return (
        chunked.withColumn("__here", here)
        .join(_chunk_starts(chunked, chunks), CHUNK)
        .withColumn(name, F.col("__start") + F.col("__here"))
        .drop("__here", "__start", CHUNK)
    )


def running_sum(
    df: DataFrame, value: str, order_by: Sequence[str], name: str, rows_per_chunk: int | None = None
) -> DataFrame:
    """Running total in sort order."""
    return running_sums(df, {name: value}, order_by, rows_per_chunk)


def running_sums(df: DataFrame, values: dict[str, str], order_by: Sequence[str], rows_per_chunk: int | None = None) -> DataFrame:
    """Running totals of several columns in one sort; ``values`` has the column of each new name."""
    chunked, chunks = with_chunks(df, [], order_by, rows_per_chunk)
    window = _local([], order_by).rowsBetween(Window.unboundedPreceding, 0)
    here = {n: F.sum(col(v)).over(window) for n, v in values.items()}
    if chunks == 1:
        return chunked.withColumns(here).drop(CHUNK)
    totals = chunked.groupBy(CHUNK).agg(*(F.sum(col(v)).alias(f"__carry_{n}") for n, v in values.items()))
    carry = _shared(_before(totals, [f"__carry_{n}" for n in values], chunks), chunks)
    whole = {
        n: F.when(h.isNull(), col(f"__carry_{n}")).otherwise(h + F.coalesce(col(f"__carry_{n}"), F.lit(0))) for n, h in here.items()
    }
    return chunked.join(carry, CHUNK).withColumns(whole).drop(*(f"__carry_{n}" for n in values), CHUNK)


def _carry(chunked: DataFrame, chunks: int, values: dict[str, Column], partition_by, order_by, forward: bool) -> DataFrame:
    """Per chunk, the nearest non-null value of each column in the chunks before (or after) it.

    Chunks follow the sort order, so the latest value before a chunk is the one to carry
    as long as it belongs to the partition of the row that asks; the key travels with it.
    """
    pick = F.max if forward else F.min
    order = [col(k) for k in [*partition_by, *order_by]]
    edges = chunked.groupBy(CHUNK).agg(
        *[
            pick(F.when(v.isNotNull(), F.struct(*order, v.alias("__value")))).alias(f"__carry_{n}")
            for n, v in values.items()
        ]
    )
    return _shared(_before(edges, [f"__carry_{n}" for n in values], chunks, "edge", forward), chunks)


def _same_partition(edge: Column, partition_by: Sequence[str]) -> Column:
    same = edge.isNotNull()
    for p in partition_by:
        same = same & edge.getField(p).eqNullSafe(col(p))
    return same


def _nearest(
    chunked: DataFrame, chunks: int, values: dict[str, Column], partition_by, order_by, forward: bool
) -> DataFrame:
    """Add, under each name in ``values``, the nearest non-null value at or before (after) the row."""
    # Backward is forward in the reverse order: a frame that ends with the partition is evaluated anew for each row.
    window = _local(partition_by, order_by, forward).rowsBetween(Window.unboundedPreceding, 0)
    here = {n: F.last(v, ignorenulls=True).over(window) for n, v in values.items()}
    if chunks == 1:
        return chunked.withColumns(here)
    out = chunked.withColumns({f"__here_{n}": c for n, c in here.items()})
    out = out.join(_carry(chunked, chunks, values, partition_by, order_by, forward), CHUNK)
    joined = {}
    for n in values:
        edge = F.col(quoted(f"__carry_{n}"))
        carried = F.when(_same_partition(edge, partition_by), edge.getField("__value"))
        joined[n] = F.coalesce(F.col(quoted(f"__here_{n}")), carried)
    out = out.withColumns(joined)
    return out.drop(*[f"__here_{n}" for n in values], *[f"__carry_{n}" for n in values])


def forward_fill(
    df: DataFrame, columns: Sequence[str], order_by, partition_by=(), rows_per_chunk: int | None = None
) -> DataFrame:
    """Fill gaps with the last value seen."""
    chunked, chunks = with_chunks(df, partition_by, order_by, rows_per_chunk)
    names = {f"__fill_{c}": col(c) for c in columns}
    out = _nearest(chunked, chunks, names, partition_by, order_by, True)
    return out.withColumns({c: F.col(quoted(f"__fill_{c}")) for c in columns}).drop(*names, CHUNK)


def backward_fill(
    df: DataFrame, columns: Sequence[str], order_by, partition_by=(), rows_per_chunk: int | None = None
) -> DataFrame:
    """Fill gaps with the next value to come."""
    chunked, chunks = with_chunks(df, partition_by, order_by, rows_per_chunk)
    names = {f"__fill_{c}": col(c) for c in columns}
    out = _nearest(chunked, chunks, names, partition_by, order_by, False)
    return out.withColumns({c: F.col(quoted(f"__fill_{c}")) for c in columns}).drop(*names, CHUNK)


def interpolate(
    df: DataFrame, columns: Sequence[str], order_by, partition_by=(), rows_per_chunk: int | None = None
) -> DataFrame:
    """Linear interpolation by row position; leading gaps stay, trailing gaps take the last value."""
    chunked, chunks = with_chunks(df, partition_by, order_by, rows_per_chunk)
    # A position in the whole sort order serves every partition: only differences count.
    pos = F.row_number().over(Window.partitionBy(CHUNK).orderBy(*[col(k) for k in [*partition_by, *order_by]]))
    placed = chunked.withColumn("__pos", pos.cast("bigint"))
    if chunks > 1:
        placed = placed.join(_chunk_starts(chunked, chunks), CHUNK)
        placed = placed.withColumn("__pos", F.col("__pos") + F.col("__start")).drop("__start")
    known = {
        c: F.when(col(c).isNotNull(), F.struct(F.col("__pos").alias("p"), col(c).cast("double").alias("v")))
        for c in columns
    }
    before = {f"__prev_{c}": k for c, k in known.items()}
    after = {f"__next_{c}": k for c, k in known.items()}
    out = _nearest(placed, chunks, before, partition_by, order_by, True)
    out = _nearest(out, chunks, after, partition_by, order_by, False)
    filled = {}
    for c in columns:
        prev, nxt = F.col(quoted(f"__prev_{c}")), F.col(quoted(f"__next_{c}"))
        slope = (nxt["v"] - prev["v"]) / (nxt["p"] - prev["p"])
        between = prev["v"] + slope * (F.col("__pos") - prev["p"])
        filled[c] = F.coalesce(col(c).cast("double"), F.when(nxt.isNull(), prev["v"]).otherwise(between))
    return out.withColumns(filled).drop(*before, *after, "__pos", CHUNK)


def moving_average(
    df: DataFrame,
    value: str,
    order_by,
    sizes: Sequence[int] = (7, 30),
    partition_by=(),
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Row-count moving averages ``<value>_ma<n>``; null until a window is full and free of nulls.

    With several chunks, each chunk also gets the last ``max(sizes) - 1`` rows before it.
    """
    chunked, chunks = with_chunks(df, partition_by, order_by, rows_per_chunk)
    window = _local(partition_by, order_by)
    if chunks > 1:
        keys = [*partition_by, *order_by]
        halo = max(sizes) - 1
        starts = _chunk_starts(chunked, chunks)
        pos = F.row_number().over(Window.partitionBy(CHUNK).orderBy(*[col(k) for k in keys]))
        placed = chunked.withColumn("__pos", pos).join(starts, CHUNK)
        placed = placed.withColumn("__pos", F.col("__start") + F.col("__pos")).drop("__start")
        # The chunks that start within reach of a chunk's end: fewer than ``halo``, as each has a row.
        ends = chunked.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("__size")).join(starts, CHUNK).select(CHUNK, (F.col("__start") + F.col("__size")).alias("__end"))
        cell = lambda c: F.floor(c / max(halo, 1))
        near = ends.withColumn("__cell", F.explode(F.array(cell(F.col("__end")), cell(F.col("__end")) + 1)))
        later = starts.select(F.col(CHUNK).alias("to"), F.col("__start").alias("start"), cell(F.col("__start")).alias("__cell"))
        reached = near.join(later, "__cell").where((F.col("start") >= F.col("__end")) & (F.col("start") < F.col("__end") + halo) & (F.col("to") != F.col(CHUNK)))
        borders = reached.groupBy(CHUNK).agg(F.collect_list(F.struct("start", "to")).alias("__borders"))
        placed = placed.join(_shared(borders, chunks), CHUNK, "left")
        reach = F.filter(F.coalesce("__borders", F.array()), lambda b: F.col("__pos") > b["start"] - halo)
        own = F.array(F.col(CHUNK))
        placed = placed.withColumn("__to", F.concat(own, F.transform(reach, lambda b: b["to"]))).drop("__borders")
        chunked = placed.withColumn("__home", F.col(CHUNK)).withColumn(CHUNK, F.explode("__to"))
    averages = {}
    for size in sizes:
        span = window.rowsBetween(-(size - 1), 0)
        full = F.count(col(value)).over(span) == size
        averages[f"{value}_ma{size}"] = F.when(full, F.avg(col(value)).over(span))
    out = chunked.withColumns(averages)
    if chunks > 1:
        out = out.where(F.col("__home") == F.col(CHUNK)).drop("__home", "__to", "__pos")
    return out.drop(CHUNK)
