"""Mixing sources to target weights by Pfair scheduling (operator 6). DataFrame functions only.

Each source is cut into blocks of ``BLOCK_CHARS`` characters. Its target weight is a whole
number q of slots in a round of Q, the sum of all q. In a round, block j of a source is
released at floor(j Q / q) and due at ceil((j + 1) Q / q); each slot goes to the released
block that is due first. One processor and weights that add up to one: every block meets its
deadline, so at any slot each source is less than one block away from its share, and exactly
on it at the end of a round. When a source is used up, later rounds go on without it. A
schedule for one round and each set of sources left is all that has to be worked out; rows
find their slot in it by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.session import cut_lineage

BLOCK_CHARS = 20_000
#: About how many slots a round has; the weights' resolution.
PERIOD = 200
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 2_000


def _source_key(name: str = "source") -> Column:
    return F.when(col(name).isNull(), "-").otherwise(F.concat(F.lit("+"), col(name).cast("string")))


def _blocks(block_chars: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.col("chars") / block_chars))


def source_sizes(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5, period: int = PERIOD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """source_key, n, chars, q (slots in a round) and rounds of every source.

    Without ``weights`` a source's weight is its characters to the power ``alpha``. A source that
    ``weights`` does not name, or names with nothing, gets one slot.
    """
    sizes = docs.groupBy(_source_key().alias("source_key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length(F.coalesce(col("text").cast("string"), F.lit("")))).alias("chars")
    )
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(float(alpha)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit("-" if k is None else f"+{k}"), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("source_key")], F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("weight")).first()[0] or 0.0
    q = F.greatest(F.lit(1), F.round(F.col("weight") * F.lit(period / total if total else 0.0))).cast("long")
    return sizes.withColumn("q", q).withColumn("rounds", F.ceil(_blocks(block_chars) / F.col("q")).cast("long")).drop("weight")


def round_schedules(sizes: DataFrame) -> DataFrame:
    """source_key, since, until, base, width, turn and place.

    In rounds from ``since`` to before ``until``, which start at slot ``base`` and have ``width`` slots each,
    the source's block number ``turn`` of the round is at ``place``. One row for each slot of a round and set of sources left.
    """
    q_sum = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["q"])
    left = lambda until: F.filter("all", lambda x: x["rounds"] >= until)
    one = sizes.agg(F.sort_array(F.collect_list(F.struct("source_key", "q", "rounds"))).alias("all"))
    one = one.withColumn("ends", F.array_sort(F.array_distinct(F.transform("all", lambda x: x["rounds"]))))
    one = one.withColumn("widths", F.transform("ends", lambda e: q_sum(left(e))))
    since = lambda i: F.when(i > 0, F.element_at("ends", i.cast("int"))).otherwise(F.lit(0).cast("long"))
    one = one.withColumn("lengths", F.transform("ends", lambda e, i: (e - since(i)) * F.element_at("widths", (i + 1).cast("int"))))
    phases = one.select("all", "ends", "widths", "lengths", F.posexplode("ends").alias("p", "until")).select(
        "until",
        since(F.col("p")).alias("since"),
        F.element_at("widths", F.col("p") + 1).alias("width"),
        F.aggregate(F.slice("lengths", F.lit(1), F.col("p")), F.lit(0).cast("long"), lambda a, x: a + x).alias("base"),
        left(F.col("until")).alias("left"),
    )
    width = F.col("width")

    def slot(state, t):
        done = state["done"]
        ready = F.transform(
            "left",
            lambda x, i: F.when(
                (done[i] < x["q"]) & (F.floor(done[i] * width / x["q"]) <= t),
                F.struct(F.ceil((done[i] + 1) * width / x["q"]).alias("due"), i.alias("i"), done[i].alias("turn")),
            ),
        )
        first = F.array_min(ready)
        return F.struct(
            F.transform(done, lambda d, i: d + F.when(i == first["i"], F.lit(1)).otherwise(F.lit(0))).alias("done"),
            F.concat(state["turns"], F.array(F.struct(first["i"].alias("i"), first["turn"].cast("long").alias("turn")))).alias("turns"),
        )

    start = F.struct(
        F.transform("left", lambda x: F.lit(0).cast("long")).alias("done"), F.expr("CAST(array() AS array<struct<i:int,turn:bigint>>)").alias("turns")
    )
    turns = F.aggregate(F.sequence(F.lit(0).cast("long"), width - 1), start, slot, lambda s: s["turns"])
    return (
        phases.withColumn("turns", turns)
        .select("until", "since", "base", "width", "left", F.posexplode("turns").alias("place", "at"))
        .select(F.element_at("left", F.col("at.i") + 1)["source_key"].alias("source_key"), "since", "until", "base", "width", F.col("at.turn").alias("turn"), F.col("place").cast("long").alias("place"))
    )


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    carry: tuple[str, ...] = (),
    alpha: float = 0.5,
    period: int = PERIOD,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """doc_id, source, source_offset, block, slot of every row, then the columns ``carry``.

    Inside a source, rows go by the MD5 of their id; source_offset counts the characters before a
    row. A row belongs to the block that it starts in, or to the last one if it is an empty text at the end of
    its source; a text of several blocks leaves the slots of the others empty. Training reads by slot, then source_offset. No row is left out or repeated: null
    texts have no characters, null sources are a source of their own, equal rows stay apart. A hot
    source is cut along the hash into ranges, whose totals are carried forward.
    """
    spark = docs.sparkSession
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = cut_lineage(source_sizes(docs, weights, alpha, period, block_chars))
    total = sizes.agg(F.sum("n"), F.count(F.lit(1))).first()
    small = F.broadcast if total[1] <= BROADCAST_SOURCES else (lambda df: df)
    last = _blocks(block_chars) - 1
    cuts = sizes.select("source_key", "q", last.alias("last"), F.greatest(F.lit(1), F.ceil(F.col("n") * ranges / (total[0] or 1))).alias("ranges"))
    extra = [c for c in carry if c.lower() not in ("doc_id", "source", "source_offset", "block", "slot")]
    rows = docs.select(
        _source_key().alias("source_key"),
        col("doc_id").cast("long").alias("doc_id"),
        col("source").cast("string").alias("source"),
        F.char_length(F.coalesce(col("text").cast("string"), F.lit(""))).cast("long").alias("chars"),
        F.md5(F.coalesce(col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("order"),
        *(col(c).alias(f"carried_{i}") for i, c in enumerate(extra)),
    )
    u = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 2**32
    rows = rows.join(small(cuts), "source_key").withColumn("range", F.floor(u * F.col("ranges"))).drop("ranges")
    totals = rows.groupBy("source_key", "range").agg(F.sum("chars").alias("sum"))
    before = W.partitionBy("source_key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("source_key", "range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("source_key", "range").orderBy("order", "doc_id", "chars").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(totals, ["source_key", "range"]).withColumn("source_offset", F.col("start") + F.coalesce(F.sum("chars").over(inside), F.lit(0)))
    rows = rows.withColumn("block", F.least(F.floor(F.col("source_offset") / block_chars), F.col("last")))
    rows = rows.withColumn("round", F.floor(F.col("block") / F.col("q"))).withColumn("turn", F.col("block") % F.col("q"))
    schedule = cut_lineage(round_schedules(sizes))
    ends = sorted(r[0] for r in sizes.select("rounds").distinct().collect()) if total[1] <= BROADCAST_SOURCES else None
    at = ["source_key", "turn"]
    if ends:
        rows = rows.withColumn("until", F.array_min(F.filter(F.lit(ends), lambda e: e > F.col("round"))))
        at.append("until")
    placed = rows.join(small(schedule), at)
    if not ends:
        placed = placed.where("round >= since AND round < until")
    slot = F.col("base") + (F.col("round") - F.col("since")) * F.col("width") + F.col("place")
    return placed.select(
        "doc_id", "source", "source_offset", "block", slot.alias("slot"), *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(extra))
    )
