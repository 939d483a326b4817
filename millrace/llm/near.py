"""SimHash near-duplicates by tiled exact comparison (operator 8).

Fingerprints are compared in tiles. A tile holds the fingerprints whose parts
(four of 16 bits, eight of 8 or sixteen of 4) have the same population counts.
Two fingerprints within ``RADIUS`` bits have counts whose differences add up to
``RADIUS`` at most, so every other pair of tiles is skipped. What is left is compared
exactly by exclusive-or and bit counts in numpy, in blocks of bounded size. A block
passes on a forest of its links, never all pairs; labels then spread by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.llm.common import fresh, lower_words, steps, text_bytes
from millrace.session import cut_lineage

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Neighbours of a node beyond which they are dealt into groups before labels spread.
HUB = 128
#: Fingerprints of a tile that are compared as one block, and those of neighbouring tiles that meet it at once.
HOME_BLOCK, OTHER_BLOCK = 1024, 8192
#: Fingerprints up to which tiles of so many parts stay small enough: comparisons for each fingerprint
#: are in the thousands either way, and the results are the same.
PARTS = ((4, 20_000_000), (8, 5_000_000_000), (16, None))
_FIELD = 5


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text's three-word shingles, repeats included."""
    words = lower_words(text)
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    step = min(SHINGLE, len(words))
    name = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - step + 1].tolist(), ends[step - 1 :].tolist())
    hashes = np.fromiter((name(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - step + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * ones > len(hashes)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        found = np.fromiter((fingerprint(t) for t in batch["text"].to_pylist()), np.uint64, batch.num_rows)
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), pa.array(found.view(np.int64))], [*kept, "bits"])


def _key() -> Column:
    return F.xxhash64(text_bytes())


def fingerprints(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id and bits (the fingerprint as a signed long) of every row; ``keyed`` adds key, 64 bits of the text."""
    keys = [_key().alias("key")] if keyed else []
    base = docs.select(col("doc_id").cast("long").alias("doc_id"), *keys, text_bytes().alias("text"))
    return base.mapInArrow(_fingerprints, "doc_id long, key long, bits long" if keyed else "doc_id long, bits long")


def _offsets(parts: int) -> list[int]:
    """Packed differences of population counts up to the radius in sum, of which one sign is kept."""
    out = {0}
    moves = [s << (_FIELD * i) for i in range(min(parts, 12)) for s in (1, -1)]
    for n in range(1, RADIUS + 1):
        out.update(sum(x) for x in product(moves, repeat=n))
    return sorted(x for x in out if x >= 0)


def _tile(parts: int):
    """The packed population counts of a fingerprint's parts.

    A long has room for twelve fields, so of sixteen parts the last five count as one; this
    only makes tiles coarser.
    """
    width = 64 // parts
    fields = min(parts, 12)
    out = F.lit(0).cast("long")
    for i in range(fields):
        bits = width if i < fields - 1 else 64 - width * (fields - 1)
        part = F.shiftrightunsigned(F.col("bits"), width * i).bitwiseAND(F.lit((1 << bits) - 1))
        out = out + F.shiftleft(F.bit_count(part).cast("long"), _FIELD * i)
    return out


def _forest(home: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Rows (fingerprint, fingerprint) that join what is within the radius, fewer than there are fingerprints."""
    both = np.concatenate((home, other))
    parent = np.arange(len(both))

    def roots(x):
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            x = up

    for i in range(0, len(home), 128):
        rows = home[i : i + 128]
        near = np.bitwise_count(rows[:, None] ^ both[None, :]) <= RADIUS
        a, b = np.nonzero(near)
        a += i
        while len(a):
            a, b = roots(a), roots(b)
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    top = roots(np.arange(len(both)))
    linked = top != np.arange(len(both))
    return np.stack((both[linked], both[top[linked]]), axis=1)


def _compare(table: pa.Table) -> pa.Table:
    bits = np.asarray(table["bits"]).view(np.uint64)
    home = np.asarray(table["home"])
    found = _forest(bits[home], bits[~home]) if home.any() else np.zeros((0, 2), np.uint64)
    return pa.table({"a": pa.array(np.ascontiguousarray(found[:, 0]).view(np.int64)), "b": pa.array(np.ascontiguousarray(found[:, 1]).view(np.int64))})


def links(distinct: DataFrame, parts: int | None = None) -> DataFrame:
    """Pairs (a, b) of ``distinct`` fingerprints (column bits) whose components are those of all links within the radius."""
    if parts is None:
        n = distinct.count()
        parts = next(p for p, most in PARTS if most is None or n <= most)
    tiled = distinct.select("bits", _tile(parts).alias("tile"))
    offsets = F.explode(F.array(*(F.lit(x).cast("long") for x in _offsets(parts))))
    counts = tiled.groupBy("tile").count()
    # What meets a tile: itself and the tiles above it within the radius.
    meets = counts.select(offsets.alias("off"), "tile", "count").select((F.col("tile") - F.col("off")).alias("tile"), "count")
    meets = meets.groupBy("tile").agg(F.sum("count").alias("others"))
    sizes = counts.join(meets, "tile").select(
        "tile",
        F.ceil(F.col("count") / HOME_BLOCK).cast("int").alias("home_blocks"),
        F.ceil(F.col("others") / OTHER_BLOCK).cast("int").alias("other_blocks"),
    )
    if parts == 4:  # at most 17^4 tiles of four counts from 0 to 16
        sizes = F.broadcast(sizes)
    name = F.xxhash64("bits")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = tiled.join(sizes, "tile").select(
        "tile", F.pmod(name, F.col("home_blocks")).cast("int").alias("i"), every("other_blocks").alias("j"), "bits", F.lit(True).alias("home")
    )
    other = tiled.select("bits", offsets.alias("off"), "tile").select("bits", (F.col("tile") - F.col("off")).alias("tile"))
    other = other.join(sizes, "tile").select(
        "tile", every("home_blocks").alias("i"), F.pmod(name, F.col("other_blocks")).cast("int").alias("j"), "bits", F.lit(False).alias("home")
    )
    units = home.unionByName(other)
    return units.groupBy("tile", "i", "j").applyInArrow(_compare, "a long, b long")


def _without_hubs(pairs: DataFrame) -> DataFrame:
    """Pairs with the same components in which no node stands in many.

    A node with more than ``HUB`` partners deals them into about the root of their number of groups. Each group hangs on
    its smallest partner, and only those hang on the node. That is done for both ends, a second time
    for what is left of very large ones.
    """
    for x, y in (("a", "b"), ("b", "a")) * 2:
        hubs = pairs.groupBy(x).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB).select(x, F.ceil(F.sqrt("n")).cast("int").alias("groups"))
        hubs = cut_lineage(hubs)
        if hubs.isEmpty():
            continue
        dealt = pairs.join(hubs, x, "left").withColumn("salt", F.pmod(F.xxhash64(y), F.col("groups")))
        hung = dealt.where("groups IS NOT NULL")
        least = hung.groupBy(x, "salt").agg(F.min(y).alias("least"))
        to_least = hung.join(least, [x, "salt"]).where(F.col(y) != F.col("least")).select(F.col("least").alias(x), y)
        pairs = cut_lineage(dealt.where("groups IS NULL").select(x, y).unionByName(to_least).unionByName(least.select(x, F.col("least").alias(y))))
    return pairs


def components(pairs: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) of every node of the pairs (a, b).

    Each round takes the smallest label among neighbours, hooks the old label on to it and
    halves the paths; the rounds grow with the logarithm of the longest chain. Pairs are dealt
    first so that no node has many neighbours.
    """
    ordered = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = _without_hubs(cut_lineage(ordered.distinct()))
    edges = cut_lineage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label"))
    state = cut_lineage(state.withColumn("moved", F.lit(True)))
    while not state.where("moved").isEmpty():
        known = state.select("node", "label")
        told = edges.join(known, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("own"))
        heard = told.unionByName(known.withColumn("own", F.col("label"))).groupBy("node").agg(F.min("label").alias("low"), F.max("own").alias("own"))
        hooks = heard.select("node", "low", "own").unionByName(heard.select(F.col("own").alias("node"), "low", F.lit(None).cast("long").alias("own")))
        hooked = hooks.groupBy("node").agg(F.min("low").alias("low"), F.max("own").alias("own"))
        up = hooked.select(F.col("node").alias("low"), F.col("low").alias("label"))
        state = cut_lineage(hooked.join(up, "low").select("node", "label", (F.col("label") != F.col("own")).alias("moved")))
    return state.select("node", "label")


def clusters(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest doc_id that links of at most ``RADIUS`` bits reach, itself
    included. Texts without words have fingerprint zero and link like any other. A row
    without an id takes part; its component_id is null only if no linked row has one. Equal
    rows give equal rows. Null texts count as empty; other columns are not read.
    """
    found = _clusters(cut_lineage(fingerprints(docs)), parts)
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def _clusters(marked: DataFrame, parts: int | None) -> DataFrame:
    """The rows of ``marked`` (doc_id, bits and others) with component_id."""
    distinct = marked.groupBy("bits").agg(F.min("doc_id").alias("least"))
    labels = components(links(distinct.select("bits"), parts))
    named = distinct.join(labels, distinct["bits"] == labels["node"], "left").select("bits", "least", F.coalesce("label", "bits").alias("label"))
    lowest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_bits = named.join(lowest, "label").select("bits", "component_id")
    return marked.join(of_bits, "bits")


def keep_one(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows without an id stay."""
    gone, gone_key = fresh(docs, "gone_id", "gone_key")
    losers = _clusters(cut_lineage(fingerprints(docs, keyed=True)), parts).where("doc_id <> component_id")
    losers = losers.select(F.col("doc_id").alias(gone), F.col("key").alias(gone_key)).distinct()
    return docs.join(losers, (col("doc_id").cast("long") == F.col(gone)) & (_key() == F.col(gone_key)), "left_anti")
