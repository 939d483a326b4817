"""MinHash near-duplicates with tensored banding (operator 11).

A text is its set of word shingles; texts with equal sets are one node, named by 64 bits. Two collections of ``HALVES``
half bands, each of ``ROWS`` minhashes, are computed for a node. A table's key is a pair, one half band from
each collection, so 2 x ``HALVES`` half bands serve ``HALVES`` squared tables. Two sets of similarity s share a
table with probability (1 - (1 - s^ROWS)^HALVES)^2: all but 2e-5 at 0.85, all but 2e-7 at 0.9.

A half band that no other node has is in no shared key. So half bands are counted first, and only pairs of
shared ones become keys.

What meets under a key is verified on whole sets. First each node meets one node, the least it meets anywhere; what these links
join has one label. Then the open keys, whose nodes do not all have one label, are met: all pairs
of a small one; of a large one each node with the least, then, in blocks, all that has not the commonest label of a
half band's nodes with all of these. So every pair that shares a key is verified, or is in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.llm.blocks import mixed, word_hashes
from millrace.llm.common import fresh, lower_words, steps, text_bytes
from millrace.llm.near import components
from millrace.operators.joins import small_side
from millrace.session import cut_lineage

SHINGLE = 5
#: Two sets are linked if ``PERCENT`` times their union is at most a hundred times what they share.
PERCENT = 85
HALVES, ROWS = 12, 3
#: Nodes of a key up to which all its pairs are met one by one.
SMALL = 12
#: Bytes of sets that meet one node, and those of a block of a large key and of what meets it.
GROUP_BYTES, HOME_BYTES, OTHER_BYTES = 256 << 10, 2 << 20, 2 << 20
#: Stands for a row without an id where rows are found again.
NO_ID = -(1 << 63)

_draw = np.random.default_rng(20)
_MASKS = _draw.integers(0, 1 << 64, 2 * HALVES * ROWS, np.uint64)
_FACTORS = _draw.integers(0, 1 << 64, 2 * HALVES * ROWS, np.uint64) | np.uint64(1)
_PLACES = _draw.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_FULL = np.iinfo(np.uint64).max


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit names of a text's different shingles; a shorter text is one shingle."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    names = word_hashes(words, 11)
    step = min(shingle, len(words))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) - step + 1, np.uint64)
        for k in range(step):
            sums += mixed(names[k : k + len(sums)], 100 + k) * _PLACES[k % len(_PLACES)]
        return np.unique(mixed(sums, step))


def _name(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 1)


def half_bands(found: np.ndarray) -> np.ndarray:
    """One name for each half band of a set, the first collection before the second; none for the empty set."""
    if not len(found):
        return np.zeros(0, np.uint64)
    least = np.empty(len(_MASKS), np.uint64)
    with np.errstate(over="ignore"):
        for i, (mask, factor) in enumerate(zip(_MASKS, _FACTORS)):
            least[i] = ((found ^ mask) * factor).min()
        bands = np.zeros(2 * HALVES, np.uint64)
        for r in range(ROWS):
            bands = mixed(bands ^ least[r::ROWS], r)
        return mixed(bands, 7) ^ mixed(np.arange(2 * HALVES, dtype=np.uint64), 8)


def _longs(values) -> pa.Array:
    return pa.array(np.fromiter(values, np.uint64).view(np.int64))


def _lists(rows: list) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate([np.asarray(r, np.uint64) for r in rows]) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _key() -> Column:
    return F.xxhash64(text_bytes())


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = [shingles(t, shingle) for t in batch["text"].to_pylist()]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["key"], sizes, _longs(map(_name, sets)), _lists([half_bands(s) for s in sets])], ["doc_id", "key", "size", "node", "halves"]
            )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = [shingles(t, shingle) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([_longs(map(_name, sets)), _lists(sets)], ["node", "set"])

    return run


def _near(common, x, y, percent: int):
    """Whether sets of sizes x and y that share ``common`` shingles are linked; works on columns and arrays."""
    return common * 100 >= (x + y - common) * percent


def _may(x: Column, y: Column, percent: int) -> Column:
    """Whether sets of these sizes can be linked at all."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of the pairs (a, b, sb; sb is the size of b).

    A set that meets many others is copied once for ``GROUP_BYTES`` of them, which spreads it over tasks.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.sum("sb") * 8 / GROUP_BYTES).cast("int").alias("parts"))
    heavy = small_side(groups.where("parts > 1"))
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0))
    dealt = pairs.select("a", "b").join(heavy, "a", "left").select("a", "b", part.alias("part"))
    # A group may be empty by the hash; that costs a row.
    heads = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    heads = heads.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = dealt.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").join(heads, ["a", "part"])
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(_near(common, F.size("set_a"), F.size("set_b"), percent)).select("a", "b")


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        node, label, home, other = (np.asarray(table[c]) for c in ("node", "label", "home", "other"))
        sets = table["set"].combine_chunks()
        sizes = np.diff(np.asarray(sets.offsets))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        _, ids = np.unique(np.asarray(sets.flatten()), return_inverse=True)
        others = np.flatnonzero(other)
        entries, owner = ids[np.repeat(other, sizes)], np.repeat(np.arange(len(others)), sizes[others])
        held = np.zeros(len(ids) and int(ids.max()) + 1, bool)
        _, group = np.unique(label, return_inverse=True)
        parent = np.arange(len(table))
        out = []

        def root(g: int) -> int:
            while parent[g] != g:
                parent[g] = parent[parent[g]]
                g = parent[g]
            return g

        for h in np.flatnonzero(home) if len(others) else ():
            own = ids[ends[h] : ends[h + 1]]
            held[own] = True
            common = np.bincount(owner[held[entries]], minlength=len(others))
            held[own] = False
            found = others[_near(common, sizes[others], sizes[h], percent)]
            # A forest of links is enough: fewer than the block has nodes, however many of them are linked.
            for g, at in zip(*np.unique(group[found], return_index=True)):
                x, y = root(int(group[h])), root(int(g))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((node[h], node[found[at]]))
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(np.ascontiguousarray(a)), "b": pa.array(np.ascontiguousarray(b))})

    return run


def _blocks(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the nodes (half, node, size, label) of large keys, met by the half band that keys share.

    All outside the largest component of a half band's nodes meets all of them. One half band stands for up to
    ``HALVES`` keys of almost the same nodes, so a set is copied once for all of these.
    """
    parts = large.groupBy("half", "label").agg(F.sum("size").alias("bytes"))
    tops = parts.groupBy("half").agg(F.max_by("label", F.struct("bytes", "label")).alias("top"), F.sum("bytes").alias("all"), F.max("bytes").alias("most"))
    tops = tops.where("all > most").select(
        "half", "top", F.ceil((F.col("all") - F.col("most")) * 8 / HOME_BYTES).cast("int").alias("homes"), F.ceil(F.col("all") * 8 / OTHER_BYTES).cast("int").alias("others")
    )
    rows = large.join(small_side(tops), "half")
    name, apart, alone = F.xxhash64("node"), F.col("label") != F.col("top"), (F.col("homes") == 1) & (F.col("others") == 1)
    every = lambda n, place: F.transform(F.sequence(F.lit(0), F.col(n) - 1), place)
    place = lambda i, j, home, other: F.struct(i.alias("i"), j.alias("j"), home.alias("home"), other.alias("other"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    home = every("others", lambda j: place(F.pmod(name, F.col("homes")).cast("int"), j, yes, no))
    other = every("homes", lambda i: place(i, F.pmod(name, F.col("others")).cast("int"), no, yes))
    places = F.when(alone, F.array(place(zero, zero, apart, yes))).when(apart, F.concat(home, other)).otherwise(other)
    units = rows.select("half", "node", "label", F.explode(places).alias("at")).select("half", "node", "label", "at.*").join(sets, "node")
    return units.groupBy("half", "i", "j").applyInArrow(_compare(percent), "a long, b long")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """key, node, size, half (the first half band of the key), n and leader (the least node) of each key of several ``nodes`` (node, size, halves)."""
    rows = nodes.select("node", "size", F.posexplode("halves").alias("place", "value"))
    twice = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value")
    kept = rows.join(small_side(twice), "value")
    side = lambda first: F.collect_list(F.when((F.col("place") < HALVES) == F.lit(first), F.col("value")))  # noqa: E731  # at most HALVES each
    both = kept.groupBy("node").agg(F.first("size").alias("size"), side(True).alias("u"), side(False).alias("v"))
    keys = both.select("node", "size", F.explode("u").alias("half"), "v").select("node", "size", "half", F.explode("v").alias("y"))
    keys = keys.select("node", "size", "half", F.xxhash64("half", "y").alias("key"))
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size")).alias("leader")).where("n > 1")
    return keys.join(counts, "key")


def links(docs: DataFrame, marked: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Linked pairs (a, b) of nodes; their components are those of all linked pairs that share a key."""
    least = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    nodes = marked.where("size > 0").groupBy("node").agg(
        F.first("size").alias("size"), F.first("halves").alias("halves"), F.min(F.struct(least.alias("id"), "key")).alias("one")
    )
    nodes = cut_lineage(nodes)
    shared = cut_lineage(shared_keys(nodes))
    # One text of each node that is met; sets are worked out again for these alone. Copies of a text differ by id, so none is a hot key.
    met = small_side(nodes.join(shared.select("node").distinct(), "node", "left_semi").select("one.*").distinct())
    texts = docs.select(F.coalesce(col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), _key().alias("key"), text_bytes().alias("text"))
    sets = texts.join(met, ["id", "key"], "left_semi").select("text").mapInArrow(_sets(shingle), "node long, set array<long>")
    sets = cut_lineage(sets.dropDuplicates(["node"]))

    fits = (F.col("node") != F.col("leader.node")) & _may(F.col("size"), F.col("leader.size"), percent)
    one = cut_lineage(shared.where(fits).groupBy("node").agg(F.min("leader.node").alias("a"), F.first("size").alias("sb")))
    first = cut_lineage(_verified(one.select("a", F.col("node").alias("b"), "sb"), sets, percent))

    # A node has one link at most so far, to a lesser one: following it twice names most of its component. Equal labels are
    # of one component, which saves checks; different ones may be, which costs some.
    up = lambda n, to: first.select(F.col("b").alias(n), F.col("a").alias(to))
    named = small_side(up("node", "p").join(up("p", "q"), "p", "left").select("node", F.coalesce("q", "p").alias("label")))
    labelled = shared.join(named, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labels = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    open_ = cut_lineage(labelled.join(small_side(labels), "key"))
    member = F.struct("node", "size", "label")
    small = open_.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(member)).alias("all"))  # at most SMALL
    pairs = small.select(F.posexplode("all").alias("at", "x"), "all").select("x", F.explode(F.slice("all", F.col("at") + 2, SMALL)).alias("y"))
    pairs = pairs.where((F.col("x.label") != F.col("y.label")) & _may(F.col("x.size"), F.col("y.size"), percent))
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("y.size").alias("sb"))
    # A pair of one label needs no check; a least node that is not in ``named`` is its own label.
    led = open_.where((F.col("n") > SMALL) & fits).select(F.col("leader.node").alias("a"), F.col("node").alias("b"), F.col("size").alias("sb"), "label")
    led = led.distinct().join(named.select(F.col("node").alias("a"), F.col("label").alias("label_a")), "a", "left")
    led = led.where(F.col("label") != F.coalesce("label_a", "a")).select("a", "b", "sb")
    met_once = one.select("a", F.col("node").alias("b"))
    rest = pairs.unionByName(led).distinct().join(met_once, ["a", "b"], "left_anti")
    second = first.unionByName(_verified(rest, sets, percent))

    large = cut_lineage(open_.where(F.col("n") > SMALL).select("half", "node", "size", "label").distinct())
    return second if large.isEmpty() else second.unionByName(_blocks(large, sets, percent))


def clusters(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row, and key (64 bits of the text).

    component_id is the smallest doc_id that links reach, itself included. A text without words, and a null one, has an
    empty set that is linked with nothing, not even with its like. A row without an id takes part; its component_id
    is null only if no linked row has one. kept marks rows whose id is that of their component, so equal rows are kept or
    not together. Texts of any length are sets in one task. An empty table gives none. Other columns are not read.
    """
    base = docs.select(col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), text_bytes().alias("text"))
    marked = cut_lineage(base.mapInArrow(_sketches(shingle), "doc_id long, key long, size long, node long, halves array<long>"))
    labels = components(links(docs, marked, shingle, percent))
    named = marked.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_node = named.join(lowest, "label").select("node", "component_id")
    found = marked.where("size > 0").join(by_node, "node").select("doc_id", "size", "component_id", "key")
    alone = marked.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"), "key")
    out = found.unionByName(alone)
    return out.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "key")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows without an id stay."""
    gone, gone_key = fresh(docs, "gone_id", "gone_key")
    losers = clusters(docs, shingle, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(gone), F.col("key").alias(gone_key)).distinct()
    return docs.join(losers, (col("doc_id").cast("long") == F.col(gone)) & (_key() == F.col(gone_key)), "left_anti")
