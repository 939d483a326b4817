import random

import numpy as np

from millrace.llm import minhash, near

from .brute import components, lower, words
from .conftest import as_bag, frame, sentences


def sets(rows):
    out = []
    for _, t, *_ in rows:
        w = words(lower(t))
        n = min(5, len(w))
        out.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    return out


def groups(rows):
    """(id, size of the set, least id of the component, kept) of every row, by all pairs."""
    found = sets(rows)
    close = lambda a, b: a and b and 100 * len(a & b) >= 85 * len(a | b)
    label = components([(i, j) for i in range(len(rows)) for j in range(i) if close(found[i], found[j])], range(len(rows)))
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(label[i], []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((r[0], len(found[i]), least[label[i]], r[0] == least[label[i]]) for i, r in enumerate(rows)), key=repr)


def edited(text, places, seed):
    r = random.Random(seed)
    w = text.split()
    for p in r.sample(range(len(w)), places):
        w[p] = f"edit{seed}x{p}"
    return " ".join(w)


def near_rows():
    """Texts with none to many changed words, a large group among them, and texts that only share a long passage."""
    rows, n = [], 0
    for base in sentences(4, 3, 600):
        text = " ".join(sentences(6, len(base), 60)) + " " + base
        for places in (0, 1, 2, 3, 4, 6, 9):
            rows.append((n, edited(text, places, n), "s"))
            n += 1
    core = " ".join(sentences(9, 77, 60))
    rows += [(1000 + i, edited(core, 1 + i % 6, 1000 + i), "s") for i in range(60)]
    return rows


def found(df):
    return as_bag(minhash.clusters(df).select("doc_id", "n_shingles", "component_id", "kept"))


def test_all_pairs(spark, odd, odd_rows):
    assert found(odd) == groups(odd_rows)
    assert found(frame(spark, near_rows()).repartition(3)) == groups(near_rows())


def test_large_keys_in_blocks(spark, monkeypatch):
    """The way of large keys, with blocks of a few sets, and groups that are dealt into parts."""
    for name, value in (("SMALL", 1), ("HOME_BYTES", 3000), ("OTHER_BYTES", 6000), ("GROUP_BYTES", 2000)):
        monkeypatch.setattr(minhash, name, value)
    assert found(frame(spark, near_rows())) == groups(near_rows())


def test_block_of_a_key():
    """A block links what the leader of a key does not: a pair of nodes, neither in the largest component."""
    import pyarrow as pa

    lists = [[1, 2, 3, 4], [1, 2, 3, 5], [7, 8, 9], [1, 2, 3, 4], [7, 8, 9], [1, 2, 3, 5]]
    table = pa.table({
        "node": pa.array([1, 2, 3, 1, 3, 2], pa.int64()), "label": pa.array([1, 2, 3, 1, 3, 2], pa.int64()),
        "home": [True, False, True, False, False, False], "other": [False, True, False, True, True, True], "set": pa.array(lists, pa.list_(pa.int64())),
    })
    assert set(zip(*(minhash._compare(60)(table)[c].to_pylist() for c in "ab"))) == {(1, 2)}
    assert minhash._compare(61)(table).num_rows == 0
    both = table.slice(3, 3).set_column(2, "home", pa.array([True] * 3))
    assert set(zip(*(minhash._compare(60)(both)[c].to_pylist() for c in "ab"))) == {(1, 2)}  # a forest
    empty = table.filter(pa.array([True, False, True, False, False, False]))
    assert minhash._compare(60)(empty).num_rows == 0


def test_no_link_is_missed():
    """Pairs of sets at the threshold share a table as often as the method says: all but 2e-5."""
    r = np.random.default_rng(5)
    missed = 0
    for _ in range(2000):
        core = r.integers(0, 1 << 63, 340, np.uint64)
        a, b = (np.unique(np.concatenate((core, r.integers(0, 1 << 63, 30, np.uint64)))) for _ in range(2))
        assert 100 * 340 >= 85 * 400
        x, y = minhash.half_bands(a), minhash.half_bands(b)
        same = x == y
        missed += not (same[: minhash.HALVES].any() and same[minhash.HALVES :].any())
    assert missed <= 1


def test_threshold_is_exact(spark):
    """34 of 40 shingles shared is 0.85 and links; 33 of 39 is less and does not."""
    one = [f"a{i}" for i in range(41)]  # 37 shingles
    two = one[:38] + ["x", "y", "z"]  # shares 34, union 40
    three = [f"b{i}" for i in range(40)]  # 36 shingles
    four = three[:37] + ["x", "y", "z"]  # shares 33, union 39
    rows = [(1, " ".join(one), "s"), (2, " ".join(two), "s"), (3, " ".join(three), "s"), (4, " ".join(four), "s")]
    assert [r[2] for r in found(frame(spark, rows))] == [1, 1, 3, 4] == [r[2] for r in groups(rows)]


def test_keep_one(spark):
    a, b = (" ".join(sentences(8, k, 60)) for k in (11, 12))
    rows = [(5, a, "s"), (6, edited(a, 1, 6), "s"), (3, b, "s"), (5, edited(b, 1, 5), "s"), (8, "", "s"), (9, None, "s")]
    kept = sorted((r["doc_id"], r["text"] or "") for r in minhash.keep_one(frame(spark, rows)).collect())
    assert kept == [(3, b), (5, a), (8, ""), (9, "")]


def test_long_text(spark):
    """A text far longer than a step of the Arrow function, and a copy with one other word."""
    long = " ".join(f"w{i % 5003}x{i % 4099}" for i in range(1_000_000))
    rows = [(1, long, "s"), (2, long + " end", "s"), (3, "short text", "s")]
    got = found(frame(spark, rows))
    assert [(r[0], r[2]) for r in got] == [(1, 1), (2, 1), (3, 3)] and got[0][1] == 999_996


def test_empty_table(nothing):
    assert minhash.clusters(nothing).collect() == [] and minhash.keep_one(nothing).columns == nothing.columns


def test_components_of_hubs(spark):
    """Stars far larger than a group, at either end of the pairs, and a chain between them."""
    pairs = [(0, i) for i in range(1, 3000)] + [(i, 9999) for i in range(5000, 8000)] + [(2999, 5000)] + [(20000, 20001)]
    got = {r["node"]: r["label"] for r in near.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert set(got) == {x for p in pairs for x in p}
    assert {v for k, v in got.items() if k < 10000} == {0} and got[20001] == got[20000] == 20000
