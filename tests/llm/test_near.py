import random

import pytest
import xxhash

from millrace.llm import near

from .brute import components, lower, words
from .conftest import as_bag, frame


def simhash(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(rows):
    prints = [simhash(t) for _, t, *_ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    label = components(pairs, range(len(rows)))
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(label[i], []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((r[0], f"{prints[i]:016x}", least[label[i]]) for i, r in enumerate(rows)), key=repr)


def test_odd_rows(odd, odd_rows):
    assert as_bag(near.clusters(odd)) == brute(odd_rows)


@pytest.mark.parametrize("parts", [4, 8, 16])
def test_links_on_dense_fingerprints(spark, parts):
    r = random.Random(parts)
    centres = [r.getrandbits(64) for _ in range(4)]
    prints = {c for c in centres} | {0, (1 << 64) - 1, 3, 5}
    for c in centres:
        x = c
        for _ in range(60):
            x ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            prints.add(x)
    prints |= {centres[0] ^ (1 << i) for i in range(64)}
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = near.components(near.links(spark.createDataFrame([(signed(p),) for p in prints], "bits long"), parts)).collect()
    got = {r["node"]: r["label"] for r in got}
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 2]
    want = components([(signed(a), signed(b)) for a, b in pairs], [signed(p) for p in prints])
    alone = {signed(p) for p in prints} - {signed(x) for ab in pairs for x in ab}
    assert got == {n: v for n, v in want.items() if n not in alone}


def test_blocks_are_split(spark, monkeypatch):
    monkeypatch.setattr(near, "HOME_BLOCK", 7)
    monkeypatch.setattr(near, "OTHER_BLOCK", 11)
    test_links_on_dense_fingerprints(spark, 4)


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r["label"] for r in near.components(edges).collect()} == {0}


def test_one_of_a_group_stays(odd, odd_rows):
    kept = near.keep_one(odd)
    want = sorted((r[0] for r in brute(odd_rows) if r[0] is None or r[0] == r[2]), key=repr)
    assert kept.columns == odd.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == want


def test_empty_table(nothing):
    assert near.clusters(nothing).collect() == []


def test_an_id_on_two_texts_keeps_each_group(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, a, "s"), (6, a.upper(), "s"), (3, b, "s"), (5, b.upper(), "s")]
    assert sorted((r["doc_id"], r["text"]) for r in near.keep_one(frame(spark, rows)).collect()) == [(3, b), (5, a)]
