import hashlib
import math
from collections import Counter, defaultdict

import pytest

from millrace.llm import mixing

from .conftest import as_bag, frame


def brute(rows, q, block_chars):
    """Earliest deadline first, slot by slot, with exact fractions."""
    by = defaultdict(list)
    for doc, t, source, *_ in rows:
        by[source].append((hashlib.md5(("" if doc is None else str(doc)).encode()).hexdigest(), doc is not None, doc or 0, len(t or ""), doc))
    placed, blocks = [], {}
    for source, docs in by.items():
        at = 0
        for _, _, _, n, doc in sorted(docs):
            placed.append([doc, source, at, at // block_chars])
            at += n
        blocks[source] = max(1, math.ceil(at / block_chars))
    key = lambda s: "-" if s is None else "+" + s
    rounds = {s: math.ceil(b / q[s]) for s, b in blocks.items()}
    slot_of, slot = {}, 0
    for r in range(max(rounds.values(), default=0)):
        left = sorted((s for s in rounds if rounds[s] > r), key=key)
        width = sum(q[s] for s in left)
        done = Counter()
        for t in range(width):
            ready = [(-(-(done[s] + 1) * width // q[s]), i, s) for i, s in enumerate(left) if done[s] < q[s] and done[s] * width // q[s] <= t]
            due, _, s = min(ready)
            assert due > t
            slot_of[s, r * q[s] + done[s]] = slot
            done[s] += 1
            slot += 1
            for x in left:  # less than one block from the share
                assert abs(done[x] * width - q[x] * (t + 1)) < width
    return sorted((tuple([*p, slot_of[p[1], p[3]]]) for p in placed), key=repr)


def quotas(df, **how):
    return {None if r["source_key"] == "-" else r["source_key"][1:]: r["q"] for r in mixing.source_sizes(df, **how).collect()}


@pytest.mark.parametrize("weights", [None, {"s0": 5, "s1": 2, "s2": 1, None: 3}, {"s1": 1}, {}])
def test_odd_rows(odd, odd_rows, weights):
    how = {"weights": weights, "period": 23, "block_chars": 300}
    assert as_bag(mixing.mix(odd, **how)) == brute(odd_rows, quotas(odd, **how), 300)


def test_hot_source_and_columns(spark):
    rows = [(i, "x" * (i % 90), "hot" if i % 3 else f"t{i % 7}") for i in range(600)]
    docs = frame(spark, rows).repartition(4)
    got = mixing.mix(docs, carry=tuple(docs.columns), period=31, block_chars=200)
    assert as_bag(got.select("doc_id", "source", "source_offset", "block", "slot")) == brute(rows, quotas(docs, period=31, block_chars=200), 200)
    assert got.where("length(text) <> doc_id % 90").count() == 0 and "Key" in got.columns


def test_empty_table(nothing):
    assert mixing.mix(nothing).collect() == []


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_empty_texts_at_the_end_of_whole_blocks(spark, blocks):
    order = sorted(range(40), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    full = dict.fromkeys(order[:blocks], "x" * 200)
    rows = [(i, full.get(i, None if i % 2 else ""), "whole") for i in range(40)] + [(100 + i, "y" * 90, f"t{i % 3}") for i in range(30)]
    how = {"weights": {"whole": 1, "t0": 1, "t1": 1, "t2": 1}, "period": 4, "block_chars": 200}
    got = mixing.mix(frame(spark, rows), **how).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    last = [r for r in got if r["doc_id"] == order[blocks - 1]][0]
    for r in got:
        if r["source"] == "whole" and r["doc_id"] not in full:
            assert (r["source_offset"], r["block"], r["slot"]) == (blocks * 200, blocks - 1, last["slot"])
