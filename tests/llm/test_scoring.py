import math
import zlib
from collections import Counter

import numpy as np

from millrace.llm import scoring

from .brute import lower, words
from .conftest import frame


def trained(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 != 2


def stream(text):
    return " ".join(words(lower(text))).encode() + b"\n"


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Tree:
    """One node of the tree over byte contexts, for one binary choice."""

    def __init__(self, depth):
        self.n, self.depth, self.children = [0, 0], depth, {}

    def add(self, context, bit):
        self.n[bit] += 1
        if self.depth < scoring.DEPTH:
            self.children.setdefault(context[-1 - self.depth], Tree(self.depth + 1)).add(context, bit)

    def weigh(self):
        self.kt = kt(*self.n)
        if self.depth == scoring.DEPTH:
            self.w = self.kt
        else:
            below = sum(c.weigh() for c in self.children.values())
            self.w = np.logaddexp(self.kt, below) + math.log(0.5)
        return self.w

    def predict(self, context, bit):
        own = (self.n[bit] + 0.5) / (sum(self.n) + 1)
        if self.depth == scoring.DEPTH:
            return own
        stop = 0.5 * math.exp(self.kt - self.w)
        child = self.children.get(context[-1 - self.depth])
        return stop * own + (1 - stop) * (child.predict(context, bit) if child else 0.5)


def brute(rows):
    trees = {}
    data = [stream(t) for _, t, *_ in rows]

    def choices(s):
        padded = b"\0" * scoring.DEPTH + s
        for i, byte in enumerate(s):
            for k in range(8):
                yield padded[i : i + scoring.DEPTH], (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1

    for r, s in zip(rows, data):
        if trained(r[0]):
            for context, prefix, bit in choices(s):
                trees.setdefault(prefix, Tree(0)).add(context, bit)
    for t in trees.values():
        t.weigh()
    scores = [sum(math.log10(trees[p].predict(c, b)) if p in trees else math.log10(0.5) for c, p, b in choices(s)) for s in data]
    tokens = [words(lower(t)) + ["\n"] for _, t, *_ in rows]
    count = Counter(w for r, ws in zip(rows, tokens) if trained(r[0]) for w in ws)
    n, v = sum(count.values()), len(count)
    base = [sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in ws) for ws in tokens]
    return [(r[0], not trained(r[0]), len(ws), sum(count[w] > 0 for w in ws), n, b, s) for r, ws, b, s in zip(rows, tokens, base, scores)]


def close(got, want):
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(sorted(got, key=lambda x: (repr(x[:5]), x[5])), sorted(want, key=lambda x: (repr(x[:5]), x[5]))):
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-5, abs_tol=1e-4)


def test_odd_rows(odd, odd_rows, nothing):
    close([tuple(r)[:7] for r in scoring.score(odd).collect()], brute(odd_rows))
    assert scoring.score(nothing).collect() == []


def test_many_blocks(spark):
    rows = [(i, f"banana {'na' * (i % 5)} x{i % 9}", "s") for i in range(70)]
    close([tuple(r)[:7] for r in scoring.score(frame(spark, rows).repartition(3), block_bytes=64).collect()], brute(rows))


def test_no_training_rows(spark):
    held = next(i for i in range(100) if not trained(i))
    close([tuple(r)[:7] for r in scoring.score(frame(spark, [(held, "a b", "s")])).collect()], brute([(held, "a b", "s")]))


def test_grams():
    data = np.frombuffer(b"\0\0abcabca", np.uint8)
    ids, codes = scoring.gram_ids(data, 2)
    want = [int.from_bytes(bytes((data[i - 1], data[i - 2], data[i])), "big") for i in range(2, len(data))]
    assert codes[ids].tolist() == want
    assert codes.tolist() == sorted(set(want))


def test_grams_without_a_table(monkeypatch):
    data = np.random.default_rng(1).integers(97, 105, 400).astype(np.uint8)
    ids, codes = scoring.gram_ids(data, 3)
    monkeypatch.setattr(scoring, "DIRECT", 0)
    again = scoring.gram_ids(data, 3)
    assert ids.tolist() == again[0].tolist() and codes.tolist() == again[1].tolist()


def rows_of(codes, grams, rows):
    return sorted(zip(codes[grams].tolist(), rows.tolist()))


def test_blocks_number_grams_by_one_sort(monkeypatch):
    """No tables of all possible grams: a block's places are sorted with their rows."""
    texts = [b"Banana  bandana", b"", b"na\tna\xc3\xa9", b"banana bandana"] * 40
    want = Counter()
    for r, t in enumerate(texts):
        s = b"\0" * scoring.DEPTH + b" ".join(t.lower().split()) + b"\n"
        want.update((int.from_bytes(s[i - scoring.DEPTH : i][::-1] + s[i : i + 1], "big"), r) for i in range(scoring.DEPTH, len(s)))
    monkeypatch.setattr(scoring, "gram_ids", None)
    monkeypatch.setattr(scoring, "CHUNK", 50, raising=False)
    parsed = scoring.Parsed(texts, 5)
    assert rows_of(parsed.codes, parsed.gram_of, parsed.row_of) == sorted(want.elements())
    assert len(set(parsed.codes.tolist())) == len(parsed.codes) == len({c for c, _ in want})


def test_sorted_grams_of_any_depth_and_beyond_64_bits(monkeypatch):
    asked, plain = [], scoring.gram_ids
    monkeypatch.setattr(scoring, "gram_ids", lambda *a: asked.append(a) or plain(*a))
    few = np.random.default_rng(2).integers(97, 105, 3000).astype(np.uint8)
    every_pair = np.arange(1 << 16, dtype=">u2").view(np.uint8)
    for data, depths in ((few, (1, 2, 5, 6)), (every_pair, (6,))):
        for depth in depths:
            n = len(data) - depth
            inside = np.arange(n) % 5 > 0
            rows = (np.arange(n) // 3)[inside].astype(np.uint32)
            codes, grams, found = scoring.sorted_grams(data, inside, rows, depth)
            ids, every = plain(data, depth)
            assert codes.tolist() == np.unique(every[ids[inside]]).tolist()
            assert rows_of(codes, grams, found) == rows_of(every, ids[inside], rows)
            assert bool(asked) == (data is every_pair)


def test_names_of_words_do_not_hang_on_how_many_are_named_at_once(monkeypatch):
    every = [b"w" * (i % 7) + str(i).encode() for i in range(50)]
    whole = scoring.B.word_hashes(every, 11).tolist()
    monkeypatch.setattr(scoring.B, "HASHED", 3, raising=False)
    assert scoring.B.word_hashes(every, 11).tolist() == whole


def test_packing():
    for numbers in ([], [5], [0, 3, 3, 1 << 62], [7, 1, (1 << 64) - 1]):
        x = np.array(numbers, np.uint64)
        assert scoring.opened(scoring.packed(x)).tolist() == numbers
        x.sort()
        assert scoring.opened_steps(scoring.packed_steps(x)).tolist() == x.tolist()


def test_held_out_texts_cost_less_than_with_single_words(spark):
    """Words that recur in a fixed order: contexts tell more than counts."""
    parts = ["the quiet river runs", "under the old stone bridge", "while seven grey herons", "wait for the morning train"]
    rows = [(i, " ".join(parts[(i * k + k * k) % 4] for k in range(1, 30)), "s") for i in range(120)]
    held = [r for r in scoring.score(frame(spark, rows)).collect() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
