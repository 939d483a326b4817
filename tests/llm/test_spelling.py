import random
import re
import zlib
from collections import Counter

from millrace.llm import spelling

from .brute import lower
from .conftest import as_bag, frame


def vocabulary(rows):
    count = Counter()
    for doc, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = vocabulary(rows)
    form, close = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        close[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], close[w], n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def corpus(seed=3):
    r = random.Random(seed)
    letters = "abcdeé"
    base = ["".join(r.choice(letters) for _ in range(r.randint(7, 13))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab", "ababababa"]
    words = []
    for w in base:
        words += [w] * r.choice((2, 30, 300))
        for _ in range(14):
            p = r.randrange(len(w))
            variant = r.choice((w[:p] + w[p + 1 :], w[:p] + r.choice(letters) + w[p:], w[:p] + r.choice(letters) + w[p + 1 :]))
            words += [variant] * r.choice((1, 2, 2, 3, 25))
    words += ["chainaaaa"] * 2 + ["chainaaab"] * 40 + ["chainaabb"] * 500
    r.shuffle(words)
    rows = [(i, r.choice((" ", "-", "\n", "3")).join(w.upper() if r.random() < 0.1 and "é" not in w else w for w in words[i * 40 : i * 40 + 40]), "s") for i in range(len(words) // 40 + 1)]
    return rows + [(None, "aaaaaaa aaaaaaab abababab", "s"), (5, None, "s"), (6, "", "s"), (7, " \n", None), (0, rows[0][1], "s"), (0, rows[0][1], "s")]


def test_against_all_pairs(spark):
    rows = corpus()
    want = brute(rows)
    assert as_bag(spelling.variants(frame(spark, rows).repartition(3))) == want
    assert any(r[1] and r[1] != r[2] for r in want), "a chain of two steps"


def test_ties_go_to_the_smallest(spark):
    text = " ".join(["zetazeta"] * 40 + ["betazeta"] * 40 + ["yetazeta"] * 2)
    rows = [(i, text, "s") for i in range(3)]
    got = {r[0]: r for r in as_bag(spelling.variants(frame(spark, rows), damage=0))}
    assert got["yetazeta"][1:3] == ("betazeta", "betazeta") and got["zetazeta"][1] is None and got["zetazeta"][4] == 2


def test_both_comparisons_agree(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 0)
    assert as_bag(spelling.variants(frame(spark, corpus(4)))) == brute(corpus(4))


def test_long_runs(spark):
    """One run of a hundred thousand letters, and one that differs in its last."""
    long = "abcdefghij" * 10_000
    rows = [(1, f"{long} {long} {long[:-1]}x {long[:-1]}x {long[:-1]} {long[:-1]}", "s")]
    got = {(len(r[0]), r[0][-1]): r[4] for r in as_bag(spelling.variants(frame(spark, rows), damage=0))}
    assert got == {(100_000, "j"): 2, (100_000, "x"): 2, (99_999, "i"): 2}


def test_edge_rows(odd, odd_rows, nothing):
    assert as_bag(spelling.variants(odd)) == brute(odd_rows)
    assert spelling.variants(nothing).collect() == []
