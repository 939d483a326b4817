import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from millrace.llm import repair

from .conftest import CLASH, as_bag

SCHEMA = "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` int" for c in [*CLASH, "lost", "h1", "low", "again", "copy"])
WIDTH = len(CLASH) + 5


def table(spark, rows):
    return spark.createDataFrame([(*r, *range(WIDTH)) for r in rows], SCHEMA)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain(rows, marks):
    """(cost, audit) by tuples from the last row to the first."""
    turn = {0: "u", 1: "u", 2: "a", 3: "u"}
    after = {"s": 1, "u": 2, "a": 3}

    def allowed(state, initial):
        return initial == turn[state] or (state == 0 and initial == "s")

    best = {s: min(x for x in ((0, "") if s in (0, 3) else None, (3, "I") if s == 2 else None, (6, "II") if s == 1 else None) if x) for s in range(4)}
    for (_, _, role, _), mark in zip(reversed(rows), reversed(marks)):
        extra = 3 if mark == "truncated" else 0

        def steps(s):
            yield 4 + best[s][0], "D" + best[s][1]
            if mark not in ("blank", "duplicate"):
                n = after[turn[s]]
                yield 3 + extra + best[n][0], "R" + best[n][1]
                if allowed(s, role[:1]):
                    k = after[role[:1]]
                    yield extra + best[k][0], "K" + best[k][1]

        here = {s: min(steps(s)) for s in range(4)}
        for _ in range(3):
            here = {s: min(here[s], (3 + here[after[turn[s]]][0], "I" + here[after[turn[s]]][1])) for s in range(4)}
        best = here
    return best[0]


def every(rows, marks):
    """(cost, audit) by trying all edits with at most two insertions at a place."""
    options = []
    for (_, _, role, _), mark in zip(rows, marks):
        extra = 3 if mark == "truncated" else 0
        options.append([("D", 4, "")] + ([] if mark in ("blank", "duplicate") else [("K", extra, role[:1] or "?"), ("R", 3 + extra, "u"), ("R", 3 + extra, "a")]))
    gaps = [("", 0, ""), ("I", 3, "u"), ("I", 3, "a"), ("II", 6, "ua"), ("II", 6, "au")]
    found = []
    for edits in product(*options):
        for put in product(gaps, repeat=len(rows) + 1):
            line = [x for pair in zip(put, edits) for x in pair] + [put[-1]]
            if re.fullmatch("(s?(ua)+)?", "".join(x[2] for x in line)):
                found.append((sum(x[1] for x in line), "".join(x[0] for x in line)))
    return min(found)


def repaired(rows, audit):
    out, state, at = [], 0, 0
    for c in audit:
        row = rows[at] if c != "I" else None
        at += c != "I"
        if c == "D":
            continue
        if c == "K":
            role, text = row[2:]
        else:
            role, text = ("assistant" if state == 2 else "user"), (row[3] if row else "")
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
        out.append(f"{role}:{text}")
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute(rows):
    out, by = [], {}
    for r in rows:
        by.setdefault(r[0], [])
    for r in damage(rows):
        by[r[0]].append(r)
    for conv, some in by.items():
        some.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        marks = faults(some)
        turns = {r[1] for r in some if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
        cost, audit = plain(some, marks)
        out.append((conv, gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, repaired(some, audit)))
    return sorted(out, key=repr)


def conversations(seed, n, longest, roles=("user", "assistant", "system", "user", "assistant", "tool", "", None)):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "so so", "a b.", "long text. cut", " \n", "", None, "é done.", "x. ", "Yes."]
    rows = []
    for conv in [None, *range(n)]:
        for i in range(r.randint(1, longest)):
            turn = r.choice((i, i, i, i, i + 1, i + 7, None, 0))
            rows.append((conv, turn, r.choice(roles) if r.random() < 0.5 else ("user", "assistant")[i % 2], r.choice(texts) if r.random() < 0.5 else f"turn {i} said."))
    return rows


def test_plain_equals_every_edit():
    for seed in range(60):
        rows = [r for r in conversations(seed, 1, 4) if r[0] == 0][:3]
        rows = [(c, t, role or " ", text or " ") for c, t, role, text in rows]
        assert plain(rows, faults(rows)) == every(rows, faults(rows))


def test_against_plain(spark):
    rows = conversations(1, 120, 9)
    rows += [(500, t, "assistant", "Yes.") for t in (None, 3, 3, 9)] + [(501, None, "user", "Hi.")] * 3
    got = as_bag(repair.repair(repair.damaged(table(spark, rows).repartition(4))))
    assert got == brute(rows)


def test_conversation_without_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = as_bag(repair.repair(repair.damaged(table(spark, [(gone, 0, "user", "Hi.")]))))
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("width", [4, 8, 64])
def test_integers_are_cut_where_all_paths_agree(width):
    """Thousands of rows, with few digits that are shifted or doubled as needed."""
    for seed in range(6):
        r = random.Random(seed)
        kinds = [(r.choice("uuuaaas t"), r.random() < 0.3, r.random() < 0.2) for _ in range(1500)]
        told = []
        paths = repair.Paths(told.append, width)
        for initial, cut, gone in kinds:
            paths.row(initial, cut and not gone, gone)
        cost = paths.end()
        rows = [(0, 0, initial, "") for initial, _, _ in kinds]
        marks = ["blank" if gone else "truncated" if cut else None for _, cut, gone in kinds]
        want = plain(rows, marks)
        assert (cost, "".join(told)) == want


def test_paths_that_never_agree():
    """Only assistants: rerole and insert differ all along, so the digits grow or the cheaper wins."""
    for initials in ("a" * 300, "u" * 300, "s" * 50 + "a" * 200):
        told = []
        paths = repair.Paths(told.append, 4)
        for c in initials:
            paths.row(c, False, False)
        assert (paths.end(), "".join(told)) == plain([(0, 0, c, "") for c in initials], [None] * len(initials))


def test_long_texts_and_long_conversations(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"{i} " + "word " * 40_000 + ".") for i in range(30)]
    rows += [(2, i // 2, "assistant" if i % 5 else "user", f"turn {i % 700}") for i in range(3000)]
    assert as_bag(repair.repair(repair.damaged(table(spark, rows)))) == brute(rows)


def test_empty_table(spark):
    assert repair.repair(repair.damaged(table(spark, []))).collect() == []
