"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in BLANKS.split(text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows, window):
    seqs = [words(t) for _, t, *_ in rows]
    count = Counter(tuple(s[i : i + window]) for s in seqs for i in range(len(s) - window + 1))
    out = []
    for (doc, *_), s in zip(rows, seqs):
        gone = {k for i in range(len(s) - window + 1) if count[tuple(s[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((doc, len(s), len(gone), sha(" ".join(w for i, w in enumerate(s) if i not in gone))))
    return sorted(out, key=repr)


def exact_groups(rows):
    groups = {}
    for doc, t, *_ in rows:
        groups.setdefault(BLANKS.sub("", t or ""), []).append((-len(t or ""), doc is None, doc or 0, doc))
    out = []
    for body, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for i, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), i == 0, sha(body)))
    return sorted(out, key=repr)


def leaks(rows, items, window=10):
    wins = []
    for item, t in items:
        w = alnum(t)
        wins += [("" if item is None else str(item), w[i : i + window]) for i in range(max(1, len(w) - window + 1) if w else 0)]
    out = []
    for doc, t, *_ in rows:
        w = alnum(t)
        hit, ids = set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    ids.add(item)
        out.append((doc, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return sorted(out, key=repr)


def components(pairs, nodes):
    label = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] != low:
                    label[x], moved = low, True
    return label
