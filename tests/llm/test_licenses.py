import math

from millrace.llm import licenses

from .brute import alnum, lower
from .conftest import as_bag, frame

LINES = [
    "Licensed under the Apache License, Version 2.0.",
    "Released under the MIT license and the APACHE-LICENSE; cc by, CC BY!",
    "permission is hereby granted, free of charge, to any person obtaining a copy of the software",
    "Version 2.0: licensed under an Apache License",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "gnu general public", "apache licenses", "xapache license", "mit licensé", "cc by\ncc by", "",
]


def rows_of(odd_rows):
    long = " ".join(["word"] * 150 + ["Redistribution and use in source and binary forms with or without modification are permitted provided that"] + ["more"] * 90)
    return [*odd_rows, *((300 + i, f"{t}\nplain line {i}", "s") for i, t in enumerate(LINES)), (400, long, "s"), (401, "\r\n".join(LINES), "s"), (401, "\r\n".join(LINES), "s")]


def blocks(text):
    wide = 2 * max(len(alnum(t)) for _, t in licenses.TEMPLATES)
    for line in lower(text).replace("\r", "\n").split("\n"):
        w = alnum(line)
        for start in range(0, math.ceil(max(len(w) - wide, 0) / (wide // 2)) * (wide // 2) + 1, wide // 2):
            yield set(w[start : start + wide])


def brute(rows):
    out = []
    for doc, text, *_ in rows:
        w = alnum(text)
        places, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += found
            base |= {label} if found else set()
        labels, most = set(base), 0.0
        for label, template in licenses.TEMPLATES:
            t = set(alnum(template))
            for b in blocks(text or ""):
                if len(b & t) >= math.ceil(licenses.THRESHOLD * len(t) - 1e-9):
                    labels.add(label)
                    most = max(most, len(b & t) / len(t))
        score = 1.0 if places else most
        out.append((doc, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    return sorted(out, key=repr)


def test_against_all_pairs(spark, odd_rows):
    rows = rows_of(odd_rows)
    want = brute(rows)
    assert as_bag(licenses.scan(frame(spark, rows).repartition(3))) == want
    assert {"gpl", "mit", "bsd", "cc-by-nc"} <= {x for r in want for x in r[6].split(",")}


def test_empty_table_and_no_templates(spark, nothing, odd, odd_rows):
    assert licenses.scan(nothing).collect() == []
    assert licenses.scan(odd, templates=()).count() == len(odd_rows)


def test_no_python_in_the_plan(odd):
    plan = licenses.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


WRAPPED = {
    "mit": "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files",
    "bsd": " * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted provided that the following conditions are met:",
    "lgpl": "This library is free software: you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published",
}


def test_wrapped_notices(spark):
    rows = [(i, f"{'some words before ' * 20 * (i % 3)}\n{t}\n{'and after ' * 30}", "s") for i, t in enumerate(WRAPPED.values())]
    rows += [(10 + i, " ".join(alnum(t)), "s") for i, t in enumerate(WRAPPED.values())]  # the same on one line
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(frame(spark, rows)).collect()}
    assert all(label in got[i][0].split(",") and got[i] == got[10 + i] and got[i][1] == 1.0 for i, label in enumerate(WRAPPED))


def test_windows_at_every_start(spark):
    """A notice with as many other words between as it has itself, at every place of a long line; one more is too many."""
    label, notice = licenses.TEMPLATES[6]
    words = alnum(notice)
    loose = " x ".join(words)
    rows = [(i, "y " * i + loose + " z" * 90, "s") for i in range(0, 60, 7)]
    rows.append((99, " x ".join([*words[:7], *["x"] * len(words), *words[7:]]), "s"))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {r[0]: (label, 1.0) if r[0] < 99 else ("", 0.0) for r in rows}
