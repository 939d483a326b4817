"""License scans by an exact set-similarity join (operator 10). DataFrame functions only.

A text block (a line, cut into overlapping windows if long) and a template are sets of words. So is
every window of twice a template's words in the word sequence of the whole text, across line breaks. A
block carries a license when it holds at least ``THRESHOLD`` of a template's words. Words are ordered
by their number of lines in the whole table, rarest first. Of a template only the first |T| - need + 1
words are indexed (prefix filter); a block needs at least ``need`` words (length filter), and behind the
first common word both must have enough left (positional filter). What passes is checked exactly. A
window holds an indexed word too, so only the windows around such words are tried, at every start.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col

THRESHOLD = 0.9

#: The phrases that count as they stand, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Short standard notices of common licenses.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "released under CC0 1.0 Universal"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def _normal(text: Column) -> Column:
    """Words with one blank before and after each; a lone blank without words."""
    # lower() is the same as A-Z alone only for texts in ASCII.
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _blanks(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _text() -> Column:
    return F.coalesce(col("text").cast("string"), F.lit(""))


def _table(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few constant rows, as literals of the plan."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [x.split()[1] for x in schema.split(", ")]
    lit = lambda v, kind: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v).cast(kind)
    structs = [F.struct(*(lit(v, k).alias(n) for v, k, n in zip(r, kinds, names))) for r in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def _key() -> Column:
    """Rows that agree in id and text have the same licenses."""
    return F.md5(F.concat(F.coalesce(col("doc_id").cast("string"), F.lit("-")), F.lit(" "), _text()).cast("binary"))


def find(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """row_key, line, start (word of the line that the block starts with), template, label, containment of every match.

    Lines end at a line break; in a line longer than two of the longest templates, blocks of that
    length start at every half. Windows of the whole text have no line, and start counts the words of the
    text; around an indexed word the first of the best windows stands for all. Null and empty texts have no words. Templates are a list of the
    caller's; they travel in the plan.
    """
    spark = docs.sparkSession
    sets = [sorted(set(_words(text))) for _, text in templates]
    vocabulary = sorted(set().union(*sets)) if sets else []
    wide = 2 * max([1, *(len(_words(text)) for _, text in templates)])
    lines = docs.select(col("doc_id").alias("doc_id"), _text().alias("text")).select("doc_id", "text", F.posexplode(F.split("text", r"[\r\n]+")).alias("line", "body"))
    lines = lines.withColumn("words", F.split(F.trim(_normal(F.col("body"))), " "))
    known = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    counted = lines.select(F.explode(F.array_intersect("words", known)).alias("word")).groupBy("word").count()
    often = {r["word"]: r["count"] for r in counted.collect()}  # one row for a word of the templates
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    index, first = [], set()
    for number, ((label, _), words) in enumerate(zip(templates, sets)):
        ranked = sorted(words, key=order.get)
        need = max(1, math.ceil(threshold * len(ranked) - 1e-9))
        for place, word in enumerate(ranked[: len(ranked) - need + 1]):
            index.append((word, number, label, len(ranked), need, place, ranked, 2 * len(_words(templates[number][1]))))
            first.add(word)
    schema = "word string, template int, label string, size int, need int, place int, ranked array<string>, span int"
    if not index:
        return lines.where("false").select(F.lit("").alias("row_key"), "line", F.lit(0).alias("start"), F.lit(0).alias("template"), F.lit("").alias("label"), F.lit(0.0).alias("containment"))
    hit = lines.where(F.arrays_overlap("words", F.array(*map(F.lit, sorted(first))))).select(_key().alias("row_key"), "line", "words")
    starts = F.sequence(F.lit(0), (F.ceil(F.greatest(F.size("words") - wide, F.lit(0)) / (wide // 2)) * (wide // 2)).cast("int"), F.lit(wide // 2))
    blocks = hit.withColumn("start", F.explode(starts)).withColumn("block", F.array_distinct(F.slice("words", F.col("start") + 1, wide)))
    rank = F.create_map(*(x for w, i in order.items() for x in (F.lit(w), F.lit(i))))
    # The block's words that templates know, rarest first; no other word can be common.
    blocks = blocks.withColumn("ours", F.transform(F.array_sort(F.transform(F.array_intersect("block", known), lambda w: F.struct(rank[w].alias("r"), w.alias("w")))), lambda x: x["w"]))
    blocks = blocks.withColumn("length", F.size("block")).select("row_key", "line", "start", "length", "ours", F.posexplode("ours").alias("at", "word"))
    near = blocks.join(F.broadcast(_table(spark, index, schema)), "word").where(
        (F.col("length") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("place") - 1, F.size("ours") - F.col("at") - 1) >= F.col("need"))
    )
    common = F.size(F.array_intersect("ours", "ranked"))
    checked = near.where(common >= F.col("need")).select("row_key", "line", "start", "template", "label", (common / F.col("size")).alias("containment"))
    return checked.unionByName(_across(docs, index, schema, sorted(first), wide)).distinct()


def _across(docs: DataFrame, index: Sequence[tuple], schema: str, first: Sequence[str], wide: int) -> DataFrame:
    """What ``find`` returns for windows of the whole text: ``span`` words in a row, from any word on."""
    texts = docs.select(_key().alias("row_key"), F.split(F.trim(_normal(_text())), " ").alias("words"))
    known = F.array(*map(F.lit, first))
    texts = texts.where(F.arrays_overlap("words", known))
    # Each indexed word with the words that may share a window with it; begin is the first one's place.
    begin = lambda i: F.greatest(i - wide + 1, F.lit(0))
    around = F.transform(
        "words",
        lambda w, i: F.when(
            F.array_contains(known, w), F.struct(w.alias("word"), i.alias("at"), begin(i).alias("begin"), F.slice("words", begin(i) + 1, 2 * wide).alias("near"))
        ),
    )
    hits = texts.select("row_key", F.explode(F.array_compact(around)).alias("hit")).select("row_key", "hit.*")
    met = hits.join(F.broadcast(_table(docs.sparkSession, index, schema)), "word")
    low = F.greatest(F.col("at") - F.col("span") + 1, F.lit(0))
    met = met.withColumn("low", low).withColumn("near", F.slice("near", F.col("low") - F.col("begin") + 1, F.col("at") + F.col("span") - F.col("low")))
    met = met.where(F.size(F.array_intersect("near", "ranked")) >= F.col("need"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("near") - F.col("span"), F.lit(0)))
    tried = F.transform(starts, lambda s: F.struct(F.size(F.array_intersect(F.slice("near", s + 1, F.col("span")), F.col("ranked"))).alias("common"), (-s).alias("back")))
    best = met.withColumn("best", F.array_max(tried)).where(F.col("best.common") >= F.col("need"))
    return best.select(
        "row_key", F.lit(None).cast("int").alias("line"), (F.col("low") - F.col("best.back")).alias("start"), "template", "label",
        (F.col("best.common") / F.col("size")).alias("containment"),
    )


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    Phrases are found where their words stand one after the other; a phrase must not overlap itself.
    ``labels`` adds those of ``find``. score is 1 with a phrase, else the highest containment, else 0. Null
    and empty texts have no words, null places and empty labels; equal rows give equal rows.
    """
    base = docs.select(col("doc_id").cast("long").alias("doc_id"), _key().alias("row_key"), _normal(_text()).alias("normal"))
    base = base.withColumn("n_words", F.when(F.col("normal").isin(" ", "  "), F.lit(0)).otherwise(_blanks(F.col("normal")) - 1).cast("long"))
    n, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        parts = F.when(F.contains("normal", F.lit(f" {phrase} ")), F.split("normal", f"(?<= ){re.escape(phrase)}(?= )"))
        base = base.withColumn(f"parts_{len(n)}", parts)
        parts = F.col(f"parts_{len(n)}")
        n.append(F.coalesce(F.size(parts) - 1, F.lit(0)))
        firsts.append(_blanks(parts[0]) - 1)
        lasts.append(F.col("n_words") - (_blanks(F.element_at(parts, -1)) - 1) - len(phrase.split()))
        labels.append(F.when(parts.isNotNull(), F.lit(label)))
    pick = lambda f, xs: f(*xs) if len(xs) > 1 else xs[0]
    base = base.select(
        "doc_id", "row_key", "n_words",
        sum((F.when(F.isnotnull(f"parts_{i}"), x).otherwise(F.lit(0)) for i, x in enumerate(n)), F.lit(0)).cast("long").alias("n_base"),
        pick(F.least, firsts).alias("first_word"), pick(F.greatest, lasts).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
    )
    more = find(docs, templates, threshold).groupBy("row_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"))
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return base.join(more, "row_key", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )
