"""Benchmark decontamination with one Aho-Corasick automaton (operator 5).

Items are normalised to words; ten consecutive words are a window, a shorter item is
one window. The automaton holds all windows and reads each normalised text once. Hits
come back as spans of words and as offsets into the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.llm.common import ALNUM, alnum_words, steps, text_bytes
from millrace.session import checkpoint_folder

WINDOW = 10
#: Bytes of item text whose windows make one automaton; further items go to further automata, one scan each.
BLOCK_BYTES = 2 << 20

#: The same words in a text that is not yet in lower case.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_RESULT = (
    "n_words long, n_hit long, items array<string>, word_spans array<struct<first:long,last:long>>, "
    "char_spans array<struct<start:long,end:long>>"
)
_SPAN = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
_ADDED = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("word_spans", _SPAN("first", "last")), ("char_spans", _SPAN("start", "end"))]
_built: dict[str, ahocorasick.Automaton] = {}


def windows(items: list[tuple[str, bytes]]) -> dict[bytes, tuple[int, set[str]]]:
    """Window (words between blanks, with a blank at both ends) -> its number of words and its items."""
    out: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        words = alnum_words(text)
        for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
            window = words[i : i + WINDOW]
            out.setdefault(b" " + b" ".join(window) + b" ", (len(window), set()))[1].add(item)
    return out


def automaton(items: list[tuple[str, bytes]]) -> ahocorasick.Automaton:
    """Bytes are held as the characters of the same numbers."""
    out = ahocorasick.Automaton()
    for window, what in windows(items).items():
        out.add_word(window.decode("latin-1"), what)
    out.make_automaton()
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [tuple(x) for x in out]


def scan_text(machine: ahocorasick.Automaton, text: bytes, before: list[tuple[int, int]] = (), known: set[str] = frozenset()) -> tuple:
    """(words, words hit, items, word spans, spans of characters in the original) of one text."""
    words = text.translate(ALNUM).split()
    spans, items = list(before), set(known)
    if words and len(machine):
        joined = b" " + b" ".join(words) + b" "
        found = list(machine.iter(joined.decode("latin-1")))
        if found:
            blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            lasts = np.searchsorted(blanks, [end for end, _ in found]) - 1
            for last, (_, (n, ids)) in zip(lasts.tolist(), found):
                spans.append((last - n + 1, last))
                items |= ids
    spans = _merged(spans)
    places = []
    if spans:
        at = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))]
        places = [(at[a][0], at[b][1]) for a, b in spans]
    return len(words), sum(b - a + 1 for a, b in spans), sorted(items), spans, places


def _scanner(shared, number: str, names: list[str], text: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _built:
            _built.clear()
            _built[number] = automaton(shared.value)
        machine = _built[number]
        for batch in steps(batches, text):
            before = batch[names[3]].to_pylist() if names[3] in batch.schema.names else [()] * batch.num_rows
            known = batch[names[2]].to_pylist() if names[2] in batch.schema.names else [()] * batch.num_rows
            rows = [
                scan_text(machine, t, [(s["first"], s["last"]) for s in b], set(k)) for t, b, k in zip(batch[text].to_pylist(), before, known)
            ]
            keep = [i for i, n in enumerate(batch.schema.names) if n not in names]
            arrays = [batch.column(i) for i in keep]
            for i, (_, kind) in enumerate(_ADDED):
                values = [r[i] for r in rows]
                if i >= 3:
                    keys = kind.value_type.field(0).name, kind.value_type.field(1).name
                    values = [[dict(zip(keys, s)) for s in v] for v in values]
                arrays.append(pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(arrays, [batch.schema.names[i] for i in keep] + names)

    return scan


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items a partition at a time, in lists of about ``limit`` bytes."""
    rows = items.select(F.coalesce(col("item_id").cast("string"), F.lit("")).alias("item_id"), text_bytes().alias("text"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row["item_id"], bytes(row["text"])))
        size += len(row["text"])
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _hits(docs: DataFrame, items: DataFrame, keep: list[str], limit: int) -> DataFrame:
    """The columns ``keep`` as c0, c1 and so on, and what ``scan`` adds."""
    spark = docs.sparkSession
    names, text = [n for n, _ in _ADDED], "scanned_text"
    rows = docs.select(*(col(c).alias(f"c{i}") for i, c in enumerate(keep)), text_bytes().alias(text))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", " + _RESULT
    for number, block in enumerate(_blocks(items, limit)):
        rows = _written(rows) if number else rows
        rows = rows.mapInArrow(_scanner(spark.sparkContext.broadcast(block), uuid.uuid4().hex, names, text), schema)
    if names[0] not in rows.columns:  # no items at all
        rows = rows.mapInArrow(_scanner(spark.sparkContext.broadcast([]), uuid.uuid4().hex, names, text), schema)
    return rows.drop(text)


def scan(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, limit: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all if None) and, for each row, n_words, n_hit, items, word_spans and char_spans.

    Spans hold both ends of a run of hit words (words from 0, last included) and its characters in
    the original text (end not included). Items are the ids, as text, of items with windows that
    occur; an id that is null is the empty string, equal ids count once. Null texts, of items too,
    have no words. Beyond ``limit`` bytes of items the scan is repeated for each further block, and
    the rows are written to the shared folder in between, so that one automaton is held at a time.
    Columns of ``docs`` with the names of added ones are replaced.
    """
    added = [n for n, _ in _ADDED]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    return _hits(docs, items, kept, limit).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), *added)


def _written(rows: DataFrame) -> DataFrame:
    path = f"{checkpoint_folder(rows.sparkSession)}/scanned-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def digest() -> list[Column]:
    """n_words, n_hit, n_items, items_sha256 and contaminated from the columns of ``scan``."""
    return [
        F.col("n_words"),
        F.col("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    ]


def keep_clean(docs: DataFrame, items: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without a hit, with their columns."""
    found = _hits(docs, items, docs.columns, limit).where("n_hit = 0")
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
