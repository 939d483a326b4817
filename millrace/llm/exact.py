"""Exact deduplication by Grace hashing (operator 2).

Texts are equal when they agree after all blanks are deleted. Records are dealt
into buckets by the leading bits of their content hash; Spark's shuffle files
are the spill files. A bucket whose measured bytes exceed ``BUCKET_BYTES`` is
dealt again by the next bits, and so on, so that each bucket fits the table of
one task. The table is a ``dict`` from whole normalised texts (CPython's dict
is an open-addressing table that compares complete keys). Map tasks run the
same table first, so copies meet as one record for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.llm.common import BLANKS, fresh, steps, text_bytes

#: Bytes of text that a bucket may hold, and a map task's table before it is handed on.
BUCKET_BYTES = 64 << 20
#: Hash bits that one round of partitioning looks at, and the rounds at most (copies of one text never part).
ROUND_BITS, ROUNDS = 8, 6

_RECORD = pa.schema(
    [("leaf", pa.int64()), ("text_sha256", pa.string()), ("body", pa.binary()), ("n", pa.int64()), ("best_chars", pa.int64()), ("best_id", pa.int64())]
)
_CLASS = "text_sha256 string, n long, best_chars long, best_id long"


def content_hash(name: str = "text") -> Column:
    """SHA-256 (hex) of a text without its blanks; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(col(name).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", ""), 256)


def _prefix(bits: int) -> Column:
    """The leading ``bits`` bits of the hash."""
    return F.shiftrightunsigned(F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long"), 60 - bits)


def _better(a: tuple, b: tuple) -> tuple:
    """Of (characters, id): more characters, then the smaller id, an id before none."""
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    return a if key(a) <= key(b) else b


class _Table:
    """Complete contents and what is known of each."""

    def __init__(self):
        self.slots: dict[bytes, list] = {}
        self.bytes = 0

    def add(self, body: bytes, n: int, chars: int, doc_id: int | None) -> None:
        found = self.slots.get(body)
        if found is None:
            self.slots[body] = [n, (chars, doc_id)]
            self.bytes += len(body) + 200
        else:
            found[0] += n
            found[1] = _better(found[1], (chars, doc_id))


def _hand_on(table: _Table) -> Iterator[pa.RecordBatch]:
    """The records of a map task's table, a few megabytes at a time."""
    rows, size = [], 0
    for body, (n, (chars, doc_id)) in table.slots.items():
        rows.append((0, hashlib.sha256(body).hexdigest(), body, n, chars, doc_id))
        size += len(body)
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _RECORD)], schema=_RECORD)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _RECORD)], schema=_RECORD)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _Table()
    for batch in steps(batches):
        for body, chars, doc_id in zip(batch["text"].to_pylist(), batch["chars"].to_pylist(), batch["doc_id"].to_pylist()):
            table.add(body.translate(None, BLANKS), 1, chars, doc_id)
        if table.bytes > BUCKET_BYTES:
            yield from _hand_on(table)
            table = _Table()
    yield from _hand_on(table)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record for each content of the buckets of a task, which come one after the other."""
    schema = pa.schema([f for f in _RECORD if f.name not in ("leaf", "body")])

    def close(table):
        seen: dict[str, bytes] = {}
        rows = []
        for body, (n, (chars, doc_id)) in table.slots.items():
            sha = hashlib.sha256(body).hexdigest()
            if seen.setdefault(sha, body) != body:
                raise ValueError(f"two texts share the hash {sha}")
            rows.append((sha, n, chars, doc_id))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    table, leaf = _Table(), None
    for batch in steps(batches, "body"):
        for at, body, n, chars, doc_id in zip(*(batch[c].to_pylist() for c in ("leaf", "body", "n", "best_chars", "best_id"))):
            if at != leaf:
                if table.slots:
                    yield close(table)
                table, leaf = _Table(), at
            table.add(body, n, chars, doc_id)
    if table.slots:
        yield close(table)


def buckets(hashed: DataFrame, limit: int = BUCKET_BYTES) -> tuple[int, list[list[int]]]:
    """The bits of the first partitioning, and for each later round the buckets that it deals again.

    ``hashed`` has text_sha256 and bytes. Only sizes of buckets reach the driver: 256 in a
    round, and 256 for each bucket that is still too large and holds more than one text.
    """
    total = hashed.agg(F.sum("bytes")).first()[0] or 0
    first = max(1, (2 * total // limit).bit_length())
    again: list[list[int]] = []
    bits = first
    inside = hashed
    for _ in range(ROUNDS):
        sizes = inside.groupBy(_prefix(bits).alias("bucket")).agg(
            F.sum("bytes").alias("bytes"), F.min("text_sha256").alias("low"), F.max("text_sha256").alias("high")
        )
        large = sorted(r["bucket"] for r in sizes.where((F.col("bytes") > limit) & (F.col("low") != F.col("high"))).collect())
        if not large or bits + ROUND_BITS > 60:
            break
        again.append(large)
        inside = inside.where(_prefix(bits).isin(large))
        bits += ROUND_BITS
    return first, again


def _leaf(first: int, again: list[list[int]]) -> Column:
    """The bucket of a record, tagged with the bits that it was dealt by."""
    tag = lambda bits: F.shiftleft(_prefix(bits), 6).bitwiseOR(F.lit(bits))
    out = tag(first + ROUND_BITS * len(again))
    for i in reversed(range(len(again))):
        bits = first + ROUND_BITS * i
        out = F.when(_prefix(bits).isin(again[i]), out).otherwise(tag(bits))
    return out


def classes(docs: DataFrame, limit: int = BUCKET_BYTES) -> DataFrame:
    """One row for each different text: text_sha256, n, best_chars and best_id of the row that stays."""
    base = docs.select(
        col("doc_id").cast("long").alias("doc_id"),
        F.char_length(F.coalesce(col("text").cast("string"), F.lit(""))).cast("long").alias("chars"),
        text_bytes().alias("text"),
    )
    # Copies collapse to a record for each map task, so a bucket is measured by its different texts and ids.
    hashed = docs.select(content_hash().alias("text_sha256"), F.octet_length(text_bytes()).alias("bytes"))
    hashed = hashed.groupBy("text_sha256").agg(F.max("bytes").alias("bytes"))
    first, again = buckets(hashed, limit)
    records = base.mapInArrow(_collapse, _ddl(_RECORD)).withColumn("leaf", _leaf(first, again))
    dealt = records.repartition(F.col("leaf")).sortWithinPartitions("leaf")
    return dealt.mapInArrow(_settle, _CLASS)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def groups(docs: DataFrame, limit: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    The row with the most code points stays, then the one with the smallest id; rows
    without an id come last. Of rows that agree in id and text one is kept. Null texts
    count as empty; an empty table gives no rows. Other columns are not read.
    """
    members = docs.select(
        col("doc_id").cast("long").alias("doc_id"),
        F.char_length(F.coalesce(col("text").cast("string"), F.lit(""))).cast("long").alias("chars"),
        content_hash().alias("text_sha256"),
    )
    members = members.groupBy("doc_id", "chars", "text_sha256").count()
    best = (F.col("chars") == F.col("best_chars")) & F.col("doc_id").eqNullSafe(F.col("best_id"))
    rows = members.join(classes(docs, limit), "text_sha256").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
    return rows.select(
        "doc_id",
        F.col("best_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (best & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, limit: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that agree in id and text one."""
    sha, key, same = fresh(docs, "content_sha256", "kept_id", "kept_sha256")
    winners = groups(docs, limit).where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(same))
    rows = docs.withColumn(sha, content_hash())
    kept = rows.join(winners, (F.col(sha) == F.col(same)) & col("doc_id").cast("long").eqNullSafe(F.col(key)))
    return kept.dropDuplicates([key, same]).select(*(col(c) for c in docs.columns))
