"""Blocks of documents that ask a table of all keys of the corpus and get answers by position.

A corpus has far more keys (words, windows, contexts) than may be broadcast or joined row by row. So
documents are dealt into blocks of bounded size by a hash. A block asks for each of its different keys
once: one row for each bucket of keys, holding the sorted keys as bytes. A bucket meets the requests
of all blocks, works out one value for each key, and answers each block with the values alone, in the
order of its keys. The block, dealt in the same way again, finds the same keys and reads the
answers by position. A frequent key costs one entry for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.llm.common import text_bytes

#: Bytes of text in a block, and of keys that a bucket gets from the blocks, as a rule.
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 16 << 20
#: Words that are named at once, few enough for a processor's cache.
HASHED = 1 << 14
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(seed) * _GOLD + _GOLD).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def joined(words: list[bytes], end: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words, each followed by ``end``, and where each starts."""
    data = np.frombuffer(end.join(words) + end if words else b"", np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return data, np.concatenate(([0], np.cumsum(lengths)))[:-1]


def word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    """A 64-bit name of each word: a sum of its bytes times numbers that hang on the place, scrambled."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) > HASHED:
        return np.concatenate([word_hashes(words[i : i + HASHED], seed) for i in range(0, len(words), HASHED)])
    data, starts = joined(words, b" ")
    lengths = np.diff(np.concatenate((starts, [len(data)])))
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lengths)
    table = mixed(np.arange(int(lengths.max()), dtype=np.uint64), seed) | np.uint64(1)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(mixed(np.arange(256, dtype=np.uint64), seed + 1)[data] * table[place], starts)
        return mixed(sums + lengths.astype(np.uint64), seed + 2)


def count_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """As many blocks as their size asks for, but one for each shuffle partition at least."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_bytes()))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))


def dealt(docs: DataFrame, blocks: int, *more: Column) -> DataFrame:
    """block, doc_id, text (bytes) and further columns of every row. Rows that agree in both share a block."""
    block = F.pmod(F.xxhash64(col("doc_id").cast("long"), col("text").cast("string")), F.lit(blocks)).cast("int")
    return docs.select(block.alias("block"), col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), *more)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where in sorted 64-bit ``keys`` each bucket, an equal range of all numbers, starts and the last ends."""
    cuts = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, cuts, side="left"), [len(keys)]))


def requests(keys: np.ndarray, extra: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, keys, extra) of a block's sorted keys; ``extra`` has one entry for each key."""
    edges = bucket_edges(keys, buckets)
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, keys[edges[b] : edges[b + 1]].tobytes(), extra[edges[b] : edges[b + 1]].tobytes()


def unpacked(table: pa.Table, column: str, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in table[column].to_pylist()]


def answers(table: pa.Table, extras: dict[int, np.ndarray]) -> np.ndarray:
    """The answers of a block, in the order of its sorted keys; ``extras`` by bucket."""
    return np.concatenate([extras[b] for b in sorted(extras)]) if extras else np.zeros(0)


def summed(keys: list[np.ndarray], extras: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of many sorted lists and the sums of their entries."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[first], np.add.reduceat(np.concatenate(extras)[order], first)
