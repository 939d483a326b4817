"""Helpers shared by the operators: bytes of texts, Arrow batches, names of scratch columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col

#: Bytes that part words in most contracts: blank, tab, line breaks.
BLANKS = b" \t\n\x0b\x0c\r"
#: A-Z to lower case and every other ASCII byte that is not a letter or digit to a blank; bytes of other scripts stay.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of text that one step of an Arrow function holds at once, unless a single text is longer.
STEP_BYTES = 8 << 20


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(col(name).cast("string").cast("binary"), F.lit(b""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``df`` does not have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts stay below ``limit`` bytes; a longer text comes alone."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(start, end - start)
            start, done = end, int(sizes[end - 1])


def lower_words(text: bytes) -> list[bytes]:
    """Words between blanks, with A-Z in lower case."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and bytes of other scripts, with A-Z in lower case."""
    return text.translate(ALNUM).split()
