"""Substring deduplication by recompression (operator 1).

Texts become sequences of symbols, words first. A round names runs of one symbol, or pairs of a left and a
right symbol (which is which hangs on the symbol alone), and puts the names in their place. Names are
the same function of their parts in every document, so equal substrings get equal symbols except near
their ends, and no round has to exchange names. A symbol's context is the range of words that decided it.
If a window holds a symbol's whole context, every equal window holds the same symbol.

Spark then counts the symbols of the last round over all documents (see ``blocks``). A window that holds
the whole context of a symbol that stands nowhere else cannot repeat. The windows that are left, few in
texts that do not repeat, are verified: their 128-bit names are counted over all documents. The pruning is
exact in itself; windows without any whole context are simply verified.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import blocks as B

WINDOW = 35
#: Rounds of pairs behind the round of runs: symbols of six words, contexts of half a window.
ROUNDS = 6
_OUT = -(1 << 40)
_ASKED = "block int, bucket int, keys binary, more binary, n binary"
_TOLD = "kind int, block int, bucket int, found binary"


class Symbols:
    """Names of symbols in order, the documents and words they span, and the words that decided them."""

    def __init__(self, names: np.ndarray, doc: np.ndarray):
        self.name, self.doc = names, doc
        at = np.arange(len(names), dtype=np.int64)
        self.first, self.low, self.high = at, at, at

    def _keep(self, kept, name, low, high):
        self.name, self.doc, self.first, self.low, self.high = name[kept], self.doc[kept], self.first[kept], low[kept], high[kept]

    def _neighbours(self):
        """The context before and behind each symbol; past the ends of its document it never ends."""
        same = self.doc[1:] == self.doc[:-1]
        before = np.concatenate(([_OUT], np.where(same, self.low[:-1], _OUT)))
        behind = np.concatenate((np.where(same, self.high[1:], -_OUT), [-_OUT]))
        return same, before, behind

    def runs(self, seed: int) -> None:
        """One symbol for each longest run; where it ends hangs on both neighbours."""
        if not len(self.name):
            return
        same, before, behind = self._neighbours()
        starts = np.concatenate(([True], ~(same & (self.name[1:] == self.name[:-1]))))
        first = np.flatnonzero(starts)
        last = np.concatenate((first[1:], [len(starts)])) - 1
        n = (last - first + 1).astype(np.uint64)
        name, low, high = self.name.copy(), self.low.copy(), self.high.copy()
        with np.errstate(over="ignore"):
            name[first] = np.where(n > 1, B.mixed(name[first] + B.mixed(n, seed), seed), name[first])
        low[first], high[first] = np.minimum(low[first], before[first]), np.maximum(high[last], behind[last])
        self._keep(first, name, low, high)

    def pairs(self, seed: int) -> None:
        """One symbol for each left one with a right one behind it. A symbol that stays alone hangs on the neighbour that could have joined it."""
        if not len(self.name):
            return
        same, before, behind = self._neighbours()
        right = (B.mixed(self.name, seed) >> np.uint64(40)) & np.uint64(1) == 1
        joins = np.concatenate((~right[:-1] & right[1:] & same, [False]))
        joined = np.concatenate(([False], joins[:-1]))
        low = np.where(right & ~joined, np.minimum(self.low, before), self.low)
        high = np.where(~right & ~joins, np.maximum(self.high, behind), self.high)
        i = np.flatnonzero(joins)
        name = self.name.copy()
        with np.errstate(over="ignore"):
            name[i] = B.mixed(B.mixed(name[i], seed) + np.uint64(3) * name[i + 1], seed + 1)
        high[i] = self.high[i + 1]
        self._keep(~joined, name, low, high)


class Parsed:
    """A block of texts: words, symbols of the last round with the different names, and where windows may start."""

    def __init__(self, texts: list[bytes], window: int):
        self.words = [t.split() for t in texts]
        self.window = window
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        every = [w for ws in self.words for w in ws]
        self.hashes = B.word_hashes(every, 101)
        self.every = every
        symbols = Symbols(self.hashes, np.repeat(np.arange(len(texts)), self.sizes))
        symbols.runs(200)
        for i in range(ROUNDS):
            symbols.pairs(300 + 10 * i)
        self.symbols = symbols
        self.names, self.name_of, counts = np.unique(symbols.name, return_inverse=True, return_counts=True)
        self.counts = np.minimum(counts, 2).astype(np.uint8)

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Starts of windows without the whole context of a symbol whose name is not shared."""
        s, n = self.symbols, len(self.every)
        alone = ~shared[self.name_of]
        low, high = s.low[alone], s.high[alone]
        inside = (low >= 0) & (high < n) & (high - low < self.window)
        low, high = low[inside], high[inside]
        ruled_out = np.zeros(n + 1, np.int64)
        np.add.at(ruled_out, np.maximum(high - self.window + 1, 0), 1)
        np.add.at(ruled_out, low + 1, -1)
        fits = np.zeros(n, bool)
        for a, size in zip(self.starts[:-1].tolist(), self.sizes.tolist()):
            if size >= self.window:
                fits[a : a + size - self.window + 1] = True
        return np.flatnonzero(fits & (np.cumsum(ruled_out)[:n] == 0))

    def windows(self, starts: np.ndarray):
        """The different 128-bit names of windows in order, as two halves, how often each starts (2 at most), and the name of each start."""
        second = B.word_hashes(self.every, 401)
        halves = []
        for hashes, seed in ((self.hashes, 501), (second, 601)):
            factors = B.mixed(np.arange(self.window, dtype=np.uint64), seed) | np.uint64(1)
            out = np.zeros(len(starts), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(self.window):
                    out += factors[k] * hashes[starts + k]
            halves.append(B.mixed(out, seed))
        return numbered(*halves)


def numbered(a: np.ndarray, b: np.ndarray):
    """Different pairs in order, counts up to 2, and the number of each entry's pair."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))[: len(x)]
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    counts = np.minimum(np.bincount(number, minlength=int(new.sum())), 2).astype(np.uint8)
    return x[new], y[new], counts, number


def _rows(block: int, buckets: int, keys: np.ndarray, more: np.ndarray | None, counts: np.ndarray) -> pa.Table:
    e = B.bucket_edges(keys, buckets)
    full = np.flatnonzero(np.diff(e)).tolist()
    cut = lambda x: [x[e[b] : e[b + 1]].tobytes() for b in full]
    return pa.table(
        {
            "block": pa.array([block] * len(full), pa.int32()),
            "bucket": pa.array(full, pa.int32()),
            "keys": pa.array(cut(keys), pa.binary()),
            "more": pa.array([None] * len(full) if more is None else cut(more), pa.binary()),
            "n": pa.array(cut(counts), pa.binary()),
        }
    )


def _flags(answers: pa.Table, kind: int) -> np.ndarray:
    rows = sorted((b, f) for k, b, f in zip(*(answers[c].to_pylist() for c in ("kind", "bucket", "found"))) if k == kind)
    return np.frombuffer(b"".join(f for _, f in rows), bool)


def _ask_names(buckets: int, window: int):
    def ask(table: pa.Table) -> pa.Table:
        parsed = Parsed(table["text"].to_pylist(), window)
        return _rows(table["block"][0].as_py(), buckets, parsed.names, None, parsed.counts)

    return ask


def _ask_windows(buckets: int, window: int):
    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows(0, buckets, np.zeros(0, np.uint64), None, np.zeros(0, np.uint8))
        parsed = Parsed(docs["text"].to_pylist(), window)
        a, b, counts, _ = parsed.windows(parsed.candidates(_flags(answers, 0)))
        return _rows(docs["block"][0].as_py(), buckets, a, b, counts)

    return ask


def _tell(kind: int):
    """For each request, whether its keys stand in two places or more of all documents."""

    def tell(table: pa.Table) -> pa.Table:
        keys, n = B.unpacked(table, "keys", "<u8"), B.unpacked(table, "n", "u1")
        more = B.unpacked(table, "more", "<u8") if kind else [np.zeros(len(k), np.uint64) for k in keys]
        _, _, _, number = numbered(np.concatenate(keys), np.concatenate(more))
        often = np.bincount(number, weights=np.concatenate(n)) >= 2
        edges = np.cumsum([0, *map(len, keys)])
        found = [often[number[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:])]
        return pa.table({"kind": pa.array([kind] * len(keys), pa.int32()), "block": table["block"], "bucket": table["bucket"], "found": pa.array(found, pa.binary())})

    return tell


def _remove(window: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]
    )

    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        parsed = Parsed(docs["text"].to_pylist(), window)
        starts = parsed.candidates(_flags(answers, 0))
        _, _, _, number = parsed.windows(starts)
        starts = starts[_flags(answers, 1)[number]]
        cover = np.zeros(len(parsed.every) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        rows = []
        for i, words in enumerate(parsed.words):
            here = gone[parsed.starts[i] : parsed.starts[i + 1]]
            spans, kept = [], words
            if here.any():
                edges = np.flatnonzero(np.diff(np.concatenate(([0], here.astype(np.int8), [0])))).reshape(-1, 2)
                spans = [{"first": int(a), "last": int(b) - 1} for a, b in edges]
                kept = [w for w, g in zip(words, here.tolist()) if not g]
            rows.append((len(words), int(here.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), spans))
        return pa.table([docs["doc_id"], *(pa.array(x, f.type) for x, f in zip(zip(*rows), list(schema)[1:]))], schema=schema)

    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed (spans of words, last included) of every row.

    A word goes if a window of ``window`` consecutive words of its document covers it whose words also start
    anywhere else, in the same document too. Windows are judged on the input, so of equal texts with a
    window none keeps a word. kept_sha256 is that of the kept words with a blank between. Null and shorter
    texts keep all; equal rows are copies of one another. An empty table gives no rows. A task holds one
    block of documents, or one text if that is longer.
    """
    n = B.count_blocks(docs, block_bytes)
    dealt = B.dealt(docs, n)
    asked = dealt.groupBy("block").applyInArrow(_ask_names(n, window), _ASKED)
    names = asked.groupBy("bucket").applyInArrow(_tell(0), _TOLD)
    asked = dealt.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(_ask_windows(n, window), _ASKED)
    both = names.unionByName(asked.groupBy("bucket").applyInArrow(_tell(1), _TOLD))
    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(
        _remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<first:long,last:long>>"
    )
