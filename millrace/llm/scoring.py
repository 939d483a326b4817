"""Language-model scores by context-tree weighting (operator 9).

A text is read as its lower-case words with a blank between them and an end behind the last. Each byte is
coded as eight binary choices; for each choice, a tree over the bytes before it mixes the
Krichevsky-Trofimov estimates of all depths from none to ``DEPTH`` bytes. Trees are trained on all
training rows. A gram is a byte with its context, the nearest byte of the context first. Grams are dealt over
buckets by the nearest ``TOP`` bytes, so that all nodes below that depth meet in one bucket, which has
at most 256 ** (DEPTH - TOP + 1) grams for each such context. Weighted probabilities go up from there by one
aggregate a depth, mixing weights come down by one join a depth. Documents ask for the code length of
each of their different grams by blocks (see ``blocks``), so the tree may grow with the corpus; requests
travel as packed steps between sorted grams.
"""

from __future__ import annotations

import math
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.llm import blocks as B
from millrace.llm.common import lower_words
from millrace.session import checkpoint_folder

DEPTH = 6
#: Depth from which on a bucket holds whole subtrees.
TOP = DEPTH - 2
#: Blocks of documents for each bucket of grams, and entries of a table that numbers grams directly.
BLOCKS_PER_BUCKET, DIRECT = 4, 48 << 20
#: Positions of a block whose grams are put together at once, few enough for a processor's cache.
CHUNK = 1 << 16
END = b"\n"
_REQUEST = "block int, bucket int, words binary, words_n binary, grams binary, grams_n binary"
_UNIFIED = "kind int, block int, bucket int, found binary, more binary, key long, n0 long, n1 long, weighted double, tokens long, known long"
_ANSWER = "kind int, block int, bucket int, found binary, tokens long, known long"


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again."""
    path = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers as compressed planes of their bytes, first all low ones."""
    numbers = numbers.astype(np.uint64)
    planes = np.zeros((8, len(numbers)), np.uint8)
    for k in range((int(numbers.max(initial=0)).bit_length() + 7) // 8):
        planes[k] = numbers >> np.uint64(8 * k)
    return zlib.compress(planes, 1)


def opened(data: bytes) -> np.ndarray:
    """The numbers of ``packed``."""
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    numbers = planes[0].astype(np.uint64)
    for k in np.flatnonzero(planes[1:].any(axis=1)).tolist():
        numbers |= planes[k + 1].astype(np.uint64) << np.uint64(8 * k + 8)
    return numbers


def packed_steps(ascending: np.ndarray) -> bytes:
    return packed(np.diff(ascending.astype(np.uint64), prepend=np.uint64(0)))


def opened_steps(data: bytes) -> np.ndarray:
    return np.cumsum(opened(data), dtype=np.uint64)


def gram_ids(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position from ``depth`` on the number of its gram, and the grams' codes in order.

    A code has the bytes before the position, the nearest one highest, and the byte itself lowest.
    """
    seen = np.zeros(256, bool)
    seen[data] = True
    letters = np.flatnonzero(seen)
    place = np.zeros(256, np.int32)
    place[letters] = np.arange(len(letters), dtype=np.int32)
    data = place[data]
    n = len(data) - depth
    ids, codes = np.zeros(n, np.int32), np.zeros(1, np.uint64)
    for back in (*range(1, depth + 1), 0):
        pairs = ids.astype(np.int64) * len(letters) + data[depth - back : depth - back + n]
        if len(codes) * len(letters) <= DIRECT:
            ids = np.zeros(len(codes) * len(letters), np.int32)
            ids[pairs] = 1
            kept = np.flatnonzero(ids)
            ids[kept] = np.arange(len(kept), dtype=np.int32)
            ids = ids[pairs]
        else:
            kept, ids = np.unique(pairs, return_inverse=True)
            ids = ids.astype(np.int32)
        codes = (codes[kept // len(letters)] << np.uint64(8)) | letters[kept % len(letters)].astype(np.uint64)
    return ids, codes


def sorted_grams(data: np.ndarray, inside: np.ndarray, rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grams' codes in order, and for each place that is ``inside`` the number of its gram and its row.

    ``inside`` tells of each position from ``depth`` on whether it counts, ``rows`` are the rows of those that do. Places
    come in order of gram and row: one sort of gram and row in a single number, with bytes numbered two by two. Where
    that number would need more than 64 bits, places come as in the data, by ``gram_ids``.
    """
    seen = np.zeros(256, bool)
    seen[data] = True
    letters = np.flatnonzero(seen).astype(np.uint64)
    letter = (np.cumsum(seen) - 1).astype(np.uint8)
    pair = (data[1:].astype(np.uint16) << 8) | data[:-1]
    seen = np.zeros(1 << 16, bool)
    seen[pair] = True
    pairs = np.flatnonzero(seen).astype(np.uint64)
    pair = (np.cumsum(seen) - 1).astype(np.uint16)[pair]
    n, row_bits = len(data) - depth, int(rows.max(initial=0)).bit_length()
    # What a gram is made of, highest first: numbers by place, how far their start is back, and their codes.
    parts = [(pair, back, pairs, 16) for back in range(2, depth + 1, 2)] + [(letter, depth, letters, 8)] * (depth % 2) + [(letter, 0, letters, 8)]
    if math.prod(len(codes) for *_, codes, _ in parts) << row_bits > 1 << 64:
        ids, codes = gram_ids(data, depth)
        ids = ids[inside]
        used = np.bincount(ids, minlength=len(codes)) > 0
        return codes[used], (np.cumsum(used, dtype=np.int32) - 1)[ids], rows
    places, at = np.empty(len(rows), np.uint64), 0
    for start in range(0, n, CHUNK):
        end = min(start + CHUNK, n)
        key = np.zeros(end - start, np.uint64)
        for number, back, codes, _ in parts:
            here = slice(depth - back + start, depth - back + end)
            key *= np.uint64(len(codes))
            key += number[here] if number is pair else letter[data[here]]
        key = key[inside[start:end]]
        places[at : at + len(key)] = (key << np.uint64(row_bits)) | rows[at : at + len(key)]
        at += len(key)
    places.sort()
    rows = (places & np.uint64((1 << row_bits) - 1)).astype(np.int32)
    places >>= np.uint64(row_bits)
    new = np.concatenate(([True], places[1:] != places[:-1]))[: len(places)]
    grams, found, low = places[new], np.uint64(0), 0
    for _, _, codes, bits in reversed(parts):
        grams, number = np.divmod(grams, np.uint64(len(codes)))
        found, low = found | (codes[number] << np.uint64(low)), low + bits
    return found, np.cumsum(new, dtype=np.int32) - 1, rows


def buckets_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each gram, by the nearest ``TOP`` bytes of its context."""
    return (B.mixed(codes >> np.uint64(8 * (DEPTH - TOP + 1))) % np.uint64(buckets)).astype(np.int64)


class Parsed:
    """Tokens and grams of a block of texts, with their different keys."""

    def __init__(self, texts: list[bytes], buckets: int):
        words = [lower_words(t) for t in texts]
        self.n_tokens = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        self.token_starts = np.concatenate(([0], np.cumsum(self.n_tokens)))[:-1]
        every = [w for ws in words for w in (*ws, END)]
        self.words, self.word_of = np.unique(B.word_hashes(every, 11), return_inverse=True)
        pad = b"\0" * DEPTH
        pieces = [b" ".join(ws) + END for ws in words]
        data = np.frombuffer(b"".join(x for p in pieces for x in (pad, p)), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        padded = np.concatenate(([0], np.cumsum(lengths + DEPTH)))[:-1]
        text = np.ones(len(data), bool)
        text[(padded[:, None] + np.arange(DEPTH)).ravel()] = False
        codes, gram, self.row_of = sorted_grams(data, text[DEPTH:], np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths), DEPTH)
        self.n_bytes = lengths
        # Grams are kept by bucket, in a bucket by code.
        bucket = buckets_of(codes, buckets)
        order = np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.codes, self.gram_edges = codes[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
        # By place, not in the order of the text: its gram and its row.
        self.gram_of = rank[gram]


def _ask(buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        parsed = Parsed(table["text"].to_pylist(), buckets)
        train = np.asarray(table["train"])
        words = np.bincount(parsed.word_of, weights=np.repeat(train, parsed.n_tokens), minlength=len(parsed.words)).astype(np.int64)
        grams = np.bincount(parsed.gram_of[train[parsed.row_of]], minlength=len(parsed.codes))
        we, ge = B.bucket_edges(parsed.words, buckets), parsed.gram_edges
        cut = lambda x, e, b: x[e[b] : e[b + 1]]
        rows = [(b, cut(parsed.words, we, b).tobytes(), cut(words, we, b).tobytes(), packed_steps(cut(parsed.codes, ge, b)), packed(cut(grams, ge, b))) for b in range(buckets)]
        out = {"block": pa.array([table["block"][0].as_py()] * buckets, pa.int32()), "bucket": pa.array([r[0] for r in rows], pa.int32())}
        return pa.table(out | {n: pa.array([r[i] for r in rows], pa.binary()) for i, n in enumerate(("words", "words_n", "grams", "grams_n"), 1)})

    return ask


def _log_gamma_of(x):
    """Stirling's series, eight steps up; for arrays and columns alike."""
    log = F.log if isinstance(x, Column) else np.log
    z = x + 8.0
    down = x
    for i in range(1, 8):
        down = down * (x + float(i))
    return (z - 0.5) * log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - log(down)


def kt_of(n0, n1):
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma_of(n0 + 0.5) + _log_gamma_of(n1 + 0.5) - _log_gamma_of(n0 + n1 + 1.0) - math.log(math.pi)


@dataclass
class Level:
    """Nodes of one depth and binary choice: one for each context and start of the byte's bits."""

    first: np.ndarray
    of_gram: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    weighted: np.ndarray
    stop: np.ndarray
    parent: np.ndarray | None

    @property
    def one(self) -> np.ndarray:
        return (self.n1 + 0.5) / (self.n0 + self.n1 + 1.0)


class Subtrees:
    """The nodes from depth ``TOP`` down of a bucket's sorted grams; ``n`` are their training counts."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        self.grams, self.n, self.up = {DEPTH: codes}, {DEPTH: n.astype(float)}, {}
        for d in reversed(range(TOP, DEPTH)):
            below = self.grams[d + 1]
            shorter = ((below >> np.uint64(16)) << np.uint64(8)) | (below & np.uint64(255))
            self.grams[d], self.up[d] = np.unique(shorter, return_inverse=True)
            self.n[d] = np.bincount(self.up[d], weights=self.n[d + 1], minlength=len(self.grams[d]))

    def levels(self, k: int) -> dict[int, Level]:
        """By depth, for the choice of bit ``k`` (0 is the highest)."""
        out: dict[int, Level] = {}
        for d in range(DEPTH, TOP - 1, -1):
            start = self.grams[d] >> np.uint64(8 - k)
            new = np.concatenate(([True], start[1:] != start[:-1]))
            first, of_gram = np.flatnonzero(new), np.cumsum(new) - 1
            ones = (self.grams[d] >> np.uint64(7 - k)) & np.uint64(1)
            n1 = np.add.reduceat(self.n[d] * ones, first)
            n0 = np.add.reduceat(self.n[d], first) - n1
            kt = kt_of(n0, n1)
            if d == DEPTH:
                weighted, stop = kt, np.ones(len(kt))
            else:
                under = out[d + 1]
                under.parent = of_gram[self.up[d][under.first]]
                weighted = math.log(0.5) + np.logaddexp(kt, np.bincount(under.parent, weights=under.weighted, minlength=len(first)))
                stop = 0.5 * np.exp(kt - weighted)
            out[d] = Level(first, of_gram, n0, n1, weighted, stop, None)
        return out

    def keys(self, level: Level, k: int) -> np.ndarray:
        """Names of the nodes at depth ``TOP``: the context's bytes, then a one and the first ``k`` bits."""
        grams = self.grams[TOP][level.first]
        byte = grams & np.uint64(255)
        return (grams - byte) | np.uint64(1 << k) | (byte >> np.uint64(8 - k))

    def log_p(self, key: np.ndarray, p: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 of the mixed probability of each gram's byte.

        ``key`` are the nodes at depth ``TOP`` in order, with the probability of a one from the depths above and
        the weight that is left for this depth and those below.
        """
        out = np.zeros(len(self.grams[DEPTH]))
        for k in range(8):
            levels = self.levels(k)
            at = np.searchsorted(key, self.keys(levels[TOP], k))
            one, left = p[at], rest[at]
            for d in range(TOP, DEPTH + 1):
                level = levels[d]
                if d > TOP:
                    one, left = one[level.parent], left[level.parent]
                one, left = one + left * level.stop * level.one, left * (1 - level.stop)
            one = one[levels[DEPTH].of_gram]
            bit = (self.grams[DEPTH] >> np.uint64(7 - k)) & np.uint64(1)
            out += np.log10(np.where(bit == 1, one, 1 - one))
        return out


def _unify(batch: pa.Table) -> pa.Table:
    """What a bucket makes of its requests, by kind.

    0: the counts of a block's words; 1: the bucket's grams with their counts; 2: the places of a block's grams
    among them; 3: nodes at depth ``TOP``.
    """
    at, bucket = batch["block"].to_pylist(), batch["bucket"][0].as_py()
    words = B.unpacked(batch, "words", "<u8")
    keys, n = B.summed(words, B.unpacked(batch, "words_n", "<i8")) if sum(map(len, words)) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    grams = [opened_steps(x) for x in batch["grams"].to_pylist()]
    totals = {"tokens": int(n.sum()), "known": int((n > 0).sum())}
    rows = [{"kind": 0, "block": b, "found": n[np.searchsorted(keys, w)].tobytes(), **totals} for b, w in zip(at, words)]
    nodes = pa.table({c: pa.array([], pa.float64() if c == "weighted" else pa.int64()) for c in ("key", "n0", "n1", "weighted")})
    if sum(map(len, grams)):
        codes, m = B.summed(grams, [opened(x) for x in batch["grams_n"].to_pylist()])
        rows.append({"kind": 1, "found": packed_steps(codes), "more": packed(m)})
        trees = Subtrees(codes, m)
        found = []
        for k in range(8):
            top = trees.levels(k)[TOP]
            found.append(pa.table({"key": trees.keys(top, k).astype(np.int64), "n0": top.n0.astype(np.int64), "n1": top.n1.astype(np.int64), "weighted": top.weighted}))
        nodes = pa.concat_tables(found).combine_chunks()
        rows += [{"kind": 2, "block": b, "found": packed_steps(np.searchsorted(codes, g)), **totals} for b, g in zip(at, grams)]
    else:
        rows += [{"kind": 2, "block": b, "found": packed_steps(g), **totals} for b, g in zip(at, grams)]
    schema = pa.schema(
        [("kind", pa.int32()), ("block", pa.int32()), ("bucket", pa.int32()), ("found", pa.binary()), ("more", pa.binary())]
        + [(c, pa.float64() if c == "weighted" else pa.int64()) for c in ("key", "n0", "n1", "weighted", "tokens", "known")]
    )
    small = pa.Table.from_pylist([{"bucket": bucket, **r} for r in rows], schema)
    for name, value in (("kind", 3), ("bucket", bucket)):
        nodes = nodes.append_column(name, pa.array(np.full(nodes.num_rows, value, np.int32)))
    return pa.concat_tables([small, nodes], promote_options="default").select(schema.names)


def top_states(nodes: DataFrame) -> DataFrame:
    """bucket, key, p and rest of every node at depth ``TOP``.

    p is the probability of a one from the depths above, rest the weight they leave. ``nodes`` has bucket, key,
    n0, n1 (training counts) and weighted (the logarithm of the node's weighted probability).
    """
    kt = kt_of(F.col("n0"), F.col("n1"))
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    # Without the farthest byte of the context.
    up = F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(F.expr("key & 255L"))
    levels = [nodes]
    for _ in range(TOP):
        node = levels[0].groupBy(up.alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        node = node.withColumn("kt", kt)
        high = F.greatest("kt", "below")
        weighted = math.log(0.5) + high + F.log(F.exp(F.col("kt") - high) + F.exp(F.col("below") - high))
        levels.insert(0, stored(node.withColumn("weighted", weighted).withColumn("stop", 0.5 * F.exp(F.col("kt") - F.col("weighted")))))
    state = levels[0].select("key", (F.col("stop") * one).alias("p"), (1 - F.col("stop")).alias("rest"))
    for level in levels[1:-1]:
        here = level.select("key", up.alias("up"), one.alias("one"), "stop")
        state = here.join(state.select(F.col("key").alias("up"), "p", "rest"), "up").select(
            "key", (F.col("p") + F.col("rest") * F.col("stop") * F.col("one")).alias("p"), (F.col("rest") * (1 - F.col("stop"))).alias("rest")
        )
    above = state.select(F.col("key").alias("up"), "p", "rest")
    return nodes.select("bucket", "key", up.alias("up")).join(above, "up").select("bucket", "key", "p", "rest")


def _answer(unified: pa.Table, states: pa.Table) -> pa.Table:
    """Code lengths of the grams of each block, in the order of its request."""
    rows = unified.to_pylist()
    values = np.zeros(0)
    for r in rows:
        if r["kind"] == 1:
            order = np.argsort(np.asarray(states["key"]))
            key, p, rest = (np.asarray(states[c])[order] for c in ("key", "p", "rest"))
            values = Subtrees(opened_steps(r["found"]), opened(r["more"])).log_p(key.astype(np.uint64), p, rest)
    values = values.astype("<f4")
    asked = [r for r in rows if r["kind"] == 2]
    out = {c: [r[c] for r in asked] for c in ("kind", "block", "bucket", "tokens", "known")}
    found = [values[opened_steps(r["found"]).astype(np.int64)].tobytes() for r in asked]
    whole = lambda c: pa.array(out[c], pa.int32())
    return pa.table(
        {"kind": whole("kind"), "block": whole("block"), "bucket": whole("bucket"), "found": pa.array(found, pa.binary()), "tokens": pa.array(out["tokens"], pa.int64()), "known": pa.array(out["known"], pa.int64())}
    )


def _reader(buckets: int):
    def read(docs: pa.Table, answers: pa.Table) -> pa.Table:
        return _read(docs, answers, buckets)

    return read


def _read(docs: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])
    if not docs.num_rows:
        return schema.empty_table()
    rows = sorted(zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["found"].to_pylist(), answers["tokens"].to_pylist(), answers["known"].to_pylist()))
    parsed = Parsed(docs["text"].to_pylist(), buckets)
    counts = np.frombuffer(b"".join(r[2] for r in rows if r[0] == 0), "<i8")
    lengths = np.frombuffer(b"".join(r[2] for r in rows if r[0] == 2), "<f4").astype(float)
    score = np.bincount(parsed.row_of, weights=lengths[parsed.gram_of], minlength=docs.num_rows)
    n, v = sum(r[3] for r in rows if r[0] == 0), sum(r[4] for r in rows if r[0] == 0)
    sums = lambda x, starts: np.add.reduceat(x, starts)  # noqa: E731  no text is without an end
    base = sums(np.log10(counts + 1.0)[parsed.word_of], parsed.token_starts) - parsed.n_tokens * np.log10(n + v + 1.0)
    columns = [docs["doc_id"], parsed.n_tokens, sums((counts > 0).astype(np.int64)[parsed.word_of], parsed.token_starts), np.full(len(base), n), base, score, parsed.n_bytes]
    return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def held_out() -> Column:
    """Whether crc32 of the id, as text, leaves 2 by 7; an id that is null counts as empty."""
    return F.crc32(F.coalesce(col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score(docs: DataFrame, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes of every row.

    Rows that are not held out train both models. base_score is that of single words with one added to each
    count; score is the log10 probability of the text's bytes under the weighted trees, so
    -score / log10(2) / n_bytes is its code length in bits a byte. Null and empty texts are the end alone. Equal
    rows all count. An empty table gives no rows.
    """
    n = B.count_blocks(docs, block_bytes)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // BLOCKS_PER_BUCKET)
    dealt = B.dealt(docs, n, (~held_out()).alias("train"))
    asked = dealt.groupBy("block").applyInArrow(_ask(buckets), _REQUEST)
    unified = stored(asked.groupBy("bucket").applyInArrow(_unify, _UNIFIED))
    states = top_states(unified.where("kind = 3").select("bucket", "key", "n0", "n1", "weighted")).withColumnRenamed("bucket", "of_bucket")
    of_grams = unified.where("kind in (1, 2)").select("kind", "block", "bucket", "found", "more", "tokens", "known")
    of_grams = of_grams.groupBy("bucket").cogroup(states.groupBy("of_bucket")).applyInArrow(_answer, _ANSWER)
    answers = unified.where("kind = 0").select("kind", "block", "bucket", "found", "tokens", "known").unionByName(of_grams)
    read = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _reader(buckets), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    )
    return read.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")
