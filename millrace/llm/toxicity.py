"""Toxicity by a weighted lexicon (operator 7).

Texts are folded: look-alike letters and digit substitutions become plain letters. One
Aho-Corasick automaton finds the lexicon's words and word beginnings; matches inside exception phrases
do not count. The sum of weights, as it is and for each hundred words, gives the score. Terms,
weights and the two factors are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.llm.common import alnum_words, steps, text_bytes

#: Labelled rows of each kind that the lexicon is learned from at most, in the order of a hash of their id.
TOXIC_ROWS, CLEAN_ROWS = 4_000, 8_000
#: Terms that selection looks at, terms of the lexicon, and the fewest toxic texts of a term.
CANDIDATES, TERMS, LEAST = 3_000, 400, 4
#: Toxic texts that a clean one outweighs, and what a further term of a toxic text is worth after each that marks it.
CLEAN_COST, AGAIN = 8, 0.6
#: Lengths of word beginnings that may be terms.
BEGINNINGS = range(3, 11)

#: Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "loser bracket")

#: Letters of other scripts and digits that stand in for a letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѐ": "e", "ё": "e", "ɡ": "g", "һ": "h", "і": "i", "ї": "i", "ӏ": "i", "ј": "j", "к": "k",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
}
#: Marks that stand in for a letter between letters.
MARKS = {"@": "a", "$": "s", "!": "i", "|": "i", "*": ""}


def _folding(accents: bool) -> dict[int, str]:
    """Letters to the small letter they look like, accents kept or not; l, I and 1 look alike and become i."""
    table = {}
    for code in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        base = unicodedata.normalize("NFKC" if accents else "NFKD", chr(code)).lower()
        base = "".join(c for c in base if not unicodedata.combining(c))
        table[code] = "".join(HOMOGLYPHS.get(c, c) for c in base).replace("l", "i")
    table |= {ord(k): v for k, v in HOMOGLYPHS.items()}
    table |= {0xAD: "", 0x200B: "", 0x200C: "", 0x200D: ""}
    return table if accents else table | {0x300 + i: "" for i in range(0x70)}


_FOLD, _FOLD_ACCENTS = _folding(True), _folding(False)
_MARKED = re.compile(r"(?<=[^\W_])[@$!|*](?=[^\W_])")


def fold(text: bytes) -> list[bytes]:
    """Folded words of a text, with accents."""
    return alnum_words(text.decode("utf-8", "replace").translate(_FOLD).encode())


def fold_accents(words: list[bytes]) -> list[bytes] | None:
    """The words without accents, None if they have none."""
    joined = b" ".join(words)
    return None if joined.isascii() else alnum_words(joined.decode("utf-8", "replace").translate(_FOLD_ACCENTS).encode())


def foldings(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, folded; again without accents, and with marks as letters, where that differs."""
    marked = fold_marks(text)
    for variant in (text, *([] if marked is None else [marked])):
        words = fold(variant)
        yield words
        plain = fold_accents(words)
        if plain is not None:
            yield plain


def fold_marks(text: bytes) -> bytes | None:
    """The text with marks between letters turned into letters, None if it has none."""
    changed, n = _MARKED.subn(lambda m: MARKS[m[0]], text.decode("utf-8", "replace"))
    return changed.encode() if n else None


def terms_of(text: bytes) -> set[bytes]:
    """Words and word beginnings as the automaton meets them: a blank before, and one behind whole words."""
    words = fold(text)
    out = set()
    for word in {*words, *(fold_accents(words) or ())}:
        out.add(b" " + word + b" ")
        out.update(b" " + word[:k] for k in BEGINNINGS if k <= len(word))
    return out


@dataclass
class Lexicon:
    """Terms with weights, exception phrases, and the factors of the score."""

    weights: dict[bytes, float]
    exceptions: Sequence[str] = EXCEPTIONS
    factors: tuple[float, float, float] = (-3.0, 1.0, 1.0)
    _machine: ahocorasick.Automaton | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_machine": None}

    @property
    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            out = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                out.add_word(term.decode("latin-1"), (len(term), weight))
            for phrase in self.exceptions:
                term = b" " + b" ".join(fold(phrase.encode())) + b" "
                out.add_word(term.decode("latin-1"), (len(term), None))
            out.make_automaton()
            self._machine = out
        return self._machine

    def matches(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(start, end, weight) of matches in the words, joined by blanks, that no exception covers."""
        if not words or not len(self.machine):
            return []
        joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
        found = [(end - n + 1, end, w) for end, (n, w) in self.machine.iter(joined)]
        spared = [(a, b) for a, b, w in found if w is None]
        return [(a, b, w) for a, b, w in found if w is not None and not any(x <= a and b <= y for x, y in spared)]

    def measure(self, text: bytes) -> tuple[float, int, int]:
        """Sum of weights (of nested terms at one place the largest), matches, words."""
        best = (0.0, 0, 0)
        for words in foldings(text):
            at: dict[int, float] = {}
            for start, _, weight in self.matches(words):
                at[start] = max(weight, at.get(start, 0.0))
            best = max(best, (sum(at.values()), len(at), len(words)))
        return best

    def score(self, text: bytes) -> float:
        return float(logistic(inputs([self.measure(text)]) @ np.array(self.factors))[0])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def inputs(measures: Sequence[tuple[float, int, int]]) -> np.ndarray:
    m = np.array(measures, float).reshape(-1, 3)
    return np.stack((np.ones(len(m)), np.log1p(m[:, 0]), np.log1p(100 * m[:, 0] / np.maximum(m[:, 2], 1))), axis=1)


def held_out(parts: int, rest: int) -> Column:
    """Whether crc32 of the id, as text, leaves ``rest``; an id that is null counts as empty."""
    return F.crc32(F.coalesce(col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == rest


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """text and toxic of labelled rows that are not held out, of each kind so many at most, without near copies."""
    known = labels.select(col("doc_id").cast("long").alias("doc_id"), col("toxic").cast("int").alias("toxic")).dropna().where(~held_out(5, 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    take = lambda kind, n: known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    few = take(1, toxic_rows).unionByName(take(0, clean_rows))
    texts = docs.select(col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    texts = texts.join(F.broadcast(few), "doc_id")
    # One of several near copies teaches: those with the same least name of two words in a row.
    words = F.split(F.lower(F.col("text").cast("string")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    twos = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.xxhash64(a, b))
    return texts.withColumn("least", F.array_min(twos)).dropDuplicates(["toxic", "least"]).select("text", "toxic")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        terms = list(counts[0].keys() | counts[1].keys())
        for i in range(0, len(terms), 1 << 16):
            some = terms[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), *(pa.array([c[t] for t in some], pa.int64()) for c in counts)], ["term", "clean", "toxic"])
        counts[0].clear(), counts[1].clear()

    for batch in steps(batches):
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            counts[toxic].update(terms_of(text))
        if len(counts[0]) + len(counts[1]) > 1_000_000:
            yield from out()
    yield from out()


def _held(terms: list[bytes]):
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(terms)}
        for batch in steps(batches):
            found = [sorted(place[t] for t in terms_of(x) if t in place) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])

    return held


def choose(terms: list[bytes], rows: list[tuple[int, list[int]]], most: int = TERMS) -> list[int]:
    """Terms one by one, each the one with the most toxic texts, of which ``CLEAN_COST`` go off for each clean one.

    A toxic text counts for less the more of the terms before mark it, so that all terms of a text that
    others have too come in, but not all words of one text. Of a word and its beginnings only
    the first picked stays. Of equal terms the longest comes first, then the smallest.
    """
    toxic: dict[int, list[int]] = {}
    clean = Counter()
    of_row = {}
    for r, (kind, found) in enumerate(rows):
        if kind:
            of_row[r] = found
            for t in found:
                toxic.setdefault(t, []).append(r)
        else:
            clean.update(found)
    worth = dict.fromkeys(of_row, 1.0)
    gain = {t: len(x) - CLEAN_COST * clean[t] for t, x in toxic.items()}
    picked = []
    while len(picked) < most and gain:
        t = max(gain, key=lambda t: (round(gain[t], 6), len(terms[t]), [-c for c in terms[t]]))
        if gain[t] < LEAST:
            break
        picked.append(t)
        for r in toxic[t]:
            for other in of_row[r]:
                if other in gain:
                    gain[other] -= worth[r] * (1 - AGAIN)
            worth[r] *= AGAIN
        word = terms[t].rstrip(b" ")
        for other in [o for o in gain if terms[o].startswith(word) or word.startswith(terms[o].rstrip(b" "))]:
            del gain[other]
    return picked


def learn(docs: DataFrame, labels: DataFrame, exceptions: Sequence[str] = EXCEPTIONS, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Lexicon:
    """A lexicon from a sample of labelled rows; an empty one if there are none of either kind.

    Terms are counted by Spark. The driver gets the ``CANDIDATES`` terms with the most telling counts
    and, for each row of the sample, which of them it has.
    """
    rows = sample(docs, labels, toxic_rows, clean_rows)
    counted = rows.mapInArrow(_counts, "term binary, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    telling = counted.where((F.col("toxic") >= LEAST) & (F.col("toxic") > CLEAN_COST * F.col("clean")))
    terms = [bytes(r["term"]) for r in telling.orderBy(F.desc(F.col("toxic") - CLEAN_COST * F.col("clean")), F.desc(F.length("term")), "term").limit(CANDIDATES).collect()]
    if not terms:
        return Lexicon({}, exceptions)
    found = [(r["toxic"], r["found"]) for r in rows.mapInArrow(_held(terms), "toxic int, found array<int>").collect()]
    picked = choose(terms, found)
    n_toxic, n_clean = sum(k for k, _ in found), sum(1 - k for k, _ in found)
    counts = (Counter(), Counter())
    for kind, has in found:
        counts[kind].update(has)
    weight = lambda t: math.log((counts[1][t] + 0.5) / (n_toxic + 1)) - math.log((counts[0][t] + 0.5) / (n_clean + 1))
    lexicon = Lexicon({terms[t]: max(weight(t), 0.1) for t in picked}, exceptions)
    measured = rows.mapInArrow(_measured(lexicon), "toxic int, sum double, n int, words int").collect()
    lexicon.factors = calibrate([(r["sum"], r["n"], r["words"]) for r in measured], [r["toxic"] for r in measured])
    return lexicon


def _measured(lexicon: Lexicon):
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            m = [lexicon.measure(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], *(pa.array([x[i] for x in m], k) for i, k in enumerate((pa.float64(), pa.int32(), pa.int32())))], ["toxic", "sum", "n", "words"])

    return measured


def calibrate(measures: Sequence[tuple[float, int, int]], toxic: Sequence[int], ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression of the label on the two sums, by Newton's steps; the factors of the sums stay positive."""
    x, y = inputs(measures), np.array(toxic, float)
    w = np.zeros(3)
    for _ in range(30):
        p = logistic(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
        w[1:] = np.maximum(w[1:], 1e-3)
    return tuple(w)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, predicted, n_matches and n_words of every row, from its text alone.

    Null texts count as empty. A text without a match gets the score of no match.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            m = [lexicon.measure(t) for t in batch["text"].to_pylist()]
            s = logistic(inputs(m) @ np.array(lexicon.factors))
            arrays = [batch["doc_id"], pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array([x[1] for x in m], pa.int64()), pa.array([x[2] for x in m], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "predicted", "n_matches", "n_words"])

    base = docs.select(col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return base.mapInArrow(scored, "doc_id long, score double, predicted int, n_matches long, n_words long")
