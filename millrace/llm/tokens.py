"""Token counts by a count-only Viterbi (operator 3).

The vocabulary is read as a unigram model: each piece has a score, the best segmentation has the
highest sum. An Aho-Corasick automaton enumerates the pieces that end at each character; the dynamic
program carries the best score and its number of pieces, never the pieces. Ties go as in the
tokenizers: at one end, the piece that starts first wins, and an unknown character only wins by
being better. Unknown characters count one piece for each UTF-8 byte where the vocabulary has byte
pieces, else a run of them counts one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.functions.semantics import col
from millrace.llm.common import steps, text_bytes

#: The default vocabulary: a file name that the folder of public tokenizers knows.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: What an unknown character scores less than the lowest piece.
UNKNOWN = 10.0
#: Words that a task remembers at once, and characters of such a word at most.
MEMORY, LONGEST = 400_000, 64
SPACE = "▁"


@dataclass
class Unigram:
    """Pieces with scores, and whether bytes stand in for unknown characters."""

    pieces: dict[str, float]
    byte_fallback: bool = True
    _machine: ahocorasick.Automaton | None = field(default=None, repr=False)
    _known: dict[str, tuple[float, int]] = field(default_factory=dict, repr=False)
    _split: bool = field(default=False, repr=False)
    _unknown: float = field(default=0.0, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_machine": None, "_known": {}}

    @property
    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            out = ahocorasick.Automaton()
            for piece, score in self.pieces.items():
                out.add_word(piece, (len(piece), score))
            out.make_automaton()
            self._machine = out
            # Texts may be cut before a blank that follows something else, if no piece spans such a place.
            self._unknown = min(self.pieces.values(), default=0.0) - UNKNOWN
            self._split = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)
        return self._machine

    def best(self, text: str) -> tuple[float, int]:
        """Score and number of pieces of the best segmentation of a text, blanks already replaced."""
        if not text:
            return 0.0, 0
        machine = self.machine
        n = len(text)
        unknown = self._unknown
        score, count, lost = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0

        def close(at: int, single: bool, found: tuple[float, int] | None) -> None:
            """The state behind character ``at`` - 1 from the best piece that ends there, or the character as unknown."""
            if not single:
                other = score[at - 1] + unknown
                if found is None or other > found[0]:
                    more = len(text[at - 1].encode("utf-8", "replace")) if self.byte_fallback else int(not lost[at - 1])
                    score[at], count[at], lost[at] = other, count[at - 1] + more, True
                    return
            score[at], count[at] = found

        found, single = None, False
        for last, (length, value) in machine.iter(text) if len(machine) else ():
            while done < last:  # all ends before this one are complete
                done += 1
                close(done, single, found)
                found, single = None, False
            start = last + 1 - length
            candidate = score[start] + value
            if found is None or candidate > found[0]:
                found = (candidate, count[start] + 1)
            single = single or length == 1
        while done < n:
            done += 1
            close(done, single, found)
            found, single = None, False
        return score[n], count[n]

    def measure(self, text: str) -> tuple[float, int]:
        """As ``best``, of a raw text: a blank is put in front, blanks become the sign for them."""
        if not text:
            return 0.0, 0
        machine = self.machine
        if not machine or not self._split:
            return self.best(SPACE + text.replace(" ", SPACE))
        known = self._known
        if "  " in text or text[0] == " ":
            words = [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        else:
            words = text.split(" ")
        total, pieces = 0.0, 0
        for word in words:
            found = known.get(word)
            if found is None:
                found = self.best(SPACE + word.replace(" ", SPACE))
                if len(word) <= LONGEST:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[word] = found
            total += found[0]
            pieces += found[1]
        return total, pieces


def from_sentencepiece(path: str = VOCABULARY) -> Unigram:
    """The ordinary pieces of a sentencepiece model file with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    pieces = {model.id_to_piece(i): model.get_score(i) for i in ids if not special(i)}
    return Unigram(pieces, sum(map(model.is_byte, ids)) == 256)


def count(docs: DataFrame, model: Unigram) -> DataFrame:
    """doc_id, n_chars, n_tokens and token_score of every row, from whole texts.

    Null and empty texts have no tokens and score 0. The vocabulary travels as a broadcast; its size
    is that of a tokenizer's file and does not depend on the texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = shared.value
        for batch in steps(batches):
            texts = [t.decode("utf-8", "replace") for t in batch["text"].to_pylist()]
            found = [unigram.measure(t) for t in texts]
            arrays = [batch["doc_id"], pa.array(map(len, texts), pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[0] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_chars", "n_tokens", "token_score"])

    base = docs.select(col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return base.mapInArrow(counted, "doc_id long, n_chars long, n_tokens long, token_score double")
