"""Conversation structure repair (operator 13).

A conversation is repaired when the initials of its roles read ``(s?(ua)+)?``. The cheapest edits are a shortest
path: its nodes are (row, state of that pattern), its edges Keep, Rerole, Delete and Insert. A path's weight is one
big integer. The high digits are its cost. Below stand ``WIDTH`` digits of fixed size, one for each audit letter from
left to right in the order of ASCII (D, I, K, R are 1 to 4) and zeros for the places after the last letter.
So the smaller integer is the cheaper path or, at equal cost, the smaller audit, and a plain minimum decides all.

Two paths to one node with equal cost are never prefixes of each other: the letters alone fix the rows they consume
and the cost. So the minimum at a node is right whatever comes after it. What the paths to all states have in
common at their start is decided; it is taken off the integers, which so stay a few machine words long. If
they have nothing in common, the width is doubled.

Spark damages the rows, marks faults and copies, and sorts rows by conversation and turn; a task then reads them
as a stream and holds the rows that are not yet decided, not the conversation. The order of a conversation's
hash over its whole repaired text leaves it to one task however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.operators.joins import small_side

#: Costs of the contract; Keep costs nothing, and a truncated row that stays adds its own.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Letters of an audit and their digits.
LETTERS = "\0DIKR"
DIGIT = {c: i for i, c in enumerate(LETTERS)}
#: Audit letters in the low digits, at first.
WIDTH = 64
_BITS = 3
START, S, U, A = range(4)
#: The state after an inserted or rerolled row, and after a kept row with the given initial.
_TURN = {START: U, S: U, U: A, A: U}
_KEPT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
_ROLE = {U: "user", A: "assistant"}

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Paths:
    """The smallest weight of a path to each state, and the decided part of their audits.

    ``told`` is called with each decided letter.
    """

    def __init__(self, told, width: int = WIDTH):
        self.width, self.told, self.cost = width, told, 0
        self.best: dict[int, int] = {START: 0}

    def _plus(self, weight: int, cost: int, letter: str) -> int:
        """``weight`` with one more letter, which goes to the first zero place."""
        low = weight & ((1 << (_BITS * self.width)) - 1)
        end = ((low & -low).bit_length() - 1) // _BITS if low else self.width
        return weight + (cost << (_BITS * self.width)) + (DIGIT[letter] << (_BITS * (end - 1)))

    def _relax(self, into: dict[int, int], state: int, weight: int) -> None:
        if state not in into or weight < into[state]:
            into[state] = weight

    def insert(self) -> None:
        """One row inserted at this place, then perhaps another: more would come back to a state that is here already."""
        self._room()
        for _ in range(2):
            for state, weight in list(self.best.items()):
                self._relax(self.best, _TURN[state], self._plus(weight, INSERT, "I"))

    def row(self, initial: str, truncated: bool, gone: bool) -> None:
        """The edges over one row; ``gone`` rows can only be deleted."""
        self.insert()
        extra = TRUNCATED if truncated else 0
        after: dict[int, int] = {}
        for state, weight in self.best.items():
            self._relax(after, state, self._plus(weight, DELETE, "D"))
            if not gone:
                self._relax(after, _TURN[state], self._plus(weight, REROLE + extra, "R"))
                if (state, initial) in _KEPT:
                    self._relax(after, _KEPT[state, initial], self._plus(weight, extra, "K"))
        self.best = after

    def end(self) -> int:
        """The cost of the cheapest whole path; all its letters are told."""
        self.insert()
        least = min(self.best[s] for s in (START, A) if s in self.best)
        self._tell(least & ((1 << (_BITS * self.width)) - 1), self.width)
        return self.cost + (least >> (_BITS * self.width))

    def _tell(self, low: int, letters: int) -> None:
        for i in range(letters):
            digit = (low >> (_BITS * (self.width - 1 - i))) & ((1 << _BITS) - 1)
            if digit:
                self.told(LETTERS[digit])

    def _room(self) -> None:
        """Make room for the letters of one more row: at most three."""
        size = _BITS * self.width
        mask = (1 << size) - 1
        if all(w & ((1 << (_BITS * 3)) - 1) == 0 for w in self.best.values()):
            return
        lows = [w & mask for w in self.best.values()]
        differ = 0
        for low in lows:
            differ |= low ^ lows[0]
        common = (size - differ.bit_length()) // _BITS
        if common < 3:
            self.best = {s: ((w >> size) << (2 * size)) | ((w & mask) << size) for s, w in self.best.items()}
            self.width *= 2
            return
        common = min(common, *(self.width - ((low & -low).bit_length() - 1) // _BITS for low in lows))
        self._tell(lows[0], common)
        base = min(w >> size for w in self.best.values())
        self.cost += base
        self.best = {s: (((w >> size) - base) << size) | ((w << (_BITS * common)) & mask) for s, w in self.best.items()}


class Conversation:
    """Counts, edits and hash of one conversation whose rows come in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.low = self.high = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last: tuple | None = None
        self.audit: list[str] = []
        self.open: list[tuple[str, str]] = []
        self.done = 0
        self.state, self.hash, self.first = START, hashlib.sha256(), True
        self.paths = Paths(self._letter)

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def _letter(self, letter: str) -> None:
        """Carry out one decided edit on the rows that wait for theirs."""
        self.audit.append(letter)
        role, text = ("", "") if letter == "I" else self.open[self.done]
        self.done += letter != "I"
        if letter == "K":
            self.state = _KEPT[self.state, role[:1]]
            self._line(role, text)
        elif letter in "RI":
            self.state = _TURN[self.state]
            self._line(_ROLE[self.state], text)
        if self.done > 256:
            del self.open[: self.done]
            self.done = 0

    def add(self, turn: int | None, role: str, text: str, empty: bool, copy: bool, cut: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        if self.last is not None:
            self.illegal += self.last[1][:1] + role[:1] not in ("su", "ua", "au")
        copy = copy or self.last == (turn, role, text)
        self.last = (turn, role, text)
        copy, cut = copy and not empty, cut and not copy and not empty
        self.blank += empty
        self.duplicate += copy
        self.truncated += cut
        self.open.append((role, text))
        self.paths.row(role[:1], cut, empty or copy)

    def result(self) -> tuple:
        cost = self.paths.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.hash.hexdigest())


_NAMES = [f.split()[0] for f in RESULT.split(", ")]
_SCHEMA = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in _NAMES])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: Conversation | None = None
    out: list[tuple] = []

    def packed():
        columns = list(zip(*out)) or [()] * len(_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types)], schema=_SCHEMA)

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "lost", "empty", "copy", "cut")]
        for conv, turn, role, text, lost, empty, copy, cut in zip(*columns):
            if now is None or now.conv_id != conv:
                if now is not None:
                    out.append(now.result())
                now = Conversation(conv)
            if not lost:
                now.add(turn, role, text, empty, copy, cut)
        if len(out) >= 1000:
            yield packed()
            out.clear()
    if now is not None:
        out.append(now.result())
    if out:
        yield packed()


_BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and lost of the rows of a conversations table, damaged by the hash of their place.

    Of 20 remainders, 0 loses the row (it stays, marked ``lost``, so that its conversation is known), 1 empties its text,
    2 takes its ends of sentences, 3 repeats it, 4 makes its role user. Nulls count as one space, but a null turn is
    kept as such.
    """
    text_of = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    base = rows.select(col("conv_id").cast("long").alias("conv_id"), col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    once = base.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), "kind")
    return once.withColumn("n", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("n", "kind")


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text), as it is after the damage: faults, cheapest edits, hash.

    ``rows`` are those of ``damaged``, or any other with a column ``lost``. Rows stand in the order of turn, nulls first;
    rows of one turn in that of role and text. A null conv_id is a conversation like any other. A role that is empty or starts with no s, u or
    a is never kept. Equal rows stand together, so all but one are duplicates. A conversation that lost every row has zeros,
    an empty audit and the hash of the empty string. Texts of any length are carried whole; memory follows the rows
    that wait for a decision. An empty table gives none. Other columns are not read.
    """
    lost = F.col("lost") if "lost" in rows.columns else F.lit(False)
    base = rows.select("conv_id", "turn", "role", "text", lost.alias("lost"))
    names = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2")]
    # Only what occurs at several turns of a conversation has to be looked up; copies at one turn stand together.
    first = base.where(~F.col("lost")).select("conv_id", "turn", *names).groupBy("conv_id", "h1", "h2").agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("known"), F.count(F.lit(1)).alias("n")
    )
    first = first.where((F.col("low") < F.col("high")) | ((F.col("known") > 0) & (F.col("known") < F.col("n"))))
    first = first.select(F.col("conv_id").alias("c"), "h1", "h2", F.when(F.col("known") == F.col("n"), F.col("low")).alias("low"), F.lit(True).alias("again"))
    marked = base.select("*", *names)
    side = small_side(first)
    marked = marked.join(side, marked["conv_id"].eqNullSafe(side["c"]) & (marked["h1"] == side["h1"]) & (marked["h2"] == side["h2"]), "left")
    body = F.rtrim(F.col("text"), F.lit(_BLANKS))
    # If some copy has no turn, which is first, every copy with one is later; else those after the least.
    later = F.coalesce(F.col("again") & F.col("turn").isNotNull() & (F.col("low").isNull() | (F.col("turn") > F.col("low"))), F.lit(False))
    ready = marked.select(
        "conv_id", "turn", "role", "text", "lost", (body == "").alias("empty"), later.alias("copy"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut")
    )
    ordered = ready.repartition("conv_id").sortWithinPartitions("conv_id", F.col("lost").desc(), F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(_repaired, RESULT)
