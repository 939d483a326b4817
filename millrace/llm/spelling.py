"""Spelling variants of a corpus' words by asymmetric q-chunks (operator 12).

Two words are near if one inserted, deleted or replaced code point makes one of them the other. The shorter word (of
equally long ones, the smaller) gives two disjoint chunks, its halves; the other gives the positional grams of a
chunk's length. One edit leaves a chunk whole, and it stands in the longer word at its own place or shifted by one:
so words meet on a chunk's text, place and length, and what meets is verified.

Halves of common words are shared by many. One edit also leaves a half of the other chunk whole, before or behind the
edit. So a chunk meets together with either half of what it leaves, which makes the groups small at any size of the
vocabulary; no pair is lost by that.

All of it runs in the JVM. What words follow (``form``) has at least ten times their count, so chains are short;
roots are found by joining the chains with themselves until nothing moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.semantics import col
from millrace.session import cut_lineage

#: Every how many-th hash damages a word (the contract's own test of the operator), 0 for none.
DAMAGE = 31
LENGTH, COUNT, RATIO = 7, 2, 10
#: Code points beyond which words are compared from both ends.
LONG = 100
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """word and n of the words of at least ``LENGTH`` code points that occur ``COUNT`` times or more."""
    text = F.translate(F.coalesce(col("text").cast("string"), F.lit("")), UPPER, LOWER)
    runs = F.regexp_extract_all(text, F.lit("([a-z\\u00C0-\\u00FF]{%d,})" % LENGTH), F.lit(1))
    words = docs.select(F.coalesce(col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("word"))
    if damage:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        words = words.select("word", h.alias("h"), F.char_length("word").alias("size"))
        at = (F.col("h") % F.col("size")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.col("size")))
        words = words.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("word")).alias("word"))
    words = words.where(F.char_length("word") >= LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COUNT)


def _piece(start: Column, size: Column) -> Column:
    return F.substring(F.col("word"), start + 1, size)


def _keys(length: Column, shift: Column) -> Column:
    """One key for each chunk and half of its rest, of a word that is to meet words of ``length`` code points.

    ``shift`` is how much longer the word itself is: what stands behind an edit starts so much later in it.
    """
    half = F.shiftright(length, 1)
    front, back = _piece(F.lit(0), half), _piece(half + shift, length - half)
    cut_b = half + F.shiftright(length - half, 1)
    cut_a = F.shiftright(half, 1)
    name = lambda kind, *parts: F.xxhash64(F.lit(kind), length, *parts)
    return F.array(
        name(0, front, _piece(half, cut_b - half)),  # the edit is in the last quarter
        name(1, front, _piece(cut_b + shift, length - cut_b)),  # in the third
        name(2, back, _piece(F.lit(0), cut_a)),  # in the second
        name(3, back, _piece(cut_a + shift, half - cut_a)),  # in the first
    )


def _one_edit() -> Column:
    """Whether one edit parts the columns a and b, in time linear in their length: what they share at both ends is enough."""
    a, b, shift = F.split("a", ""), F.split("b", ""), F.col("shift")
    size = F.col("sa")
    ends = [F.zip_with(a, F.slice(b, 1, size), lambda x, y: x != y), F.reverse(F.zip_with(a, F.slice(b, 1 + shift, size), lambda x, y: x != y))]
    same = [F.coalesce(F.nullif(F.array_position(e, True), F.lit(0).cast("long")) - 1, size.cast("long")) for e in ends]
    return same[0] + same[1] >= size - 1 + shift


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, na, b, nb) of ``words`` (word, n) that one edit parts; ``a`` is shorter, or as long and smaller."""
    sized = words.select("word", "n", F.char_length("word").alias("size"))
    chunks = sized.select(F.col("word").alias("a"), F.col("n").alias("na"), F.col("size").alias("sa"), F.explode(_keys(F.col("size"), F.lit(0))).alias("key"))
    of = F.array(F.lit(0), F.lit(1))
    grams = sized.withColumn("shift", F.explode(of))
    grams = grams.select(F.col("word").alias("b"), F.col("n").alias("nb"), "shift", F.explode(_keys(F.col("size") - F.col("shift"), F.col("shift"))).alias("gram"))
    met = (F.col("key") == F.col("gram")) & ((F.col("shift") == 1) | (F.col("a") < F.col("b")))
    near = F.char_length("b") - F.col("sa") == F.col("shift")
    # The edit distance takes the square of the length, which very long runs of letters cannot afford.
    short = chunks.where(F.col("sa") <= LONG).join(grams, met & near & (F.levenshtein("a", "b", 1) == 1))
    long = chunks.where(F.col("sa") > LONG).join(grams.where(F.char_length("b") > LONG), met & near & _one_edit())
    return short.unionByName(long).select("a", "na", "b", "nb").distinct()


def forms(words: DataFrame) -> DataFrame:
    """word, n, n_near, form and form_n of ``words`` (word, n); no word is left out."""
    pairs = near_pairs(words)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m"))))
    told = pairs.select(both.alias("x")).select("x.*")
    best = told.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "near")).alias("best"))
    out = words.join(best, "word", "left")
    follows = -F.col("best.minus") >= RATIO * F.col("n")
    return out.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(follows, F.col("best.near")).alias("form"), F.when(follows, -F.col("best.minus")).alias("form_n")
    )


def with_roots(found: DataFrame) -> DataFrame:
    """``found`` (with word and form) and root, the end of the chain of forms.

    Counts grow tenfold a step, so a chain has at most 18 steps; a round doubles what it follows.
    """
    links = cut_lineage(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = cut_lineage(moved)
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``vocabulary``.

    form is the near word with the largest count (of equal ones the smallest in code-point order), if that is at
    least ten times the word's own; root follows forms to the last. Null texts have no words; a null doc_id stands for
    an empty one in the hash; equal rows count each. An empty table gives none. Other columns are not read. A text
    of any length is one array of words in one task.
    """
    found = cut_lineage(forms(cut_lineage(vocabulary(docs, damage))))
    return with_roots(found).select("word", "form", "root", "n", "n_near", "form_n")
