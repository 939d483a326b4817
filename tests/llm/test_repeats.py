import random

import pytest

from millrace.llm import repeats

from .brute import substring_dedup
from .conftest import as_bag, frame


def result(df):
    return as_bag(df.select("doc_id", "n_words", "n_removed", "kept_sha256"))


@pytest.mark.parametrize("window", [5, 35])
def test_odd_rows(odd, odd_rows, window):
    assert result(repeats.remove_repeats(odd, window)) == substring_dedup(odd_rows, window)


def test_many_blocks_runs_and_overlaps(spark):
    r = random.Random(3)
    rows = []
    passage = [f"p{i}" for i in range(50)]
    for i in range(120):
        w = [r.choice("abcde") for _ in range(r.randint(0, 80))]
        if i % 7 == 0:
            w[5:5] = ["run"] * r.randint(20, 60)
        if i % 3 == 0:
            at = r.randint(0, len(w))
            w[at:at] = passage[r.randint(0, 10) :]
        if i % 11 == 0:
            w = ["x", "y"] * 40
        rows.append((i, " ".join(w), "s"))
    assert result(repeats.remove_repeats(frame(spark, rows).repartition(4), 35, block_bytes=300)) == substring_dedup(rows, 35)


def test_spans_cover_what_is_removed(odd):
    for row in repeats.remove_repeats(odd, 20).collect():
        assert sum(s["last"] - s["first"] + 1 for s in row["removed"]) == row["n_removed"]


def test_empty_table(nothing):
    assert repeats.remove_repeats(nothing).collect() == []
