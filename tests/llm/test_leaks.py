from millrace.llm import leaks

from .brute import alnum
from .brute import leaks as brute
from .conftest import as_bag, frame


def items_of(rows):
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 25]
    return [(i, " ".join(t.split()[3:20]).swapcase()) for i, t in enumerate(texts[:6])] + [(7, "alpha"), (8, None), (9, ""), (None, "THETA w1"), (7, "beta x1!"), (10, "never seen")]


def digest(df):
    return as_bag(df.select("doc_id", *leaks.digest()))


def test_odd_rows(spark, odd, odd_rows):
    items = spark.createDataFrame(items_of(odd_rows), "item_id long, text string")
    want = brute(odd_rows, items_of(odd_rows))
    assert digest(leaks.scan(odd, items, ["doc_id"])) == want
    assert any(r[5] for r in want)
    assert digest(leaks.scan(odd, items, ["doc_id"], limit=60)) == want  # several automata


def test_offsets_lead_to_the_original(spark):
    text = "Before: AAA bbb—ccc ddd, eee fff ggg hhh iii JJJ. After é."
    docs = frame(spark, [(1, text, "s")])
    items = spark.createDataFrame([(5, "aaa bbb—ccc ddd eee fff ggg hhh iii jjj")], "item_id long, text string")
    row = leaks.scan(docs, items, ["doc_id"]).first()
    (span,) = row["char_spans"]
    assert row["items"] == ["5"] and alnum(text[span["start"] : span["end"]]) == alnum("aaa bbb—ccc ddd eee fff ggg hhh iii jjj")


def test_clean_rows_stay(spark, odd, odd_rows):
    items = spark.createDataFrame(items_of(odd_rows), "item_id long, text string")
    kept = leaks.keep_clean(odd, items)
    want = sorted((r[0] for r in brute(odd_rows, items_of(odd_rows)) if not r[5]), key=repr)
    assert kept.columns == odd.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == want


def test_empty_tables(spark, odd, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks.scan(nothing, none).collect() == []
    assert leaks.keep_clean(odd, none).count() == odd.count()
