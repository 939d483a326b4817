import numpy as np

from millrace.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


def test_folding():
    words = toxicity.fold("1D10T ѕtuрid Ｌoser ÉCLAIR".encode())
    assert words == toxicity.fold("idiot stupid loser éclair".encode())
    assert toxicity.fold_accents(words) == toxicity.fold(b"idiot stupid loser eclair") and toxicity.fold_accents(words[:3]) is None
    assert toxicity.fold_marks(b"an id!ot, $ 5!") == b"an idiot, $ 5!"


def test_matches_against_brute_force():
    lexicon = toxicity.Lexicon({b" abc": 2.0, b" abcd ": 3.0, b" xy ": 1.0}, ["xy zed"])
    for text in ("abcd xy", "abc xy zed", "zabc abcde", "", "xy xy zed xy"):
        words = toxicity.fold(text.encode())
        want = 0.0
        for i, w in enumerate(words):
            best = 3.0 if w == b"abcd" else 2.0 if w.startswith(b"abc") else 0.0
            best = max(best, 1.0 if w == b"xy" and words[i + 1 : i + 2] != [b"zed"] else 0.0)
            want += best
        assert lexicon.measure(text.encode())[0] == want


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels)
    scored = toxicity.score(docs, lexicon).where(toxicity.held_out(5, 0)).join(labels, "doc_id").collect()
    hit = [r["predicted"] for r in scored if r["toxic"] == 1]
    false = [r["predicted"] for r in scored if r["toxic"] == 0]
    assert len(hit) > 50 and np.mean(hit) > 0.85 and np.mean(false) < 0.01


def test_odd_rows_and_no_labels(spark, odd, odd_rows, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.learn(odd, none)
    scored = toxicity.score(odd, lexicon).collect()
    assert len(scored) == len(odd_rows) and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in scored)
    some = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(28)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.learn(odd, some)).count() == len(odd_rows)
    assert toxicity.score(nothing, lexicon).collect() == []


def test_held_out_rows_teach_nothing(spark, odd):
    every = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    ids = {r["doc_id"] for r in every.where(~toxicity.held_out(5, 0)).collect()}
    assert 0 < toxicity.sample(odd, every).count() <= odd.where("doc_id < 40").where(~toxicity.held_out(5, 0)).count() and 0 < len(ids) < 40
