import numpy as np
import pytest

from millrace.llm import quality

FOLDER = "/root/testdata/sf0.01"


def test_graded_ratings_are_learned():
    r = np.random.default_rng(5)
    x = r.normal(size=(2000, 6))
    z = x @ np.array([2.0, -1.0, 0.5, 0, 0, 0]) + r.logistic(size=2000)
    y = np.digitize(z, [-2.0, 0.5, 2.0])
    model = quality.fit_ordinal(x, y)
    assert model.grades == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all()
    assert np.allclose(model.weights[:3], [2, -1, 0.5], atol=0.3) and np.allclose(model.thresholds, [-2, 0.5, 2], atol=0.3)
    tails = [model.tail(x, g) for g in range(5)]
    assert (tails[0] == 1).all() and (tails[4] == 0).all() and all((a >= b).all() for a, b in zip(tails, tails[1:]))
    assert np.allclose(model.expected(x), sum(tails[1:4]))


def test_gradient_is_that_of_the_likelihood():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(300, 2)), r.integers(0, 3, 300)
    model = quality.fit_ordinal(x, y)

    def loss(w, cuts):
        s = 1 / (1 + np.exp(-(np.array(cuts)[None, :] - (x @ w)[:, None])))
        cum = np.concatenate((np.zeros((300, 1)), s, np.ones((300, 1))), axis=1)
        return -np.log(cum[np.arange(300), y + 1] - cum[np.arange(300), y]).mean()

    best = loss(model.weights, model.thresholds)
    for step in (0.05, -0.05):
        assert loss(model.weights + [step, 0], model.thresholds) > best
        assert loss(model.weights, model.thresholds + [0, step]) > best
        assert loss(model.weights, model.thresholds + [step, 0]) > best


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    scored = quality.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    right = np.mean([(r["tail"] >= 0.5) == (r["quality"] == 1) for r in scored])
    assert len(scored) > 80 and right > 0.95


def test_odd_rows(spark, odd, odd_rows):
    ratings = spark.createDataFrame([(0, 1), (0, 0), (1, 2), (2, 0), (None, 1), (4, None), (999, 1), (5, 3)], "doc_id long, quality int")
    model = quality.fit(odd, ratings)
    assert model.grades == [0, 1, 2, 3]
    scored = quality.score(odd, model)
    assert scored.count() == len(odd_rows) and scored.where("tail is null or expected_grade not between 0 and 3").count() == 0
    kept = quality.keep_good(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)


@pytest.mark.parametrize("rows", [[], [(0, 1)], [(999, 1)]])
def test_few_ratings(spark, odd, nothing, rows):
    ratings = spark.createDataFrame(rows, "doc_id long, quality int")
    model = quality.fit(odd, ratings)
    scored = quality.score(odd, model).collect()
    assert len(scored) == odd.count() and quality.keep_good(odd, model).count() == len(scored)
    assert quality.score(nothing, model).collect() == []


def test_an_empty_text_has_features():
    assert np.isfinite(quality.features(b"")).all() and np.isfinite(quality.features(b"!" * 100_000)).all()
