import random

import pytest

#: Extra columns whose names the operators use themselves.
CLASH = ["text_sha256", "kept_id", "bits", "block", "slot", "tail", "n_words", "items", "Key", "scored_text", "gone_id", "number.1"]


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def sentences(n: int, seed: int = 7, words: int = 60) -> list[str]:
    r = random.Random(seed)
    known = ["alpha", "beta", "Gamma,", "delta", "épsilon", "zeta.", "eta", "THETA", "日本", "x1"] + [f"w{i}" for i in range(80)]
    return [" ".join(r.choice(known) for _ in range(r.randint(1, words))) for _ in range(n)]


def odd_texts() -> list[tuple]:
    """(doc_id, text, source): nulls, empty and long texts, ties, repeated rows, copies with other blanks."""
    base = sentences(30)
    long = " ".join(sentences(60, 8))
    shared = " ".join(sentences(1, 9, 120) + sentences(3, 10, 60))
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100, None, "s0"), (101, "", None), (102, " \t\n ", "s1"), (None, base[0], "s2"), (None, None, None), (103, long, "s1"), (104, long, "s1")]
    rows += [(3, base[3], "s0"), (3, base[3], "s0"), (105, base[5].replace(" ", "\n\t"), "s2"), (106, base[6].upper(), None)]
    rows += [(110 + i, f"{t} {shared} {t}", "s2") for i, t in enumerate(base[:4])]
    return rows


def frame(spark, rows):
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in CLASH)
    return spark.createDataFrame([(*r, *range(len(CLASH))) for r in rows], schema)


@pytest.fixture(scope="session")
def odd_rows():
    return odd_texts()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


def as_bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


