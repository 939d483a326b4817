import corpus_pipeline
from millrace.llm import mixing

from .brute import leaks
from .test_near import brute as near_groups

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = {r["doc_id"] for r in docs.collect()}
        gone = {r[0] for r in before} - after
        if name != "mixing":
            assert docs.columns == columns
        if name == "quality":
            assert {k for k in gone if labels.get(k) == 1} == set() and sum(labels.get(k) == 0 for k in gone) >= 0.9 * sum(q == 0 for q in labels.values())
        elif name == "exact_dedup":
            texts = {"".join(t.split()) for _, t, _ in before}
            assert len(after) == len(texts)
        elif name == "near_dedup":
            assert after == {d for d, _, least in near_groups(before) if d == least}
        elif name == "decontamination":
            assert after == {r[0] for r in leaks(before, items) if not r[5]}
        else:
            assert not gone and docs.count() == len(before)
            want = mixing.mix(docs.drop("source_offset", "block", "slot"))
            assert want.select("doc_id", "slot").exceptAll(docs.select("doc_id", "slot")).isEmpty()


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and {"doc_id", "text", "slot", "block", "source_offset"} <= set(rows[0].asDict())
