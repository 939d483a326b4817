"""The queries of the numbered operators and the pipeline, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact, leaks, licenses, minhash, mixing, near, oracles, quality, repair, repeats, scoring, spelling, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


BLANKS = r"[\x20\x09-\x0D]"


@query(
    "op1_substring_dedup",
    rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANKS}+'), lambda x: x <> '') AS ws FROM documents),
x AS (SELECT r, i, list_slice(ws, i, i + 34) AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
d AS (SELECT r, i FROM x WHERE win IN (SELECT win FROM x GROUP BY win HAVING count(*) > 1)),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM d),
s AS (SELECT r, list(p) AS gone FROM g GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN s USING (r)""",
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents")).drop("removed")


@query(
    "op2_exact_dedup",
    rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '{BLANKS}', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS nth, count(*) OVER (PARTITION BY text_sha256) AS n
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, nth = 1 AS kept, text_sha256 FROM r""",
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return exact.groups(table(spark, folder, "documents"))


@query("op3_token_counts")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count(table(spark, folder, "documents"), tokens.from_sentencepiece())


@query("op4_quality")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))
    return scored.withColumn("keep", F.coalesce(F.col("tail") >= quality.KEEP_FROM, F.lit(True)))


NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _word_lists(table_name: str, key: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT row_number() OVER () AS r, {key}, list_filter(regexp_split_to_array({lower}, '{NOT_WORDS}'), lambda x: x <> '') AS ws FROM {table_name}"


@query(
    "op5_decontamination",
    f"""
WITH d AS ({_word_lists("documents", "doc_id")}), b AS ({_word_lists("benchmark", "item_id")}),
w AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_slice(ws, i, i + 9) AS win
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
n AS (SELECT DISTINCT len(win) AS n FROM w),
x AS (SELECT r, n, i, list_slice(ws, i, i + n - 1) AS win FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, n)),
h AS (SELECT r, n, i, item FROM x JOIN w USING (win)),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
q AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)""",
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
    return found.select("doc_id", *leaks.digest())


@query("op6_mixing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query("op7_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    lexicon = toxicity.learn(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, lexicon).select("doc_id", toxicity.held_out(5, 0).alias("held_out"), "score", "predicted", "n_matches")


@query("op8_simhash")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return near.clusters(table(spark, folder, "documents"))


@query("op9_lm_scoring")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score(table(spark, folder, "documents"))


@query("op10_licenses")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op11_minhash", oracles.MINHASH)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.clusters(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op12_spelling_variants", oracles.SPELLING)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


@query("op13_conversations", oracles.CONVERSATIONS)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, folder, "conversations")))


QUERIES["pipeline"] = corpus_pipeline.run
