"""A corpus from raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; run() writes what a
stage returns as Parquet to the folder of ``spark.checkpoint.dir`` and reads it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact, leaks, mixing, near, quality
from millrace.session import checkpoint_folder

#: SQL has neither the fitted classifier nor XXH64; the stages are tested one by one.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier expects to have the best grade; the others go."""
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose fingerprints are linked, with the setting of operator 8."""
    return near.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return leaks.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with block and slot, to be read by slot and source_offset."""
    return mixing.mix(docs, carry=tuple(docs.columns))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
