"""Sinks, the dataset registry, session snapshots and the lineage table."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.semantics import nested_to_text

HISTORY = "timestamp timestamp_ntz, operation string, description string, parameters map<string,string>, status string"


def export(df: DataFrame, folder: str, name: str, fmt: str, stamp: datetime | None = None) -> str:
    """Write ``<folder>/<name>_<time>.<fmt>`` as csv, json or parquet, in parallel; returns the path."""
    stamp = stamp or datetime.now()
    path = f"{folder}/{name}_{stamp:%Y%m%d_%H%M%S}.{fmt}"
    if fmt == "csv":
        nested_to_text(df).write.csv(path, header=True, escape='"')
    elif fmt == "json":
        df.write.json(path)
    elif fmt == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return path


def export_powerbi(df: DataFrame, folder: str, name: str) -> str:
    """CSV with ISO dates for BI tools (which load a folder of parts): ``<name>_powerbi.csv``."""
    path = f"{folder}/{name}_powerbi.csv"
    formats = {"dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    nested_to_text(df).write.options(**formats).csv(path, header=True, escape='"')
    return path


def export_filtered(df: DataFrame, filters, path: str) -> None:
    """The rows that pass the filters, as CSV."""
    from millrace.operators.charts import apply_filters

    nested_to_text(apply_filters(df, filters)).write.csv(path, header=True, escape='"')


class Registry:
    """Named tables as temporary views; the last one added is current."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.current: str | None = None

    def add(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)
        self.tables[name] = df
        self.current = name

    def get(self, name: str | None = None) -> DataFrame:
        return self.tables[name or self.current]

    def columns(self, name: str) -> list[str]:
        return self.tables[name].columns

    def info(self) -> DataFrame:
        """Rows, columns and estimated bytes per table."""
        from functools import reduce

        from millrace.operators.validation import byte_estimate

        parts = [
            df.agg(F.count(F.lit(1)).alias("rows"), byte_estimate(df).alias("bytes")).select(
                F.lit(n).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns"), "bytes"
            )
            for n, df in self.tables.items()
        ]
        return reduce(DataFrame.unionByName, parts)

    def save(self, folder: str, history: DataFrame | None = None, models=(), preferences=None) -> None:
        """One Parquet folder per table, plus a manifest."""
        for n, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/tables/{n}")
        if history is not None:
            history.write.mode("overwrite").parquet(f"{folder}/history")
        manifest = {
            "tables": list(self.tables),
            "current": self.current,
            "models": list(models),
            "preferences": preferences or {},
            "history": history is not None,
        }
        row = self.spark.createDataFrame([(json.dumps(manifest),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> tuple["Registry", dict]:
        manifest = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
        out = cls(spark)
        for n in manifest["tables"]:
            out.add(n, spark.read.parquet(f"{folder}/tables/{n}"))
        out.current = manifest["current"]
        return out, manifest


# --- lineage ----------------------------------------------------------------------------------


def history_row(spark: SparkSession, operation, description, parameters=None, status="success", at=None) -> DataFrame:
    params = {k: str(v) for k, v in (parameters or {}).items()}
    return spark.createDataFrame([(at or datetime.now(), operation, description, params, status)], HISTORY)


class History:
    """Append-only table of the steps taken, on shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self, operation: str, description: str, parameters: dict | None = None, status: str = "success", at=None):
        row = history_row(self.spark, operation, description, parameters, status, at)
        row.coalesce(1).write.mode("append").parquet(self.path)

    def steps(self) -> DataFrame:
        try:
            return self.spark.read.schema(HISTORY).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], HISTORY)
            raise

    def clear(self) -> None:
        self.spark.createDataFrame([], HISTORY).write.mode("overwrite").parquet(self.path)

    def export(self, path: str, fmt: str) -> None:
        steps = self.steps()
        steps.write.json(path) if fmt == "json" else nested_to_text(steps).write.csv(path, header=True, escape='"')


def filter_history(steps: DataFrame, operation=None, status=None, start=None, end=None) -> DataFrame:
    out = steps
    if operation is not None:
        out = out.where(F.col("operation") == operation)
    if status is not None:
        out = out.where(F.col("status") == status)
    if start is not None:
        out = out.where(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
    return out


def summarise_history(steps: DataFrame) -> DataFrame:
    """Total, successful and failed steps, distinct operations, first and last time, seconds between."""
    out = steps.agg(
        F.count(F.lit(1)).alias("total_steps"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") != "success").alias("failed"),
        F.count_distinct("operation").alias("operations"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
    )
    seconds = F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
    return out.withColumn("duration_seconds", seconds / 1e6)


def operation_frequency(steps: DataFrame) -> DataFrame:
    return steps.groupBy("operation").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "operation")


def recent_steps(steps: DataFrame, n: int = 20) -> DataFrame:
    return steps.orderBy(F.desc("timestamp"), "operation", "description").limit(n)


def transformer_params(fitted: dict) -> list[dict]:
    """Fitted scalers or detectors as plain records ``{column, type, params}``, for JSON."""
    out = []
    for c, t in fitted.items():
        values = dict(vars(t))
        values.pop("column")
        out.append({"column": c, "type": values.pop("method"), "params": values})
    return out


def save_transformers(spark: SparkSession, fitted: dict, path: str) -> None:
    rows = [(r["column"], r["type"], json.dumps(r["params"])) for r in transformer_params(fitted)]
    table = spark.createDataFrame(rows, "column string, type string, params string")
    table.coalesce(1).write.mode("overwrite").json(path)


def load_scalers(spark: SparkSession, path: str) -> dict:
    from millrace.operators.scaling import Scaler

    out = {}
    for row in spark.read.schema("column string, type string, params string").json(path).collect():
        params = json.loads(row["params"])
        params["quantiles"] = tuple(params["quantiles"])
        out[row["column"]] = Scaler(row["column"], row["type"], **params)
    return out
