"""Models of every kind on shared storage: Spark's own parts by their writers, tables as Parquet, the rest as JSON."""

from __future__ import annotations

import dataclasses
import importlib
import json

import numpy as np
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession


def _name(obj) -> str:
    return f"{type(obj).__module__}:{type(obj).__qualname__}"


def _class(name: str):
    module, _, qualified = name.partition(":")
    return getattr(importlib.import_module(module), qualified)


def _put(obj, path: str) -> dict:
    """Write what JSON cannot hold below ``path``; describe the rest."""
    if isinstance(obj, MLWritable):
        obj.write().overwrite().save(path)
        return {"kind": "spark", "class": _name(obj), "path": path}
    if isinstance(obj, DataFrame):
        obj.write.mode("overwrite").parquet(path)
        return {"kind": "table", "path": path}
    if isinstance(obj, np.ndarray):
        return {"kind": "array", "value": obj.tolist()}
    if dataclasses.is_dataclass(obj):
        fields = {f.name: _put(getattr(obj, f.name), f"{path}/{f.name}") for f in dataclasses.fields(obj)}
        return {"kind": "record", "class": _name(obj), "fields": fields}
    if isinstance(obj, (list, tuple)):
        return {"kind": type(obj).__name__, "items": [_put(x, f"{path}/{i}") for i, x in enumerate(obj)]}
    if isinstance(obj, dict):
        return {"kind": "dict", "items": [[_put(k, f"{path}/k{i}"), _put(v, f"{path}/v{i}")] for i, (k, v) in enumerate(obj.items())]}
    if isinstance(obj, np.generic):
        obj = obj.item()
    return {"kind": "value", "value": obj}


def _get(spark: SparkSession, what: dict, old: str, new: str):
    at = lambda p: new + p.removeprefix(old)  # noqa: E731  the folder may have moved
    kind = what["kind"]
    if kind == "spark":
        return _class(what["class"]).load(at(what["path"]))
    if kind == "table":
        return spark.read.parquet(at(what["path"]))
    if kind == "array":
        return np.array(what["value"])
    if kind == "record":
        return _class(what["class"])(**{k: _get(spark, v, old, new) for k, v in what["fields"].items()})
    if kind in ("list", "tuple"):
        items = [_get(spark, x, old, new) for x in what["items"]]
        return tuple(items) if kind == "tuple" else items
    if kind == "dict":
        return {_get(spark, k, old, new): _get(spark, v, old, new) for k, v in what["items"]}
    return what["value"]


def save(obj, path: str) -> None:
    """Write a trained model to a folder."""
    about = json.dumps({"root": path, "what": _put(obj, f"{path}/parts")})
    spark = SparkSession.getActiveSession()
    spark.range(1).selectExpr("CAST(NULL AS string) AS value").na.fill(about).coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str):
    """The model that ``save`` has written."""
    about = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
    return _get(spark, about["what"], about["root"], path)
