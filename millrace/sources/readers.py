"""Sources. Each returns a lazy DataFrame; schemas are inferred once, where they are read."""

from __future__ import annotations

import csv
import json
import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.semantics import col, nan_to_null
from millrace.operators.joins import small_side


def read_csv(
    spark: SparkSession,
    path,
    sep: str = ",",
    encoding: str = "utf-8",
    skip_rows: int = 0,
    schema=None,
    multi_line: bool = False,
    escape: str = '"',
) -> DataFrame:
    """CSV with header. ``skip_rows`` leaves out that many lines before the header of every file.

    ``multi_line`` allows line breaks in quotes; a file is then read by one task. With ``skip_rows`` all files are
    taken to have the header and the empty lines above it of the first one, and skipped lines follow the rules of
    quotes too. A quote inside quotes is doubled, or follows another ``escape``.
    """
    if encoding.lower() in ("cp1252", "windows-1252"):
        # Spark does not decode it, but reads latin-1, which differs in 32 characters only
        return _western(read_csv(spark, path, sep, "iso-8859-1", skip_rows, schema, multi_line, escape))
    encoding = {"latin-1": "iso-8859-1", "latin1": "iso-8859-1"}.get(encoding.lower(), encoding)
    reader = spark.read.options(sep=sep, encoding=encoding, nanValue="NaN", multiLine=multi_line, escape=escape, header=not skip_rows)
    if not skip_rows:
        reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
        return nan_to_null(reader.csv(path))
    if schema is not None:
        return nan_to_null(_without_head(reader.schema(schema).csv(path), _records_above(spark, path, skip_rows, encoding) + 1))
    above = _records_above(spark, path, skip_rows, encoding)
    header = _first_lines(spark, path, above + 1, encoding)[above:]
    names = _header_names(next(csv.reader(header, delimiter=sep, doublequote=escape == '"', escapechar=None if escape == '"' else escape), []))
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return nan_to_null(_usual_types(_without_head(reader.schema(text).csv(path), above + 1)))


def _header_names(names: Sequence[str]) -> list[str]:
    """Column names as the CSV source makes them: places for empty names, places added to repeated ones."""
    folded = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if folded.count(n.lower()) > 1 else n for i, n in enumerate(names)]


#: Types that a column of texts may turn out to have, in the order in which they are tried.
USUAL_TYPES = ("int", "bigint", "double", "date", "timestamp", "boolean")


def _usual_types(df: DataFrame) -> DataFrame:
    """Text columns with the first of the usual types that all their values have; one aggregate."""
    known = [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    fits = [F.count(col(c).try_cast(t)).alias(f"{t}{i}") for i, c in enumerate(df.columns) for t in USUAL_TYPES]
    got = df.agg(*known, *fits).first() if df.columns else {}
    kinds = {c: next((t for t in USUAL_TYPES if got[f"n{i}"] and got[f"{t}{i}"] == got[f"n{i}"]), "string") for i, c in enumerate(df.columns)}
    return df.select(*(col(c).try_cast(kinds[c]).alias(c) for c in df.columns))


def _western(df: DataFrame) -> DataFrame:
    """Text read as latin-1 to what it says in cp1252."""
    codes = bytes(range(0x80, 0xA0))
    pairs = [(chr(c), bytes([c]).decode("cp1252", "ignore")) for c in codes]
    old, new = zip(*[(a, b) for a, b in pairs if b])
    table = str.maketrans("".join(old), "".join(new))
    fixed = {
        f.name: F.translate(col(f.name), "".join(old), "".join(new))
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType)
    }
    out = df.withColumns(fixed) if fixed else df
    return out.toDF(*[c.translate(table) for c in out.columns])


def _lines(spark: SparkSession, path, encoding: str) -> DataFrame:
    """Lines in ``value``. The CSV source decodes any encoding, which the text source does not."""
    whole = {"encoding": encoding, "sep": "\u0001", "quote": "", "escape": "", "header": False}
    return spark.read.options(**whole).schema("value string").csv(path)


def _without_head(rows: DataFrame, n: int) -> DataFrame:
    """Drop the first ``n`` records of every file.

    Records of a file's first block come in order in one task, so their running ids follow each other; the least id
    of each file tells where its head ends. Both scans cut the files alike, and files stay splittable.
    """
    at = rows.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"))
    at = at.withColumn("__id", F.monotonically_increasing_id())
    first = at.where("__start = 0").groupBy(F.col("__path").alias("__file")).agg(F.min("__id").alias("__first"))
    both = at.join(small_side(first), F.col("__path") == F.col("__file"), "left")
    return both.where(F.col("__first").isNull() | (F.col("__start") > 0) | (F.col("__id") >= F.col("__first") + n)).select(*(col(c) for c in rows.columns))


def _records_above(spark: SparkSession, path, skip_rows: int, encoding: str) -> int:
    """How many of the first lines are records: the CSV source leaves empty lines out."""
    if encoding.lower().startswith(("utf-16", "utf-32")):
        return skip_rows
    lines = spark.read.text(path).where("_metadata.file_block_start = 0").limit(skip_rows).collect()
    return sum(bool(r["value"].strip()) for r in lines)


def _first_lines(spark: SparkSession, path, n: int, encoding: str) -> list[str]:
    lines = _lines(spark, path, encoding).where("_metadata.file_block_start = 0")
    return [r["value"] for r in lines.limit(n).collect()]


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def read_json(spark: SparkSession, path, lines: bool = False, schema=None) -> DataFrame:
    """JSON records: an array or object per file, or one object per line (splittable)."""
    reader = spark.read.option("multiLine", not lines)
    return nan_to_null((reader.schema(schema) if schema else reader).json(path))


def read_text(spark: SparkSession, path) -> DataFrame:
    """Text as CSV if it parses to more than one column, else one row per file in ``text``.

    The first line tells, as for the CSV source, which would open every file to infer types before that.
    """
    lines = spark.read.text(path)
    first = lines.where(F.length(F.trim("value")) > 0).first()
    if first is not None:
        head = spark.range(0, 1, 1, 1).select(F.schema_of_csv(F.lit(first["value"]), {"escape": '"'})).first()[0]
        if len(T.DataType.fromDDL(head).fields) + len(lines.columns) > 2:
            return nan_to_null(spark.read.options(header=True, inferSchema=True, escape='"').csv(path))
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


READERS = {
    ".csv": read_csv,
    ".tsv": lambda s, p: read_csv(s, p, sep="\t"),
    ".parquet": read_parquet,
    ".json": read_json,
    ".jsonl": lambda s, p: read_json(s, p, lines=True),
    ".txt": read_text,
}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if ending not in READERS:
        raise ValueError(f"no reader for {ending!r}")
    return READERS[ending](spark, path)


def load_files(spark: SparkSession, paths: Sequence[str], registry=None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Many files, each on its own: tables by file stem, and a report of what failed and why."""
    tables, rows = {}, []
    for path in paths:
        name = os.path.splitext(os.path.basename(path.rstrip("/")))[0]
        try:
            tables[name] = read_any(spark, path)
            if registry is not None:
                registry.add(name, tables[name])
            rows.append((name, path, True, len(tables[name].columns), None))
        except Exception as e:  # one broken file must not stop the others
            rows.append((name, path, False, None, str(e).splitlines()[0][:300]))
    schema = "dataset string, path string, success boolean, columns int, error string"
    return tables, spark.createDataFrame(rows, schema)


#: JDBC drivers by dialect.
DIALECTS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "sqlite": "org.sqlite.JDBC",
}


def jdbc_options(url: str, query: str, partition: dict | None = None) -> dict[str, str]:
    """Options of a JDBC read. ``partition`` (column, lower, upper, parts) splits it into parallel range reads."""
    dialect = url.split(":")[1] if url.startswith("jdbc:") else ""
    options = {"url": url}
    if dialect in DIALECTS:
        options["driver"] = DIALECTS[dialect]
    if partition:
        options.update(
            dbtable=f"({query}) q",
            partitionColumn=partition["column"],
            lowerBound=str(partition["lower"]),
            upperBound=str(partition["upper"]),
            numPartitions=str(partition["parts"]),
        )
    else:
        options["query"] = query
    return options


def read_sql(spark: SparkSession, url: str, query: str, partition: dict | None = None) -> DataFrame:
    """Run a query at a database and load its result."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query, partition)).load()


def documents(source: DataFrame, criteria: str | dict = "{}", limit: int | None = None) -> DataFrame:
    """Documents whose fields equal ``criteria``, ``_id`` as text; with ``limit`` the first ones by ``_id``.

    ``source`` is any collection read as a DataFrame (a connector or a JSON dump),
    which gets filter and limit pushed down where it can.
    """
    wanted = json.loads(criteria) if isinstance(criteria, str) else criteria
    out = source
    for field, value in wanted.items():
        path = F.col(".".join(f"`{p}`" for p in field.split(".")))
        out = out.where(path.isNull() if value is None else path == F.lit(value))
    if limit is not None:
        out = (out.orderBy(col("_id")) if "_id" in out.columns else out).limit(limit)
    return out.withColumn("_id", col("_id").cast("string")) if "_id" in out.columns else out


def explode_payloads(df: DataFrame, column: str, path: str = "", schema: str | None = None) -> DataFrame:
    """JSON payloads to rows: go down a dotted path, a list gives many rows, an object one.

    With ``schema`` (DDL of one record) no pass over the data is needed; else it is inferred. A payload
    without the path, or with a bare value there, raises.
    """
    steps = "".join(f"['{p}']" for p in path.split(".")) if path else ""
    found = F.get_json_object(col(column), "$" + steps) if path else col(column)
    kind = F.substring(F.ltrim(found), 1, 1)
    checked = F.when(kind.isin("[", "{"), found).otherwise(
        F.raise_error(F.concat(F.lit("no list or object under path '"), F.lit(path), F.lit("'")))
    )
    listed = F.when(kind == "[", checked).otherwise(F.concat(F.lit("["), checked, F.lit("]")))
    texts = df.select(F.explode(F.from_json(listed, "array<string>")).alias("record"))
    if schema is None:
        found = texts.agg(F.schema_of_variant_agg(F.try_parse_json("record"))).first()[0]
        if not found.startswith("OBJECT<"):
            return texts.select()
        schema = _plain_types(found)
    return texts.select(F.from_json("record", schema).alias("r")).select("r.*")


def _plain_types(schema: str) -> str:
    """The schema of variants as a struct: decimals are doubles, what is unknown or mixed is text. Quoted names stay."""
    parts = schema.split("`")
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"\bOBJECT<", "STRUCT<", re.sub(r"\bDECIMAL\(\d+, ?\d+\)", "DOUBLE", re.sub(r": (VOID|VARIANT)\b", ": STRING", parts[i])))
        parts[i] = re.sub(r"<(VOID|VARIANT)>", "<STRING>", parts[i])
    return "`".join(parts)


def from_raw(spark: SparkSession, raw: str, fmt: str, sep: str = ",") -> DataFrame:
    """Pasted text: JSON array or object, CSV with header, or plain lines in ``text``.

    The text comes from a form, so it is small and already on the driver.
    """
    if fmt == "json":
        data = json.loads(raw)
        records = data if isinstance(data, list) else [data]
        lines = spark.createDataFrame([(json.dumps(x),) for x in records], "value string")
        return nan_to_null(spark.read.json(lines.rdd.map(lambda r: r[0])))
    rows = [(line,) for line in raw.strip("\n").split("\n")]
    if fmt == "csv":
        lines = spark.createDataFrame(rows, "value string").coalesce(1)
        return nan_to_null(spark.read.options(header=True, inferSchema=True, sep=sep, escape='"').csv(lines.rdd.map(lambda r: r[0])))
    return spark.createDataFrame(rows, "text string")
