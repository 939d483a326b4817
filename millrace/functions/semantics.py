"""Column expressions that follow dataframe semantics where Spark's own differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity)\s*$"
ISO_DATE_PREFIX = r"^\d{4}-\d{2}-\d{2}"
DATE_TEXT = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*$"
#: The words read as booleans.
TRUE_WORDS = ["true", "1", "yes"]
FALSE_WORDS = ["false", "0", "no"]

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def quoted(name: str) -> str:
    """A column name that survives dots and backticks."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def dtype_name(dtype: T.DataType) -> str:
    """The dataframe-style type name used in reports."""
    if isinstance(dtype, INTEGRAL):
        return "int64"
    if isinstance(dtype, FRACTIONAL):
        return "float64"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, TEMPORAL):
        return "datetime64[ns]"
    return "object"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Ingest rule: a NaN is a missing value."""
    fixes = {
        f.name: F.when(~F.isnan(col(f.name)), col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    return df.withColumns(fixes) if fixes else df


def nested_to_text(df: DataFrame) -> DataFrame:
    """Arrays, structs and maps as JSON text, so that rows can be grouped and compared."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, NESTED)]
    return df.withColumns({c: F.to_json(col(c)) for c in nested}) if nested else df


def to_number(c: Column) -> Column:
    """Text to double; whatever is not a plain number becomes null."""
    text = c.cast("string")
    return F.when(F.lower(text).rlike(NUMERIC_TEXT), F.trim(text).try_cast("double"))


def to_moment(c: Column) -> Column:
    """ISO date or date-time text to a timestamp without zone, else null."""
    text = c.cast("string")
    return F.when(text.rlike(DATE_TEXT), F.trim(text).try_cast("timestamp_ntz"))


def to_flag(c: Column) -> Column:
    """Boolean words to booleans; unknown words become null."""
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest.

    ``initcap`` splits on blanks only, so ``O'NEIL`` needs its letter runs cut first.
    """
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"))
    return F.array_join(F.transform(runs, F.initcap), "")


def collapse_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clip(c: Column, low, high) -> Column:
    """Bound a value and keep nulls (``greatest``/``least`` would skip them)."""
    out = c
    if high is not None:
        out = F.when(c > F.lit(high), F.lit(high)).otherwise(out)
    if low is not None:
        out = F.when(c < F.lit(low), F.lit(low)).otherwise(out)
    return out


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; null below three values, 0 for a constant column."""
    n = F.count(c).cast("double")
    corrected = F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(corrected))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values, 0 for a constant column."""
    n = F.count(c).cast("double")
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n >= 4, F.when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(corrected))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGRAL + FRACTIONAL)]


def text_columns(df: DataFrame, booleans: bool = False) -> list[str]:
    kinds = (T.StringType, T.BooleanType) if booleans else (T.StringType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TEMPORAL)]


def column_groups(df: DataFrame) -> dict[str, list[str]]:
    return {"numeric": numeric_columns(df), "categorical": text_columns(df), "datetime": temporal_columns(df)}


def small_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A result with one row per column, check or model: already computed, bounded by the schema."""
    return spark.createDataFrame(rows, schema)
