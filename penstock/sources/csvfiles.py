"""CSV scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts read as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header line. Give a schema for large files; without one the types are inferred in a second pass."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str], banner: bool = False) -> DataFrame:
    """All cells as text, missing tokens as NULL.

    With `banner` the first line of each file is a banner and the second the real header: the banner is skipped as
    the header line and the row that repeats the column names is filtered out.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.option("header", True).schema(schema).csv(path)
    if banner:
        names = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(c) for c in columns])
        raw = raw.filter(~names)
    return raw.select(*[_missing_to_null(c) for c in columns])


def _missing_to_null(name: str):
    c = F.col(f"`{name}`")
    return F.when(F.trim(c).isin(*MISSING_TOKENS), None).otherwise(c).alias(name)


def preview(df: DataFrame, rows: int) -> DataFrame:
    """The first rows, for looking at the schema."""
    return df.limit(rows)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line and no index column."""
    df.write.mode("overwrite").option("header", True).csv(path)
