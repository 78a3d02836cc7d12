"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from penstock.operators.joins import small_side

NO_ID = -(1 << 63)
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_documents(docs: DataFrame, *more: Column) -> DataFrame:
    """`(_doc, _alt, text, more…)`: a key for each different row of `doc_id` and `text`, and a total order of rows.

    `_doc` is the id, or the least whole number where it is null. `_alt` is 0, but where several rows share an id it is
    the fingerprint of the text. Rows that repeat both id and text share a key.
    """
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    base = docs.select(ident.alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)
    repeated = small_side(base.groupBy("_doc").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    if repeated.isEmpty():
        return base.withColumn("_alt", F.lit(0).cast("long"))
    return base.join(repeated, "_doc", "left").withColumn(
        "_alt", F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.xxhash64("text"))
    ).drop("_n")


def doc_id() -> Column:
    """The id back from `_doc`."""
    return F.when(F.col("_doc") != F.lit(NO_ID), F.col("_doc")).alias("doc_id")


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel in Arrow batches of at most `BATCH_ROWS` rows, which bounds both sides' buffers."""
    if not 0 < int(spark.conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def in_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, np.ndarray | pa.Array] | None], schema: str) -> DataFrame:
    """`mapInArrow` over batches of bounded rows; `work` gives the columns of its result, by name."""
    names = StructType.fromDDL(schema).names
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                found = work(batch.slice(at, BATCH_ROWS))
                if found is not None:
                    yield pa.record_batch([pa.array(found[n]) for n in names], names)

    return df.mapInArrow(run, schema)


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `text` replaced by `_z`, its bytes under zstd: a third of the bytes for a shuffle of whole texts."""
    others = [c for c in docs.columns if c != text]
    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others), "_z binary"])

    def work(batch: pa.RecordBatch):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        out = {c: batch.column(c) for c in others}
        out["_z"] = pa.array([squeeze((t or "").encode()) for t in batch.column(text).to_pylist()], pa.binary())
        return out

    return in_arrow(docs.select(*others, text), work, schema)


def unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def tasks_for(spark: SparkSession) -> int:
    """Partitions for a shuffle that Python reads, which adaptive execution cannot split."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
