"""Stage materialisation: tables written once to shared storage and read back.

A written table survives the loss of executors and cuts the lineage, and later passes read only the
columns they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from penstock.session import scratch_path


def stage(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write `df` to the shared scratch folder and return the table read back."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when the job that wrote the table at `path` has committed it."""
    files, folder = _path(spark, path)
    return files.exists(folder.suffix("/_SUCCESS"))


def clear(spark: SparkSession, path: str) -> None:
    """Delete a stage, so that the next run writes it again."""
    files, folder = _path(spark, path)
    files.delete(folder, True)


def materialize(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Write-once stage: skipped when the table is already there, rewritten with `force`."""
    spark = df.sparkSession
    if force or not is_complete(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


QUARTET = ("x_train", "x_test", "y_train", "y_test")


def save_quartet(tables: dict[str, DataFrame], folder: str, force: bool = False) -> dict[str, DataFrame]:
    """Persist features and labels of both splits; kept when all four exist, else all four are written."""
    spark = next(iter(tables.values())).sparkSession
    force = force or not all(is_complete(spark, f"{folder}/{name}") for name in QUARTET)
    return {name: materialize(tables[name], f"{folder}/{name}", force) for name in QUARTET}


def load_quartet(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Reload what `save_quartet` wrote."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in QUARTET}
