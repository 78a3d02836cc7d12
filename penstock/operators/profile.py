"""Aggregation and data-quality statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: rows, nulls, nans, infs, min, max, mean, var_samp, var_pop.

    Cells are aggregated by column position in one pass, with one partial row per column and task; the plan does not
    grow with the number of columns. NaN cells are left out of the moments.
    """
    cells = df.select(F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in cols])).alias("_at", "_x"))
    x = F.col("_x")
    real = F.when(~F.isnan(x), x)
    stats = cells.groupBy("_at").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(x.isNull()).alias("nulls"),
        F.count_if(F.isnan(x)).alias("nans"),
        F.count_if(F.abs(x) == float("inf")).alias("infs"),
        F.min(real).alias("min"),
        F.max(real).alias("max"),
        F.avg(real).alias("mean"),
        F.var_samp(real).alias("var_samp"),
        F.var_pop(real).alias("var_pop"),
    )
    return stats.select(F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_at") + 1).alias("feature"), *stats.columns[1:])


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """`(label, n, pct)`; the window runs over one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def null_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """`(null_cells)`: NULL and NaN cells over all columns, in one pass."""
    per_row = reduce(
        lambda a, b: a + b,
        [F.when(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double")), 1).otherwise(0) for c in cols],
    )
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).cast("long").alias("null_cells"))


def all_null_columns(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns without any value in either table."""
    empty: set[str] = set()
    for table in (train, test):
        filled = table.select(F.posexplode(F.array(*[F.col(f"`{c}`").isNotNull() for c in cols])).alias("_at", "_x"))
        rows = filled.groupBy("_at").agg(F.count_if("_x").alias("n")).filter("n = 0").collect()  # at most one per column
        empty |= {cols[r["_at"]] for r in rows}
    return [c for c in cols if c in empty]


def variance_summary(stats: DataFrame) -> DataFrame:
    """`(min_var, max_var, median_var)` over the per-column sample variances of `column_stats`."""
    return stats.agg(
        F.min("var_samp").alias("min_var"),
        F.max("var_samp").alias("max_var"),
        F.median("var_samp").alias("median_var"),  # one value per column
    )


# Fixed value: sample variance below which a feature is dropped (strictly).
LOW_VARIANCE = 0.001


def low_variance_columns(stats: DataFrame, threshold: float = LOW_VARIANCE) -> list[str]:
    """Features whose train sample variance is strictly below the threshold."""
    rows = stats.filter(F.col("var_samp") < threshold).select("feature").collect()  # at most one per column
    return sorted(r.feature for r in rows)


def matrix_stats(stats: DataFrame) -> DataFrame:
    """Mean, population std, min and max over all cells, combined from the per-column moments."""
    n = F.col("rows") - F.col("nulls") - F.col("nans")
    second = F.col("var_pop") + F.col("mean") * F.col("mean")
    mean = F.sum(n * F.col("mean")) / F.sum(n)
    return stats.agg(
        F.sum(n).alias("cells"),
        mean.alias("mean"),
        F.sqrt(F.greatest(F.sum(n * second) / F.sum(n) - mean * mean, F.lit(0.0))).alias("std"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )


def shape(df: DataFrame, stage: str) -> DataFrame:
    """`(stage, n_rows, n_columns)`."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(stage).alias("stage"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns")
    )


# Fixed value: attack rows needed for a test set to count as usable.
MIN_ATTACK_ROWS = 50


def readiness(checked: DataFrame) -> DataFrame:
    """Eight named checks as `(check, passed)` from one row of facts.

    `checked` holds: rows_loaded, leading_rows_left, denied_found, null_cells, low_variance_found,
    scaled_min, scaled_max, bad_cells, attack_rows.
    """
    checks = {
        "data_loaded": F.col("rows_loaded") > 0,
        "stabilization_removed": F.col("leading_rows_left") == 0,
        "deny_list_removed": F.col("denied_found") > 0,
        "missing_values_handled": F.col("null_cells") == 0,
        "low_variance_removed": F.col("low_variance_found") > 0,
        "scaler_fitted_on_train": (F.round("scaled_min", 9) >= 0) & (F.round("scaled_max", 9) <= 1),
        "data_quality_validated": F.col("bad_cells") == 0,
        "enough_attack_rows": F.col("attack_rows") >= MIN_ATTACK_ROWS,
    }
    rows = [
        F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).cast("int").alias("passed"))
        for name, ok in checks.items()
    ]
    return checked.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def removal_report(spark, denied: Sequence[str], empty: Sequence[str], low: Sequence[str], final: Sequence[str]) -> DataFrame:
    """`(reason, n_features)` for the feature-removal summary."""
    rows = [("deny_list", len(denied)), ("all_null", len(empty)), ("low_variance", len(low)), ("kept", len(final))]
    return spark.createDataFrame(rows, "reason string, n_features long")
