"""Concept drift: each period against the training baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penstock.operators.joins import small_side
from penstock.operators.ordering import running_totals
from penstock.operators.selection import kolmogorov_tail


def drift_by_period(baseline: DataFrame, current: DataFrame, sensor: str, period: str, value: str) -> DataFrame:
    """`(sensor, period, n_baseline, n_current, d, p_value)`: Kolmogorov-Smirnov distance per period.

    The baseline is not copied for every period. It is turned once into running counts per (sensor, value), and
    readings of both sides are ordered together; the baseline count below a reading is then a running sum over the
    baseline rows of its sensor. The distance of a period is largest just at, or just before, one of its own values,
    so only its own values have to be looked at.
    """
    base = baseline.filter(F.col(value).isNotNull()).groupBy(sensor, value).agg(F.count(F.lit(1)).alias("base_n"))
    here = current.filter(F.col(value).isNotNull()).groupBy(sensor, period, value).agg(F.count(F.lit(1)).alias("n"))

    # Baseline count at and before every value that occurs on either side, once per (sensor, value).
    values = (
        base.select(sensor, value, "base_n")
        .unionByName(here.select(sensor, value, F.lit(0).cast("long").alias("base_n")))
        .groupBy(sensor, value).agg(F.sum("base_n").alias("base_n"))
    )
    placed = running_totals(values, [value], ["base_n"], [sensor])
    base_totals = small_side(base.groupBy(sensor).agg(F.sum("base_n").alias("n_baseline")))

    steps = running_totals(here, [value], ["n"], [sensor, period])
    totals = small_side(here.groupBy(sensor, period).agg(F.sum("n").alias("n_current")))
    joined = steps.join(placed, [sensor, value]).join(totals, [sensor, period]).join(base_totals, [sensor])
    at = F.abs(F.col("cum_base_n") / F.col("n_baseline") - F.col("cum_n") / F.col("n_current"))
    before = F.abs(
        (F.col("cum_base_n") - F.col("base_n")) / F.col("n_baseline") - (F.col("cum_n") - F.col("n")) / F.col("n_current")
    )
    found = joined.groupBy(sensor, period).agg(
        F.first("n_baseline").alias("n_baseline"), F.first("n_current").alias("n_current"), F.max(F.greatest(at, before)).alias("d")
    )
    scale = F.sqrt(F.col("n_baseline") * F.col("n_current") / (F.col("n_baseline") + F.col("n_current")))
    return found.withColumn("p_value", kolmogorov_tail(scale * F.col("d")))
