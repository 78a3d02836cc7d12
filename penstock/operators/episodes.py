"""Episodes: runs of consecutive flagged time steps, and range-based evaluation on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penstock.functions.decisions import ratio
from penstock.functions.timecols import floor_div
from penstock.operators.ordering import with_row_id


def with_episode(df: DataFrame, flag: str, step: str, name: str = "episode") -> DataFrame:
    """Flagged rows with the start of their run of consecutive steps.

    Among flagged rows `step - position` is constant inside a run, so the run is a group key, not a window:
    a run that holds a third of the table is aggregated like any other. `step` must be unique.
    """
    flagged = with_row_id(df.filter(F.col(flag) == 1), [step], "_position")
    return flagged.withColumn(name, F.col(step) - F.col("_position")).drop("_position")


def attack_table(df: DataFrame, label: str = "label", alarm: str = "alarm", step: str = "step") -> DataFrame:
    """`(start, end, duration, detected, latency, coverage)` per attack episode; latency NULL when missed."""
    runs = with_episode(df, label, step)
    first_alarm = F.min(F.when(F.col(alarm) == 1, F.col(step)))
    return runs.groupBy("episode").agg(
        F.min(step).alias("start"),
        F.max(step).alias("end"),
        F.count(F.lit(1)).alias("duration"),
        F.max(F.coalesce(F.col(alarm), F.lit(0))).cast("int").alias("detected"),
        (first_alarm - F.min(step)).alias("latency"),
        (F.count_if(F.col(alarm) == 1) / F.count(F.lit(1))).alias("coverage"),
    ).drop("episode")


def range_scores(df: DataFrame, label: str = "label", alarm: str = "alarm", step: str = "step") -> DataFrame:
    """`(attacks, attacks_detected, alarms, alarms_true, range_precision, range_recall, range_f1)`.

    An attack is detected when any of its steps alarms; an alarm range is true when it touches an attack.
    """
    attacks = with_episode(df, label, step).groupBy("episode").agg(F.max(alarm).alias("hit"))
    alarms = with_episode(df, alarm, step).groupBy("episode").agg(F.max(label).alias("hit"))
    hit = F.col("hit") == 1
    both = attacks.select("hit", F.lit(True).alias("attack")).unionByName(alarms.select("hit", F.lit(False).alias("attack")))
    both = both.agg(
        F.count_if(F.col("attack")).alias("attacks"),
        F.count_if(F.col("attack") & hit).alias("attacks_detected"),
        F.count_if(~F.col("attack")).alias("alarms"),
        F.count_if(~F.col("attack") & hit).alias("alarms_true"),
    )
    both = both.select(
        "*",
        ratio(F.col("alarms_true"), F.col("alarms")).alias("range_precision"),
        ratio(F.col("attacks_detected"), F.col("attacks")).alias("range_recall"),
    )
    p, r = F.col("range_precision"), F.col("range_recall")
    return both.withColumn("range_f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


# Fixed value: false alarms per hour above which operators stop listening.
ALARM_FATIGUE = 5


def false_alarms_per_hour(df: DataFrame, label: str = "label", alarm: str = "alarm", minute: str = "step") -> DataFrame:
    """`(hour, false_alarms, fatigue)` with the step in minutes."""
    false = (F.col(alarm) == 1) & (F.col(label) == 0)
    hours = df.groupBy(floor_div(minute, 60).alias("hour")).agg(F.count_if(false).alias("false_alarms"))
    return hours.withColumn("fatigue", (F.col("false_alarms") > ALARM_FATIGUE).cast("int"))
