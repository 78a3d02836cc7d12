"""Confusion counts, ratios, ranking quality, thresholds and result-table reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstock.functions.decisions import ALARM_FROM, ESCALATE_ABOVE, ratio
from penstock.operators.ordering import quantiles, running_totals


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """`(by…, tn, fp, fn, tp)`; attack = 1 is positive, absent classes count 0."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    cells = {"tn": ~y & ~p, "fp": ~y & p, "fn": y & ~p, "tp": y & p}
    return df.groupBy(*by).agg(*[F.count_if(test).alias(prefix + name) for name, test in cells.items()])


def with_metrics(cells: DataFrame, prefix: str = "") -> DataFrame:
    """Add precision, recall, f1, accuracy and fp_rate (percent) to confusion counts."""
    tn, fp, fn, tp = (F.col(prefix + c) for c in ("tn", "fp", "fn", "tp"))
    return cells.select(
        "*",
        ratio(tp, tp + fp).alias(prefix + "precision"),
        ratio(tp, tp + fn).alias(prefix + "recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias(prefix + "f1"),
        ratio(tp + tn, tn + fp + fn + tp).alias(prefix + "accuracy"),
        (100.0 * ratio(fp, fp + tn)).alias(prefix + "fp_rate"),
    )


def escalation(df: DataFrame, escalated: Column, by: Sequence[str] = ()) -> DataFrame:
    """`(by…, n_rows, escalated, escalation_rate)`, the rate in percent of scored rows."""
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(escalated).alias("escalated"))
    return counted.withColumn("escalation_rate", 100.0 * ratio(F.col("escalated"), F.col("n_rows")))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """`(by…, roc_auc)`: exact rank statistic with average ranks for ties, 0.0 when a class is missing.

    Rows are counted per distinct score first, so the ordered pass sees each score once.
    """
    counts = df.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    ranked = running_totals(counts, [score], ["neg"], by)
    wins = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0)
    total = ranked.groupBy(*by).agg(F.sum(wins).alias("_wins"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return total.select(
        *by, F.when((F.col("_p") == 0) | (F.col("_n") == 0), 0.0).otherwise(F.col("_wins") / (F.col("_p") * F.col("_n"))).alias("roc_auc")
    )


def cascade_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edge-only beside cascade metrics and escalation counts, one pass over `(label, edge_class, final_class, escalated)`."""
    y, e, f = F.col("label") == 1, F.col("edge_class") == 1, F.col("final_class") == 1
    cells = {}
    for prefix, p in (("edge_", e), ("", f)):
        cells |= {prefix + "tn": ~y & ~p, prefix + "fp": ~y & p, prefix + "fn": y & ~p, prefix + "tp": y & p}
    cells["escalated"] = F.col("escalated")
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(test).alias(name) for name, test in cells.items()])
    both = with_metrics(with_metrics(counted, "edge_"))
    return both.select(
        "*", ((F.col("f1") - F.col("edge_f1")) * 100).alias("cascade_gain"),
        (100.0 * ratio(F.col("escalated"), F.col("n_rows"))).alias("escalation_rate"),
    )


def best_rows(results: DataFrame, by: Sequence[str], f1: str = "f1", then: Sequence[str] = ("edge_share",)) -> DataFrame:
    """Row with the best F1 in each group, the first one on ties. A result table has one row per experiment."""
    window = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.col(f1).desc(), *then)
    return results.withColumn("_r", F.row_number().over(window)).filter("_r = 1").drop("_r")


def spread_over_shares(results: DataFrame, by: Sequence[str] = ("config_name",)) -> DataFrame:
    """`(by…, mean_f1, std_f1, mean_escalation)` with the sample deviation."""
    return results.groupBy(*by).agg(
        F.avg("f1").alias("mean_f1"), F.stddev_samp("f1").alias("std_f1"), F.avg("escalation_rate").alias("mean_escalation")
    )


def compare_datasets(left: DataFrame, right: DataFrame, by: Sequence[str] = ("config_name",)) -> DataFrame:
    """Mean F1, deviation and escalation of two result tables side by side, with the absolute difference."""
    a, b = spread_over_shares(left, by), spread_over_shares(right, by)
    names = ("mean_f1", "std_f1", "mean_escalation")
    a = a.select(*by, *[F.col(n).alias(f"{n}_a") for n in names])
    b = b.select(*by, *[F.col(n).alias(f"{n}_b") for n in names])
    return a.join(b, list(by)).withColumn("f1_difference", F.abs(F.col("mean_f1_a") - F.col("mean_f1_b")))


# Columns of the short result table.
SUMMARY_COLUMNS = (
    "edge_share", "f1", "precision", "recall", "accuracy", "fp_rate", "escalation_rate",
    "escalate_above", "alarm_from", "model_size_mb", "score_rows_per_s",
)


def summary(results: DataFrame) -> DataFrame:
    """Projection of a result table (`run_grid`) to the short one, with the thresholds of the confirming cascade."""
    named = {"escalate_above": F.lit(ESCALATE_ABOVE), "alarm_from": F.lit(ALARM_FROM), "model_size_mb": F.col("edge_size_mb")}
    return results.select(*[named.get(c, F.col(c)).alias(c) for c in SUMMARY_COLUMNS])


def score_thresholds(validation: DataFrame, score: str = "score", base: float = 0.0) -> DataFrame:
    """`(rule, threshold)` from validation scores only: 99th percentile, maximum, base + maximum."""
    rows = quantiles(validation, score, [0.99, 1.0])
    p99 = F.max(F.when(F.col("prob") == 0.99, F.col("quantile")))
    top = F.max(F.when(F.col("prob") == 1.0, F.col("quantile")))
    one = rows.agg(p99.alias("p99"), top.alias("max_score"), (top + base).alias("base_plus_max"))
    return one.unpivot([], ["p99", "max_score", "base_plus_max"], "rule", "threshold")


def f1_curve(validation: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """`(score, tp, fp, fn, f1)` for the rule `score >= threshold` at every distinct score."""
    counts = validation.groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    total = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    below = running_totals(counts, [score], ["pos", "neg"])
    fn = F.col("cum_pos") - F.col("pos")
    tp, fp = F.lit(total["p"]) - fn, F.lit(total["n"]) - (F.col("cum_neg") - F.col("neg"))
    return below.select(
        F.col(score).alias("score"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def best_f1_threshold(validation: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row `(threshold, f1)`: best F1 on validation, the higher threshold on ties."""
    best = f1_curve(validation, label, score).agg(F.max(F.struct(F.round("f1", 12).alias("f1"), "score")).alias("b"))
    return best.select(F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"))


# Fixed value: F1 above which a leak is suspected.
SUSPICIOUS_F1 = 0.95


def leakage_audit(
    train: DataFrame, test: DataFrame, cols: Sequence[str], fitted: DataFrame, refit: DataFrame,
    boundary_windows: DataFrame, f1: DataFrame,
) -> DataFrame:
    """`(check, found, passed)` for duplicate rows, scaler scope, windows over the boundary and a too good F1.

    `fitted` is the scaler in use and `refit` the one fitted on train now; `boundary_windows` holds one row
    per window that uses both splits; `f1` is one row with the column `f1`.
    """
    keys = [F.col(c) for c in cols]
    # Distinct rows on both sides: a row copied very often is one key.
    a, b = train.select(*keys).distinct(), test.select(*keys).distinct()
    same = F.lit(True)
    for c in cols:
        same = same & a[c].eqNullSafe(b[c])
    shared = b.join(a, same, "left_semi").agg(F.count(F.lit(1)).cast("double").alias("found"))
    p, r = fitted.alias("p"), refit.alias("r")
    outside = p.join(r, F.col("p.feature") == F.col("r.feature")).agg(
        F.count_if((F.col("p.min") != F.col("r.min")) | (F.col("p.max") != F.col("r.max"))).cast("double").alias("found")
    )
    crossing = boundary_windows.agg(F.count(F.lit(1)).cast("double").alias("found"))
    checks = [
        ("duplicate_rows", shared, F.col("found") == 0),
        ("scaler_fitted_outside_train", outside, F.col("found") == 0),
        ("windows_over_boundary", crossing, F.col("found") == 0),
        ("suspicious_f1", f1.select(F.col("f1").alias("found")), F.col("found") <= SUSPICIOUS_F1),
    ]
    rows = [t.select(F.lit(name).alias("check"), "found", ok.cast("int").alias("passed")) for name, t, ok in checks]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
