"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from penstock.models import classifiers as M  # noqa: E402
from penstock.operators.sampling import balanced_weights, bootstrap  # noqa: E402
from penstock.plans.catalog import QUERIES  # noqa: E402
from penstock.plans.inputs import MEASURES, line_items  # noqa: E402
from penstock.session import build_session  # noqa: E402
from penstock.sources.staging import stage  # noqa: E402

HEADLINE = (
    "flagship_cascade",
    "s1_csv_scan",
    "n1_chunk_mean_fill",
    "n4_fill_chain",
    "n5_min_max_scale",
    "n9_interpolate",
    "n10_z_score",
    "n11_quantile_uniform",
    "g1_class_counts",
    "g3_variance_summary",
    "g5_matrix_stats",
    "m2_stratified_sample",
    "m3_stratified_bootstrap",
    "m6_nearest_neighbors",
    "m1_smote",
    "l1_random_forest",
    "l1_forest_on_groups",
    "l13_knn_classifier",
    "l5_cascade_replace",
    "l6_cascade_confirm",
    "e2_metrics",
    "e4_roc_auc",
    "e7_best_rows",
    "e9_range_scores",
    "e12_f1_curve",
    "w2_rolling_mean_std",
    "w3_sliding_stats",
    "fs1_ks_shift",
    "fs2_top_correlated",
    "fs4_feature_scores",
    "v1_temporal_split",
    "v2_expanding_folds",
    "t3_escalation_monitor",
    "t4_drift_by_day",
)


def edge_model(spark, sf_dir: str, cpus: int) -> dict[str, float]:
    """Fit the fourth edge configuration on a 5 % bootstrap and score the whole matrix with it."""
    li = line_items(spark, sf_dir).select("row_key", (F.col("l_returnflag") == "R").cast("int").alias("label"), *MEASURES)
    matrix = stage(M.assemble(li, MEASURES).repartition(cpus), "matrix")
    sample = stage(balanced_weights(bootstrap(matrix, "label", 0.05, ["row_key"])), "sample")
    start = time.perf_counter()
    scorer = M.fit_trees(sample, M.CONFIGS[3].edge, "weight")
    fit_s = time.perf_counter() - start
    score_s = M.scoring_seconds(scorer, matrix)
    ten = stage(matrix.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(10)))).repartition(2 * cpus), "matrix-10")
    ten_s = M.scoring_seconds(scorer, ten)
    rows = matrix.count()
    return {
        "fit_s": round(fit_s, 3), "score_s": round(score_s, 3), "rows": rows, "rows_per_s": round(rows / score_s),
        "score_10x_s": round(ten_s, 3), "rows_per_s_10x": round(10 * rows / ten_s),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["g1_class_counts"](spark, sf_dir).collect()  # start the JVM before the clock
    seconds: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as e:  # noqa: BLE001 - one failing query must not hide the others
            failed[name] = str(e)[:200]
    model = edge_model(spark, sf_dir, cpus)
    seconds["edge_fit_5pct"] = model["fit_s"]
    seconds["edge_score_all_rows"] = model["score_s"]
    out = {
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "edge_model": model,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
