"""Decisions, metrics, episodes, thresholds, selection and models."""

import itertools

import pytest
from pyspark.sql import functions as F

from penstock.functions.decisions import cascade_confirm, cascade_replace, escalate_unsure, predicted
from penstock.models import classifiers as M
from penstock.models.cascade import RESULT_SCHEMA, run_grid, score_cascade
from penstock.operators import episodes, evaluate, selection, splits
from penstock.operators.sampling import balanced_weights
from penstock.plans import models as model_plans
from penstock.streaming import online

EDGE = [0.3, 0.31, 0.4, 0.41, 0.5, 0.6, 0.61]
CENTRAL = [0.5, 0.94, 0.95]

# Published confusion cells (tp, fp, fn, tn) with precision, recall, F1 and accuracy.
PUBLISHED = [
    ("C1", 2270, 52, 7, 233_831, 0.9776, 0.9969, 0.9872, 0.9998),
    ("C2", 2273, 76, 4, 233_807, 0.9676, 0.9982, 0.9827, 0.9997),
    ("C3", 2270, 54, 7, 233_829, 0.9768, 0.9969, 0.9867, 0.9997),
    ("C4", 2270, 52, 7, 233_831, 0.9776, 0.9969, 0.9872, 0.9998),
    ("C5", 2273, 77, 4, 233_806, 0.9672, 0.9982, 0.9825, 0.9997),
    ("C6", 2270, 54, 7, 233_829, 0.9768, 0.9969, 0.9867, 0.9997),
]


def test_cascade_edges(spark):
    df = spark.createDataFrame(list(itertools.product(EDGE, CENTRAL)), "e double, c double")
    e, c = F.col("e"), F.col("c")
    rows = df.select("e", "c", escalate_unsure(e).alias("u"), cascade_replace(e, predicted(c)).alias("r"), cascade_confirm(e, c).alias("k")).collect()
    for r in rows:
        assert r["u"] == (r["e"] > 0.4)
        assert r["r"] == int(r["e"] > 0.4 and r["c"] > 0.5)
        assert r["k"] == int(r["e"] > 0.3 and r["c"] >= 0.95)


def test_published_cells(spark):
    df = spark.createDataFrame([p[:5] for p in PUBLISHED], "name string, tp long, fp long, fn long, tn long")
    got = {r["name"]: r for r in evaluate.with_metrics(df).collect()}
    for name, *_, precision, recall, f1, accuracy in PUBLISHED:
        r = got[name]
        assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == pytest.approx((precision, recall, f1, accuracy), abs=6e-5)


def test_one_class(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2)], "label int, prediction int, score double")
    r = evaluate.with_metrics(evaluate.confusion(df)).first()
    assert (r["tn"], r["tp"], r["precision"], r["recall"], r["f1"], r["accuracy"]) == (2, 0, 0.0, 0.0, 0.0, 1.0)
    assert evaluate.roc_auc(df).first()[0] == 0.0


def test_tied_scores_and_monotone_transform(spread):
    rows = [(0, 0.1), (1, 0.1), (0, 0.4), (1, 0.4), (1, 0.8), (0, 0.8), (1, 0.9)]
    df = spread.createDataFrame(rows, "label int, score double")
    wins = [(p > n) + 0.5 * (p == n) for y, p in rows if y for z, n in rows if not z]
    want = sum(wins) / len(wins)
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(want)
    assert evaluate.roc_auc(df.withColumn("score", F.exp(3 * F.col("score")))).first()[0] == pytest.approx(want)


def test_tied_best_takes_the_first(spark):
    df = spark.createDataFrame([("a", 0.2, 0.9), ("a", 0.1, 0.9), ("a", 0.05, 0.8)], "config_name string, edge_share double, f1 double")
    assert evaluate.best_rows(df, ["config_name"]).first()["edge_share"] == 0.1


def test_episodes(spread):
    attacks, alarms = {*range(10, 15), 20, 21}, {13, 30, 31}
    rows = [(t, int(t in attacks), int(t in alarms)) for t in range(40)]
    df = spread.createDataFrame(rows, "step long, label int, alarm int")
    r = episodes.range_scores(df).first()
    assert (r["attacks"], r["attacks_detected"], r["alarms"], r["alarms_true"]) == (2, 1, 2, 1)
    assert (r["range_precision"], r["range_recall"], r["range_f1"]) == (0.5, 0.5, 0.5)
    table = [tuple(x) for x in episodes.attack_table(df).orderBy("start").collect()]
    assert table == [(10, 14, 5, 1, 3, 0.2), (20, 21, 2, 0, None, 0.0)]
    hour = episodes.false_alarms_per_hour(df).first()
    assert (hour["false_alarms"], hour["fatigue"]) == (2, 0)


def test_thresholds(spread):
    df = spread.createDataFrame([(i, int(i >= 90), i / 100) for i in range(101)], "id int, label int, score double")
    got = {r["rule"]: r["threshold"] for r in evaluate.score_thresholds(df, base=0.5).collect()}
    assert got == pytest.approx({"p99": 0.99, "max_score": 1.0, "base_plus_max": 1.5})
    assert evaluate.best_f1_threshold(df).first()["threshold"] == 0.9


def test_ks_against_definition(spread):
    a, b = [1.0, 2.0, 2.0, 3.0, 9.0], [2.0, 4.0, 5.0, 9.0]
    rows = [("x", v, 0) for v in a] + [("x", v, 1) for v in b]
    df = spread.createDataFrame(rows, "feature string, value double, side int")
    got = selection.ks_two_sample(df, F.col("side") == 1).first()
    want = max(abs(sum(v <= t for v in a) / 5 - sum(v <= t for v in b) / 4) for t in a + b)
    assert got["d"] == pytest.approx(want) and 0 < got["p_value"] <= 1


def test_kolmogorov_tail(spark):
    got = [r[0] for r in spark.createDataFrame([(0.1,), (1.0,), (1.3581,), (3.0,)], "x double").select(selection.kolmogorov_tail(F.col("x"))).collect()]
    assert got == pytest.approx([1.0, 0.26999967, 0.05, 3.0e-8], abs=1e-4)


def test_folds_keep_their_gap(spread):
    df = spread.range(120).withColumnRenamed("id", "t")
    for folds, both_sides in ((splits.expanding_folds(df, "t", 4, 5), False), (splits.blocked_folds(df, "t", 4, 5), True),
                              (splits.walk_forward_folds(df, "t", 4, 5), False)):
        for k in range(1, 5):
            train, test = splits.one_fold(folds, k)
            test_t, train_t = [r["t"] for r in test.collect()], [r["t"] for r in train.collect()]
            assert test_t and train_t
            assert all(t < min(test_t) - 5 or (both_sides and t > max(test_t) + 5) for t in train_t)


def test_name_tiers(spark):
    names = {"1_FIT_001_PV": "high", "2_LT_002_PV": "high", "2_PIT_001_PV": "high", "2A_AIT_001_PV": "medium", "2_SV_101_STATUS": "low", "3_P_001_SPEED": "other"}
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert {r["s"]: r["t"] for r in df.select("s", selection.priority(F.col("s")).alias("t")).collect()} == names


@pytest.fixture(scope="module")
def blobs(spark):
    df = spark.range(400).select("id", (F.col("id") % 5 == 0).cast("int").alias("label"))
    df = df.select("id", "label", *[(F.col("label") * 2.0 + F.randn(i)).alias(f"x{i}") for i in range(4)])
    df = M.assemble(df, [f"x{i}" for i in range(4)]).select("id", "label", "features").persist()
    df.count()
    return df.filter("id < 280"), df.filter("id >= 280")


@pytest.mark.parametrize("spec", [M.TreeSpec("forest", 5, 4, 5), M.TreeSpec("extra", 4, 5, 5), M.TreeSpec("boosted", 4, 3, weighted=False)])
def test_ensembles_learn(blobs, spec):
    train, test = blobs
    scorer = M.fit_trees(balanced_weights(train), spec, "weight")
    scored = scorer.classify(test)
    assert scored.count() == test.count()
    assert evaluate.roc_auc(scored, score="p").first()[0] > 0.85
    assert scorer.nodes > 0


@pytest.mark.parametrize("kind", ["forest", "extra", "boosted", "logistic", "svc"])
def test_saved_models_score_alike(spark, blobs, tmp_path, kind):
    train, test = blobs
    fits = {"logistic": M.fit_logistic, "svc": M.fit_linear_svc}
    scorer = fits[kind](train) if kind in fits else M.fit_trees(train, M.TreeSpec(kind, 3, 3))
    scorer.save(f"{tmp_path}/model")
    again = M.load_scorer(spark, f"{tmp_path}/model")
    both = again.score(scorer.score(test, "a"), "b")
    assert both.filter("a is null or b is null or a <> b").count() == 0


def test_nominal_features(spark):
    from pyspark.ml.feature import StringIndexer

    rows = spark.range(900).select("id", F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("kind"))
    rows = rows.withColumn("label", (F.col("kind") == "b").cast("int"))
    coded = StringIndexer(inputCol="kind", outputCol="k").fit(rows).transform(rows)
    data = M.assemble(coded, ["k"])
    for kind in ("forest", "boosted"):
        scored = M.fit_trees(data, M.TreeSpec(kind, 5, 3)).classify(data)
        assert scored.filter("prediction <> label").count() == 0


def test_linear_baselines_learn(blobs):
    train, test = blobs
    for scorer in (M.fit_logistic(train, max_iter=20), M.fit_linear_svc(train, max_iter=20)):
        assert evaluate.roc_auc(scorer.classify(test), score="p").first()[0] > 0.9


def test_cascade_equals_scoring_everything(blobs):
    train, test = blobs
    edge, central = M.fit_single_tree(train, 2), M.fit_single_tree(train, 5)
    for rule in ("replace", "confirm"):
        a = score_cascade(test, edge, central, rule).select("id", "final_class").orderBy("id").collect()
        b = score_cascade(test, edge, central, rule, all_central=True).select("id", "final_class").orderBy("id").collect()
        assert a == b and len(a) == 120


def test_grid_keeps_going_after_a_failure(blobs):
    train, test = blobs
    good = M.CascadeConfig("good", M.TreeSpec("forest", 2, 2), M.TreeSpec("forest", 3, 3))
    bad = M.CascadeConfig("bad", M.TreeSpec("forest", 0, 2), M.TreeSpec("forest", 3, 3))
    got = {r["config_name"]: r for r in run_grid(train, test, "blobs", [bad, good], (0.5,), footprint=True).collect()}
    assert got["bad"]["error"] and got["good"]["error"] is None
    g = got["good"]
    assert g["tn"] + g["fp"] + g["fn"] + g["tp"] == 120 and g["edge_rows"] == 140
    assert g["edge_size_mb"] > 0 and g["score_rows_per_s"] > 0


@pytest.mark.parametrize("where", ["central", "edge"])
def test_a_failed_cell_fails_a_strict_grid(blobs, where):
    """The rows of good cells must not come back beside empty ones that look like results."""
    train, test = blobs
    spec = M.TreeSpec("forest", 2, 2)
    good = M.CascadeConfig("good", spec, spec)
    bad = M.CascadeConfig("bad", *[M.TreeSpec("forest", 0, 2) if where == side else spec for side in ("edge", "central")])
    with pytest.raises(RuntimeError, match="2 of 4 cells .*bad at 0.4.*bad at 0.5"):
        run_grid(train, test, "blobs", [bad, good], (0.4, 0.5), strict=True)


def _grid_arguments(monkeypatch, query, spark, sf_dir):
    """What a grid query hands to `run_grid`."""
    seen = {}

    def grid(train, test, dataset, configs=M.CONFIGS, shares=M.EDGE_SHARES, **more):
        seen.update(configs=list(configs), shares=tuple(shares), **more)
        return spark.createDataFrame([], RESULT_SCHEMA)

    monkeypatch.setattr(model_plans, "run_grid", grid)
    query(spark, sf_dir)
    return seen


def test_second_testbed_grid_fails_with_its_cells(monkeypatch, spark, sf_dir):
    seen = _grid_arguments(monkeypatch, model_plans.l9_second_testbed_grid, spark, sf_dir)
    assert seen["strict"] and seen["configs"] == [M.SECOND_TESTBED] and seen["shares"] == M.EDGE_SHARES


def test_experiment_grid_covers_every_configuration(monkeypatch, spark, sf_dir):
    seen = _grid_arguments(monkeypatch, model_plans.l8_experiment_grid, spark, sf_dir)
    assert seen["strict"] and seen["configs"] == list(M.CONFIGS) and seen["shares"] == M.EDGE_SHARES


def test_configurations_are_complete():
    assert [c.name.split("_")[1] for c in M.CONFIGS] == list("123456")
    assert M.CONFIGS[1].central.trees == 200 and M.CONFIGS[1].central.kind == "boosted"
    assert all(c.edge.depth <= M.MAX_DEPTH and c.central.depth <= M.MAX_DEPTH for c in M.CONFIGS)


def test_late_rows_are_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "id long, ts timestamp, escalated boolean"
    on_time = spark.sql("SELECT 1L id, timestamp'2024-01-01 01:30:00' ts, true escalated UNION ALL SELECT 2L, timestamp'2024-01-01 03:30:00', false")
    on_time.coalesce(1).write.parquet(src)
    late = spark.sql("SELECT 3L id, timestamp'2024-01-01 01:40:00' ts, true escalated UNION ALL SELECT 4L, timestamp'2024-01-01 05:00:00', true")

    def run():
        stream = online.read_stream(spark, src, spark.createDataFrame([], schema).schema)
        out = online.escalation_monitor(stream, "ts", "escalated").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        out.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()

    run()
    late.coalesce(1).write.mode("append").parquet(src)
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.agg(F.sum("n_rows")).first()[0] == 2  # rows 1 and 2; row 3 came after its hour was closed


def test_buffer_survives_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = spark.createDataFrame([], "user long, ts timestamp, value double").schema

    def add(rows):
        spark.createDataFrame(rows, "user long, s long, value double").select(
            "user", F.timestamp_seconds("s").alias("ts"), "value"
        ).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = online.recent_rows(online.read_stream(spark, src, schema), "user", "ts", "value")
        w = stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        w.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()

    add([(1, 30, 3.0), (1, 10, 1.0), (1, 20, 2.0), (2, 10, 7.0)])
    run()
    add([(1, 50, 5.0), (1, 40, 4.0), (1, 29, 8.0)])  # the last row is late, but inside the watermark
    run()
    add([(3, 5000, 0.0)])
    run()
    add([(1, 20, 99.0), (1, 5010, 6.0)])  # the first row is behind the watermark
    run()
    add([(3, 9000, 0.0)])
    run()
    got = {(r["entity"], r["at"] // 1_000_000): (r["mean"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {
        (1, 10): (1.0, 1), (1, 20): (1.5, 2), (1, 29): (11 / 3, 3), (1, 30): (3.5, 4), (1, 40): (4.25, 4), (1, 50): (5.0, 4),
        (1, 5010): (4.5, 4), (2, 10): (7.0, 1), (3, 5000): (0.0, 1),
    }


def test_pca_variance(blobs):
    import numpy as np

    train, _ = blobs
    _, table = selection.pca(train, "features", 2)
    x = np.array([r["features"].toArray() for r in train.select("features").collect()])
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    got = [r["explained"] for r in table.orderBy("component").collect()]
    assert got == pytest.approx(list(values[:2] / values.sum()))
