"""Queries that fit and score classifiers."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from penstock.models import classifiers as M
from penstock.models import kernels as K
from penstock.models.cascade import run_grid, score_cascade
from penstock.operators import evaluate
from penstock.operators.sampling import balanced_weights, positive_weight, stratified_split
from penstock.operators.smote import balance
from penstock.plans.inputs import MEASURES, VECTORS, rounded, table, vectors
from penstock.plans.registry import query
from penstock.sources.staging import stage

def _sides(spark, sf_dir):
    """Train and test vectors, 70/30 by class, staged with weights and features."""
    train, test = stratified_split(vectors(spark, sf_dir), ["label"], 0.7, ["id"])
    train = M.from_array(stage(balanced_weights(train), "train"), "vec")
    return train, M.from_array(stage(test, "test"), "vec")


def _report(scored, p="p"):
    """Confusion counts, metrics and AUC of one scored table."""
    scored = stage(scored.select("id", "label", F.col(p).alias("p"), "prediction"), "scored")
    cells = evaluate.with_metrics(evaluate.confusion(scored))
    auc = evaluate.roc_auc(scored, score="p").first()["roc_auc"]
    return rounded(cells.withColumn("roc_auc", F.lit(auc)), "precision", "recall", "f1", "accuracy", "fp_rate", "roc_auc")


@query("l1_random_forest")
def l1_random_forest(spark, sf_dir):
    """Random forest with balanced class weights."""
    train, test = _sides(spark, sf_dir)
    return _report(M.fit_trees(train, M.CONFIGS[0].edge, "weight").classify(test))


@query("l2_extra_trees")
def l2_extra_trees(spark, sf_dir):
    """Extra-trees of the published size, grown level by level."""
    train, test = _sides(spark, sf_dir)
    return _report(M.fit_trees(train, M.CONFIGS[2].edge, "weight").classify(test))


@query("l3_gradient_boosting")
def l3_gradient_boosting(spark, sf_dir):
    """Boosted trees."""
    train, test = _sides(spark, sf_dir)
    return _report(M.fit_trees(train, M.CONFIGS[1].central).classify(test))


@query("l4_class_and_probability")
def l4_class_and_probability(spark, sf_dir):
    """Class and P(attack) per row."""
    train, test = _sides(spark, sf_dir)
    scored = M.fit_trees(train, M.CONFIGS[3].edge, "weight").classify(test)
    return rounded(scored.select("id", "label", "p", "prediction"), "p")


@query("l5_model_cascade")
def l5_model_cascade(spark, sf_dir):
    """Fitted edge and central models; the central model sees escalated rows only."""
    train, test = _sides(spark, sf_dir)
    edge = M.fit_trees(train, M.CONFIGS[3].edge, "weight")
    central = M.fit_trees(train, M.CONFIGS[3].central, "weight")
    out = score_cascade(test, edge, central, "replace")
    return rounded(out.select("id", "label", "p_edge", "p_central", "escalated", "edge_class", "final_class"), "p_edge", "p_central")


@query("l6_model_cascade_confirm")
def l6_model_cascade_confirm(spark, sf_dir):
    """The confirming cascade; the central model scores all rows, as the AUC needs them."""
    train, test = _sides(spark, sf_dir)
    edge = M.fit_trees(train, M.SECOND_TESTBED.edge, "weight")
    central = M.fit_trees(train, M.SECOND_TESTBED.central)
    out = score_cascade(test, edge, central, "confirm", all_central=True)
    return rounded(out.select("id", "label", "p_edge", "p_central", "escalated", "edge_class", "final_class"), "p_edge", "p_central")


_GRID = ("config_name", "edge_share", "edge_rows", "tn", "fp", "fn", "tp", "f1", "edge_f1", "escalated", "escalation_rate")


@query("l8_experiment_grid")
def l8_experiment_grid(spark, sf_dir):
    """All six configurations at published size over all five edge shares."""
    train, test = _sides(spark, sf_dir)
    results = run_grid(train, test, "loop", strict=True)
    return rounded(results.select(*_GRID), "f1", "edge_f1", "escalation_rate")


@query("l9_second_testbed_grid")
def l9_second_testbed_grid(spark, sf_dir):
    """The single configuration of the second testbed: over-sampled training rows, samples without replacement, AUC."""
    train, test = stratified_split(vectors(spark, sf_dir), ["label"], 0.7, ["id"])
    balanced = M.from_array(stage(balance(stage(train, "real")).select("id", "vec", "label"), "balanced"), "vec")
    test = M.from_array(stage(test, "test"), "vec")
    results = run_grid(balanced, test, "water", [M.SECOND_TESTBED], rule="confirm", with_auc=True, strict=True)
    return rounded(results.select(*_GRID, "roc_auc"), "f1", "edge_f1", "escalation_rate", "roc_auc")


@query("l10_footprint")
def l10_footprint(spark, sf_dir):
    """Size, nodes, fitting time and scoring rate of an edge model over the whole matrix."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), *MEASURES)
    data = stage(M.assemble(balanced_weights(li), MEASURES), "matrix")
    start = time.perf_counter()
    scorer = M.fit_trees(data, M.CONFIGS[3].edge, "weight")
    fit_s = time.perf_counter() - start
    n, seconds = data.count(), M.scoring_seconds(scorer, data)
    row = (n, scorer.nodes, M.saved_size_mb(spark, scorer), fit_s, n / seconds)
    return spark.createDataFrame([row], "scored_rows long, nodes long, size_mb double, fit_s double, score_rows_per_s double")


@query("l11_logistic_regression")
def l11_logistic_regression(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    return _report(M.fit_logistic(train, "weight").classify(test))


@query("l12_linear_svc")
def l12_linear_svc(spark, sf_dir):
    """Linear support vectors, attack rows weighted by 20 (M8)."""
    train, test = _sides(spark, sf_dir)
    return _report(M.fit_linear_svc(positive_weight(train.drop("weight")), "weight").classify(test))


@query("l12_rbf_svc")
def l12_rbf_svc(spark, sf_dir):
    """RBF support vectors through random Fourier features, gamma "scale", attack rows weighted by 20 (M8)."""
    train, test = _sides(spark, sf_dir)
    width = len(train.select("vec").first()["vec"])
    w, b = K.draws(spark, width, K.scale_gamma(train))
    return _report(M.fit_rbf_svc(positive_weight(train.drop("weight")), w, b, "weight").classify(test))


_MAP_GAMMA = 0.5


@query(
    "l12_fourier_map",
    f"""WITH {VECTORS}, {K.map_sql("v", _MAP_GAMMA, 64)}
    SELECT id, round(sum(z), 6) AS z_sum, round(max(z) FILTER (WHERE j = 0), 6) AS z_first,
           round(max(z) FILTER (WHERE j = {K.FEATURES - 1}), 6) AS z_last FROM fz GROUP BY id""",
)
def l12_fourier_map(spark, sf_dir):
    """The Fourier map of every vector, summed, first and last value."""
    v = vectors(spark, sf_dir)
    w, b = K.draws(spark, 64, _MAP_GAMMA)
    z = v.select("id", K.mapped(F.col("vec"), w, b).alias("z"))
    return rounded(z.select("id", F.aggregate("z", F.lit(0.0), lambda a, x: a + x).alias("z_sum"), F.col("z")[0].alias("z_first"),
                            F.element_at("z", -1).alias("z_last")), "z_sum", "z_first", "z_last")


# ---------------------------------------------------------------- models with closed forms
# On 0/1 features an unbagged forest that may grow gives the class rate of each group of equal features, boosting runs a short
# recursion per group, and an unregularised logistic regression on one feature gives the rate as well.

_GROUPS = """gr AS (SELECT (l_quantity > 25)::INT AS x, (l_discount > 0.05)::INT AS z,
    (l_partkey % 10 < CASE WHEN (l_quantity > 25) <> (l_discount > 0.05) THEN 2 WHEN l_quantity > 25 THEN 9 ELSE 8 END)::INT AS label FROM lineitem)"""


def _groups(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x, z = F.col("l_quantity") > 25, F.col("l_discount") > 0.05
    share = F.when(x != z, 2).when(x, 9).otherwise(8)  # MLlib merges leaves of one class, so neighbouring groups differ in class
    rows = li.select(x.cast("int").alias("x"), z.cast("int").alias("z"), (F.col("l_partkey") % 10 < share).cast("int").alias("label"))
    return stage(M.assemble(balanced_weights(rows), ["x", "z"]), "groups")


def _only_x(rows):
    """Training rows whose second feature says nothing."""
    return M.assemble(rows.drop("features").withColumn("z", F.lit(0)), ["x", "z"])


_PLAIN = M.TreeSpec("forest", 50, 15, bagged=False)
_WEIGHED = "sum(w * label) / sum(w)"
_RATES = f"""{_GROUPS}, n AS (SELECT count(*)::DOUBLE AS n, sum(label)::DOUBLE AS p FROM gr),
    wt AS (SELECT x, z, label, CASE WHEN label = 1 THEN n / (2 * p) ELSE n / (2 * (n - p)) END AS w FROM gr, n),
    ed AS (SELECT x, {_WEIGHED} AS p_edge FROM wt GROUP BY x), ce AS (SELECT x, z, {_WEIGHED} AS p_central, count(*) AS n_rows FROM wt GROUP BY x, z)"""


@query(
    "l1_forest_on_groups",
    f"WITH {_RATES} SELECT x, z, round(p_central, 6) AS p, (p_central > 0.5)::INT AS prediction, n_rows FROM ce",
)
def l1_forest_on_groups(spark, sf_dir):
    """A forest of the published size, without bagging, on two 0/1 features."""
    rows = _groups(spark, sf_dir)
    scored = M.fit_trees(rows, _PLAIN, "weight").classify(rows)
    return rounded(scored.groupBy("x", "z", "p", "prediction").agg(F.count(F.lit(1)).alias("n_rows")), "p")


@query(
    "l2_extra_on_groups",
    f"WITH {_RATES} SELECT x, z, round(p_central, 6) AS p, (p_central > 0.5)::INT AS prediction, n_rows FROM ce",
)
def l2_extra_on_groups(spark, sf_dir):
    """Extra-trees of the published size on two 0/1 features: every cut falls between 0 and 1, so leaves are the groups."""
    rows = _groups(spark, sf_dir)
    scored = M.fit_trees(rows, M.CONFIGS[2].edge, "weight").classify(rows)
    return rounded(scored.groupBy("x", "z", "p", "prediction").agg(F.count(F.lit(1)).alias("n_rows")), "p")


@query(
    "l3_boosting_on_groups",
    f"""WITH RECURSIVE {_GROUPS}, g AS (SELECT x, avg(label) AS r, count(*) AS n_rows FROM gr GROUP BY x),
    b AS (SELECT x, r, n_rows, 1 AS k, 2 * r - 1 AS f FROM g
          UNION ALL SELECT x, r, n_rows, k + 1, f + 0.1::DOUBLE * (r * 4 / (1 + exp(2 * f)) - (1 - r) * 4 / (1 + exp(-2 * f))) FROM b WHERE k < 200)
    SELECT x, round(1 / (1 + exp(-2 * f)), 6) AS p, n_rows FROM b WHERE k = 200""",
)
def l3_boosting_on_groups(spark, sf_dir):
    """The published boosted ensemble on one 0/1 feature."""
    rows = _only_x(_groups(spark, sf_dir))
    scored = M.fit_trees(rows, M.CONFIGS[1].central).score(rows)
    return rounded(scored.groupBy("x", "p").agg(F.count(F.lit(1)).alias("n_rows")), "p")


@query("l11_logistic_on_groups", f"WITH {_GROUPS} SELECT x, round(avg(label), 2) AS p, count(*) AS n_rows FROM gr GROUP BY x")
def l11_logistic_on_groups(spark, sf_dir):
    """Logistic regression on one 0/1 feature."""
    rows = _only_x(_groups(spark, sf_dir))
    scored = M.fit_logistic(rows).score(rows).groupBy("x").agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("n_rows"))
    return rounded(scored, "p", digits=2)


def _group_cascade(spark, sf_dir, rule, all_central=False):
    rows = _groups(spark, sf_dir)
    edge, central = M.fit_trees(_only_x(rows), _PLAIN, "weight"), M.fit_trees(rows, _PLAIN, "weight")
    out = score_cascade(rows, edge, central, rule, all_central)
    keys = ["x", "z", "p_edge", "p_central", "escalated", "edge_class", "final_class"]
    return rounded(out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")), "p_edge", "p_central")


_FINAL = "x, z, round(p_edge, 6) AS p_edge"


@query(
    "l5_cascade_on_groups",
    f"""WITH {_RATES}, j AS (SELECT *, p_edge > 0.4 AS escalated FROM ce JOIN ed USING (x))
    SELECT {_FINAL}, CASE WHEN escalated THEN round(p_central, 6) END AS p_central, escalated, (p_edge > 0.5)::INT AS edge_class,
           (CASE WHEN escalated THEN p_central > 0.5 ELSE p_edge > 0.5 END)::INT AS final_class, n_rows FROM j""",
)
def l5_cascade_on_groups(spark, sf_dir):
    """Fitted edge and central forests, the central one on escalated rows only."""
    return _group_cascade(spark, sf_dir, "replace")


@query(
    "l6_cascade_on_groups",
    f"""WITH {_RATES}, j AS (SELECT *, p_edge > 0.3 AS escalated FROM ce JOIN ed USING (x))
    SELECT {_FINAL}, round(p_central, 6) AS p_central, escalated, (p_edge > 0.5)::INT AS edge_class,
           (escalated AND p_central >= 0.95)::INT AS final_class, n_rows FROM j""",
)
def l6_cascade_on_groups(spark, sf_dir):
    """The confirming cascade of two fitted forests."""
    return _group_cascade(spark, sf_dir, "confirm", all_central=True)
