"""Queries over cascade decisions, evaluation, episodes, thresholds and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from penstock.functions.decisions import cascade_confirm, cascade_replace, escalate_suspicious, escalate_unsure, predicted
from penstock.functions.draws import seeded_uniform, uniform_sql
from penstock.models.classifiers import CONFIGS, EDGE_SHARES
from penstock.operators import columns as C
from penstock.operators import episodes, evaluate, impute, profile, scale
from penstock.operators.ordering import with_row_id
from penstock.operators.windows import boundary_windows
from penstock.plans.flows import prepare_water
from penstock.plans.inputs import (
    READINGS,
    SCORES,
    SENSOR_WIDE,
    SENSORS,
    readings,
    rounded,
    scores,
    sensor_wide,
    table,
)
from penstock.plans.registry import query
from penstock.sources.staging import stage

_EDGE = "CASE WHEN p_edge > 0.5 THEN 1 ELSE 0 END"
_CENTRAL = "CASE WHEN p_central > 0.5 THEN 1 ELSE 0 END"
_UNSURE = f"({_EDGE} = 1 OR (p_edge > 0.4 AND p_edge < 0.6))"
_REPLACE = f"CASE WHEN {_UNSURE} THEN {_CENTRAL} ELSE {_EDGE} END"
_CONFIRM = "CASE WHEN p_edge > 0.3 AND p_central >= 0.95 THEN 1 ELSE 0 END"


def _cells(label: str, pred: str, prefix: str = "") -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE {label} = {y} AND {pred} = {p}) AS {prefix}{name}"
        for name, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    )


def _metrics(prefix: str = "", digits: int | None = 9) -> str:
    tn, fp, fn, tp = (prefix + c for c in ("tn", "fp", "fn", "tp"))

    def div(a, b):
        return f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"

    return ", ".join(
        f"{e if digits is None else f'round({e}, {digits})'} AS {prefix}{n}"
        for n, e in (
            ("precision", div(tp, f"{tp} + {fp}")),
            ("recall", div(tp, f"{tp} + {fn}")),
            ("f1", div(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")),
            ("accuracy", div(f"{tp} + {tn}", f"{tn} + {fp} + {fn} + {tp}")),
            ("fp_rate", f"100.0 * ({div(fp, f'{fp} + {tn}')})"),
        )
    )


METRICS = ("precision", "recall", "f1", "accuracy", "fp_rate")


def _decided(spark, sf_dir):
    s = scores(spark, sf_dir)
    return s.select(
        "*", escalate_unsure(F.col("p_edge")).alias("escalated"), predicted(F.col("p_edge")).alias("edge_class"),
        cascade_replace(F.col("p_edge"), predicted(F.col("p_central"))).alias("final_class"),
        cascade_confirm(F.col("p_edge"), F.col("p_central")).alias("confirmed_class"),
    )


_DECIDED = SCORES + f""",
de AS (SELECT *, {_UNSURE} AS escalated, {_EDGE} AS edge_class, {_REPLACE} AS final_class, {_CONFIRM} AS confirmed_class FROM sc)"""


@query("l5_cascade_replace", f"WITH {_DECIDED} SELECT event_id, edge_class, escalated::INT AS escalated, final_class FROM de")
def l5_cascade_replace(spark, sf_dir):
    """Alarmed or unsure rows take the central class."""
    return _decided(spark, sf_dir).select("event_id", "edge_class", F.col("escalated").cast("int").alias("escalated"), "final_class")


@query("l6_cascade_confirm", f"WITH {_DECIDED} SELECT event_id, (p_edge > 0.3)::INT AS escalated, confirmed_class FROM de")
def l6_cascade_confirm(spark, sf_dir):
    """Suspicious rows alarm only when the central model is confident."""
    return _decided(spark, sf_dir).select(
        "event_id", escalate_suspicious(F.col("p_edge")).cast("int").alias("escalated"), "confirmed_class"
    )


@query(
    "l7_escalation_rate",
    f"""WITH {_DECIDED} SELECT user_id, count(*) AS n_rows, count(*) FILTER (WHERE escalated) AS escalated,
        round(100.0 * count(*) FILTER (WHERE escalated) / count(*), 6) AS escalation_rate FROM de GROUP BY user_id""",
)
def l7_escalation_rate(spark, sf_dir):
    """Share of rows sent on, per entity."""
    return rounded(evaluate.escalation(_decided(spark, sf_dir), F.col("escalated"), ["user_id"]), "escalation_rate")


@query("e1_confusion", f"WITH {_DECIDED} SELECT {_cells('label', 'final_class')} FROM de")
def e1_confusion(spark, sf_dir):
    return evaluate.confusion(_decided(spark, sf_dir), prediction="final_class")


@query(
    "e2_metrics",
    f"WITH {_DECIDED}, c AS (SELECT user_id, {_cells('label', 'final_class')} FROM de GROUP BY user_id) SELECT *, {_metrics()} FROM c",
)
def e2_metrics(spark, sf_dir):
    """Precision, recall, F1, accuracy and false-positive rate per entity; 0 where undefined."""
    cells = evaluate.confusion(_decided(spark, sf_dir), prediction="final_class", by=["user_id"])
    return rounded(evaluate.with_metrics(cells), *METRICS, digits=9)


@query(
    "e2_label_join_metrics",
    f"""WITH s AS (SELECT l.toxic AS label, CASE WHEN d.n_chars > 400 THEN 1 ELSE 0 END AS prediction
         FROM documents d JOIN labels l USING (doc_id)), c AS (SELECT {_cells('label', 'prediction')} FROM s) SELECT *, {_metrics()} FROM c""",
)
def e2_label_join_metrics(spark, sf_dir):
    """Metrics of a one-feature rule on a rare class, with labels joined in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 400).cast("int").alias("prediction"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return rounded(evaluate.with_metrics(evaluate.confusion(docs.join(labels, "doc_id"))), *METRICS, digits=9)


@query(
    "e3_false_positive_rate",
    f"""WITH {_DECIDED} SELECT round(100.0 * count(*) FILTER (WHERE label = 0 AND confirmed_class = 1)
         / count(*) FILTER (WHERE label = 0), 9) AS fp_rate FROM de""",
)
def e3_false_positive_rate(spark, sf_dir):
    cells = evaluate.confusion(_decided(spark, sf_dir), prediction="confirmed_class")
    return rounded(evaluate.with_metrics(cells).select("fp_rate"), "fp_rate", digits=9)


def _auc_sql(source: str) -> str:
    return f"""g AS (SELECT p_central AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {source} GROUP BY 1),
    w AS (SELECT pos, neg, sum(neg) OVER (ORDER BY s) - neg / 2.0 AS below FROM g)
    SELECT round(sum(pos * below)::DOUBLE / (sum(pos) * sum(neg))::DOUBLE, 9) AS roc_auc FROM w"""


@query("e4_roc_auc", f"WITH {SCORES}, {_auc_sql('sc')}")
def e4_roc_auc(spark, sf_dir):
    """AUC of the central score over all rows, ties averaged."""
    return rounded(evaluate.roc_auc(scores(spark, sf_dir), score="p_central"), "roc_auc", digits=9)


@query(
    "e4_roc_auc_by_day",
    f"""WITH {SCORES}, g AS (SELECT minute // 1440 AS day, p_central AS s, count(*) FILTER (WHERE label = 1) AS pos,
            count(*) FILTER (WHERE label = 0) AS neg FROM sc GROUP BY 1, 2),
    w AS (SELECT day, pos, neg, sum(neg) OVER (PARTITION BY day ORDER BY s) - neg / 2.0 AS below FROM g)
    SELECT day, CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.0 ELSE round(sum(pos * below)::DOUBLE / (sum(pos) * sum(neg))::DOUBLE, 9) END AS roc_auc
    FROM w GROUP BY day""",
)
def e4_roc_auc_by_day(spark, sf_dir):
    """AUC per day; 0 where a class is missing."""
    s = scores(spark, sf_dir).withColumn("day", F.floor(F.col("minute") / 1440).cast("long"))
    return rounded(evaluate.roc_auc(s, score="p_central", by=["day"]), "roc_auc", digits=9)


@query(
    "e5_edge_beside_cascade",
    f"""WITH {_DECIDED}, c AS (SELECT {_cells('label', 'edge_class', 'edge_')}, {_cells('label', 'final_class')} FROM de)
    SELECT *, {_metrics('edge_')}, {_metrics()},
      round((2.0 * tp / (2 * tp + fp + fn) - 2.0 * edge_tp / (2 * edge_tp + edge_fp + edge_fn)) * 100, 9) AS cascade_gain FROM c""",
)
def e5_edge_beside_cascade(spark, sf_dir):
    """Edge-only and cascade metrics in one pass, with the gain (E6)."""
    report = evaluate.cascade_report(_decided(spark, sf_dir)).drop("n_rows", "escalated", "escalation_rate")
    return rounded(report, *METRICS, *[f"edge_{m}" for m in METRICS], "cascade_gain", digits=9)


@query(
    "e6_cascade_gain",
    f"""WITH {_DECIDED}, c AS (SELECT user_id, {_cells('label', 'edge_class', 'edge_')}, {_cells('label', 'final_class')} FROM de GROUP BY user_id),
    m AS (SELECT user_id, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f,
                 CASE WHEN 2 * edge_tp + edge_fp + edge_fn = 0 THEN 0.0 ELSE 2.0 * edge_tp / (2 * edge_tp + edge_fp + edge_fn) END AS e FROM c)
    SELECT user_id, round((f - e) * 100, 9) AS cascade_gain FROM m""",
)
def e6_cascade_gain(spark, sf_dir):
    """F1 points the central model adds, per entity."""
    report = evaluate.cascade_report(_decided(spark, sf_dir), ["user_id"])
    return rounded(report.select("user_id", "cascade_gain"), "cascade_gain", digits=9)


# Experiment cells: six configurations and five edge shares, each with its own seeded edge score.
_CONFIG_NAMES, _SHARES = tuple(c.name for c in CONFIGS), EDGE_SHARES


def _results(spark, sf_dir, seed):
    """Result table over all readings: one row per (config, edge share)."""
    s = scores(spark, sf_dir).select("event_id", "label", "p_central")
    cells = F.array(*[
        F.struct(F.lit(c).alias("config_name"), F.lit(e).alias("edge_share")) for c in _CONFIG_NAMES for e in _SHARES
    ])
    s = s.select("*", F.explode(cells).alias("cell")).select("event_id", "label", "p_central", "cell.*")
    u = seeded_uniform(seed, F.col("config_name"), F.col("edge_share").cast("string"), F.col("event_id"))
    p_edge = F.round(0.25 * F.col("label") + (1.0 - F.col("edge_share")) * u, 3)
    s = s.withColumn("p_edge", p_edge)
    s = s.select(
        "*", escalate_suspicious(F.col("p_edge")).alias("escalated"), predicted(F.col("p_edge")).alias("edge_class"),
        cascade_confirm(F.col("p_edge"), F.col("p_central")).alias("final_class"),
    )
    by = ["config_name", "edge_share"]
    report = evaluate.cascade_report(s, by)
    return report.select(
        *by, "tn", "fp", "fn", "tp", "precision", "recall", "f1", "accuracy", "fp_rate", "edge_f1", "escalated", "escalation_rate",
    )


def _results_sql(seed, name):
    cfg = ", ".join(f"('{c}')" for c in _CONFIG_NAMES)
    shares = ", ".join(f"({e}::DOUBLE)" for e in _SHARES)
    u = uniform_sql(seed, "config_name || ':' || edge_share::VARCHAR || ':' || event_id::VARCHAR")
    return f"""{name}_c AS (SELECT * FROM (VALUES {cfg}) a(config_name), (VALUES {shares}) b(edge_share)),
    {name}_p AS (SELECT config_name, edge_share, label, p_central, round(0.25 * label + (1.0 - edge_share) * {u}, 3) AS p_edge FROM sc, {name}_c),
    {name}_d AS (SELECT *, p_edge > 0.3 AS escalated, {_EDGE} AS edge_class, {_CONFIRM} AS final_class FROM {name}_p),
    {name}_k AS (SELECT config_name, edge_share, {_cells('label', 'edge_class', 'edge_')}, {_cells('label', 'final_class')},
                 count(*) FILTER (WHERE escalated) AS escalated, 100.0 * count(*) FILTER (WHERE escalated) / count(*) AS escalation_rate
                 FROM {name}_d GROUP BY 1, 2),
    {name} AS (SELECT config_name, edge_share, escalated, escalation_rate, tn, fp, fn, tp, {_metrics(digits=None)}, {_metrics('edge_', None)} FROM {name}_k)"""


@query(
    "e7_best_rows",
    f"""WITH {SCORES}, {_results_sql("first", "res")},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY config_name ORDER BY f1 DESC, edge_share) AS r,
                      row_number() OVER (ORDER BY f1 DESC, config_name, edge_share) AS ro FROM res)
    SELECT config_name AS scope, config_name, edge_share, round(f1, 9) AS f1, tp FROM ranked WHERE r = 1
    UNION ALL SELECT 'overall', config_name, edge_share, round(f1, 9), tp FROM ranked WHERE ro = 1""",
)
def e7_best_rows(spark, sf_dir):
    """Best edge share of each configuration, and the best overall."""
    results = stage(_results(spark, sf_dir, "first"), "results")
    each = evaluate.best_rows(results, ["config_name"]).withColumn("scope", F.col("config_name"))
    overall = evaluate.best_rows(results, [], then=("config_name", "edge_share")).withColumn("scope", F.lit("overall"))
    return rounded(each.unionByName(overall).select("scope", "config_name", "edge_share", "f1", "tp"), "f1", digits=9)


@query(
    "e8_spread_over_shares",
    f"""WITH {SCORES}, {_results_sql("first", "res")} SELECT config_name, round(avg(f1), 6) AS mean_f1, round(stddev_samp(f1), 6) AS std_f1,
        round(avg(escalation_rate), 6) AS mean_escalation FROM res GROUP BY config_name""",
)
def e8_spread_over_shares(spark, sf_dir):
    """Mean and sample deviation of F1 over the edge shares."""
    return rounded(
        evaluate.spread_over_shares(_results(spark, sf_dir, "first")), "mean_f1", "std_f1", "mean_escalation", digits=6
    )


@query(
    "u3_compare_datasets",
    f"""WITH {SCORES}, {_results_sql("first", "ra")}, {_results_sql("second", "rb")},
    a AS (SELECT config_name, avg(f1) AS m, stddev_samp(f1) AS s, avg(escalation_rate) AS e FROM ra GROUP BY 1),
    b AS (SELECT config_name, avg(f1) AS m, stddev_samp(f1) AS s, avg(escalation_rate) AS e FROM rb GROUP BY 1)
    SELECT config_name, round(a.m, 6) AS mean_f1_a, round(a.s, 6) AS std_f1_a, round(a.e, 6) AS mean_escalation_a,
           round(b.m, 6) AS mean_f1_b, round(b.s, 6) AS std_f1_b, round(b.e, 6) AS mean_escalation_b, round(abs(a.m - b.m), 6) AS f1_difference
    FROM a JOIN b USING (config_name)""",
)
def u3_compare_datasets(spark, sf_dir):
    """Two result tables side by side."""
    both = evaluate.compare_datasets(_results(spark, sf_dir, "first"), _results(spark, sf_dir, "second"))
    return rounded(both, *[c for c in both.columns if c != "config_name"], digits=6)


@query(
    "p12_summary_projection",
    f"""WITH {SCORES}, {_results_sql("first", "res")} SELECT edge_share, round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall,
     round(accuracy, 9) AS accuracy, round(fp_rate, 9) AS fp_rate, round(escalation_rate, 9) AS escalation_rate, 0.3::DOUBLE AS escalate_above, 0.95::DOUBLE AS alarm_from,
     NULL::DOUBLE AS model_size_mb, NULL::DOUBLE AS score_rows_per_s FROM res""",
)
def p12_summary_projection(spark, sf_dir):
    """The short result table."""
    r = _results(spark, sf_dir, "first").withColumns({"edge_size_mb": F.lit(None).cast("double"), "score_rows_per_s": F.lit(None).cast("double")})
    return rounded(evaluate.summary(r), *METRICS, "escalation_rate", digits=9)


@query(
    "p13_contains_filter",
    f"""WITH {SCORES}, {_results_sql("first", "res")}, n AS (SELECT *, CASE WHEN edge_share = 0.05 THEN NULL ELSE config_name END AS name FROM res)
    SELECT name, edge_share, tp FROM n WHERE coalesce(contains(name, 'Config_2'), false)""",
)
def p13_contains_filter(spark, sf_dir):
    """Substring filter over configuration names, NULL is no."""
    r = _results(spark, sf_dir, "first").withColumn("name", F.when(F.col("edge_share") != 0.05, F.col("config_name")))
    return r.filter(C.contains(F.col("name"), "Config_2")).select("name", "edge_share", "tp")


# ---------------------------------------------------------------- episodes


def _alarms(spark, sf_dir):
    """`(step, label, alarm)` per minute; an alarm is any confirmed cascade decision in the minute."""
    d = _decided(spark, sf_dir)
    return d.groupBy(F.col("minute").alias("step")).agg(F.max("label").alias("label"), F.max("confirmed_class").alias("alarm"))


_ALARMS = _DECIDED + """,
al AS (SELECT minute AS step, max(label) AS label, max(confirmed_class) AS alarm FROM de GROUP BY 1),
atk AS (SELECT *, step - row_number() OVER (ORDER BY step) AS isl FROM al WHERE label = 1),
alr AS (SELECT *, step - row_number() OVER (ORDER BY step) AS isl FROM al WHERE alarm = 1)"""


@query(
    "e9_range_scores",
    f"""WITH {_ALARMS}, a AS (SELECT isl, max(alarm) AS hit FROM atk GROUP BY 1), b AS (SELECT isl, max(label) AS hit FROM alr GROUP BY 1),
    k AS (SELECT (SELECT count(*) FROM a) AS attacks, (SELECT count(*) FROM a WHERE hit = 1) AS attacks_detected,
                 (SELECT count(*) FROM b) AS alarms, (SELECT count(*) FROM b WHERE hit = 1) AS alarms_true),
    q AS (SELECT *, alarms_true::DOUBLE / alarms AS p, attacks_detected::DOUBLE / attacks AS r FROM k)
    SELECT attacks, attacks_detected, alarms, alarms_true, round(p, 9) AS range_precision, round(r, 9) AS range_recall,
           round(2 * p * r / (p + r), 9) AS range_f1 FROM q""",
)
def e9_range_scores(spark, sf_dir):
    """Range-based precision, recall and F1 over episodes."""
    found = episodes.range_scores(stage(_alarms(spark, sf_dir), "alarms"))
    return rounded(found, "range_precision", "range_recall", "range_f1", digits=9)


@query(
    "e10_attack_table",
    f"""WITH {_ALARMS} SELECT min(step) AS "start", max(step) AS "end", count(*) AS duration, max(alarm) AS detected,
        min(CASE WHEN alarm = 1 THEN step END) - min(step) AS latency,
        round(count(*) FILTER (WHERE alarm = 1)::DOUBLE / count(*), 9) AS coverage FROM atk GROUP BY isl""",
)
def e10_attack_table(spark, sf_dir):
    """Per attack: when, how long, detected, latency, coverage."""
    return rounded(episodes.attack_table(_alarms(spark, sf_dir)), "coverage", digits=9)


@query(
    "e11_false_alarms_per_hour",
    f"""WITH {_ALARMS} SELECT step // 60 AS hour, count(*) FILTER (WHERE alarm = 1 AND label = 0) AS false_alarms,
        CASE WHEN count(*) FILTER (WHERE alarm = 1 AND label = 0) > 5 THEN 1 ELSE 0 END AS fatigue FROM al GROUP BY 1""",
)
def e11_false_alarms_per_hour(spark, sf_dir):
    return episodes.false_alarms_per_hour(_alarms(spark, sf_dir))


# ---------------------------------------------------------------- thresholds and audit

_VALIDATION = "sec < (SELECT max(sec) FROM sc) - 10 * 86400"


def _validation(spark, sf_dir):
    s = scores(spark, sf_dir)
    top = s.agg(F.max("sec")).first()[0]
    return s.filter(F.col("sec") < top - 10 * 86400)


@query(
    "e12_score_thresholds",
    f"""WITH {SCORES}, va AS (SELECT * FROM sc WHERE {_VALIDATION})
    SELECT 'p99' AS rule, round(quantile_cont(p_central, 0.99), 6) AS threshold FROM va
    UNION ALL SELECT 'max_score', round(max(p_central), 6) FROM va UNION ALL SELECT 'base_plus_max', round(0.05 + max(p_central), 6) FROM va""",
)
def e12_score_thresholds(spark, sf_dir):
    """99th percentile, maximum, and base plus maximum of validation scores."""
    return rounded(evaluate.score_thresholds(_validation(spark, sf_dir), "p_central", base=0.05), "threshold")


_CURVE = f"""WITH {SCORES}, va AS (SELECT * FROM sc WHERE {_VALIDATION}),
    g AS (SELECT p_central AS score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM va GROUP BY 1),
    w AS (SELECT score, (sum(pos) OVER (ORDER BY score DESC))::BIGINT AS tp, (sum(neg) OVER (ORDER BY score DESC))::BIGINT AS fp,
                 (sum(pos) OVER () - sum(pos) OVER (ORDER BY score DESC))::BIGINT AS fn FROM g),
    cu AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f FROM w)"""


@query("e12_f1_curve", f"{_CURVE} SELECT score, tp, fp, fn, round(f, 9) AS f1 FROM cu")
def e12_f1_curve(spark, sf_dir):
    """F1 at every distinct validation score."""
    return rounded(evaluate.f1_curve(_validation(spark, sf_dir), score="p_central"), "f1", digits=9)


@query(
    "e12_best_f1_threshold",
    f"{_CURVE} SELECT score AS threshold, round(f, 12) AS f1 FROM cu ORDER BY round(f, 12) DESC, score DESC LIMIT 1",
)
def e12_best_f1_threshold(spark, sf_dir):
    """The threshold with the best validation F1."""
    return rounded(evaluate.best_f1_threshold(_validation(spark, sf_dir), score="p_central"), "f1", digits=12)


@query(
    "e13_leakage_audit",
    f"""WITH {_DECIDED}, w AS (SELECT *, row_number() OVER (ORDER BY sec, event_id) - 1 AS row_id FROM ev),
    m AS (SELECT count(*) * 2 // 3 AS cut FROM ev), tr AS (SELECT * FROM w, m WHERE row_id < cut), te AS (SELECT * FROM w, m WHERE row_id >= cut),
    dup AS (SELECT count(*)::DOUBLE AS found FROM (SELECT DISTINCT event_type, value FROM te) x
            WHERE EXISTS (SELECT 1 FROM tr WHERE tr.event_type = x.event_type AND tr.value = x.value)),
    k AS (SELECT {_cells('label', 'final_class')} FROM de),
    rows AS (SELECT 'duplicate_rows' AS "check", found FROM dup
      UNION ALL SELECT 'scaler_fitted_outside_train', CASE WHEN (SELECT min(value) FROM tr) <> (SELECT min(value) FROM ev)
                 OR (SELECT max(value) FROM tr) <> (SELECT max(value) FROM ev) THEN 1.0 ELSE 0.0 END
      UNION ALL SELECT 'windows_over_boundary', (SELECT count(*)::DOUBLE FROM (
                 SELECT min(s) OVER o AS lo, max(s) OVER o AS hi FROM (SELECT sec, event_id, (row_id >= cut)::INT AS s FROM w, m)
                 WINDOW o AS (ORDER BY sec, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE lo <> hi)
      UNION ALL SELECT 'suspicious_f1', round(2.0 * tp / (2 * tp + fp + fn), 9) FROM k)
    SELECT "check", found, CASE WHEN "check" = 'suspicious_f1' THEN (found <= 0.95)::INT ELSE (found = 0)::INT END AS passed FROM rows""",
)
def e13_leakage_audit(spark, sf_dir):
    """Audit of a careless set-up: shared rows, scaler fitted on everything, windows over the cut, F1 too good."""
    e = stage(with_row_id(readings(spark, sf_dir), ["sec", "event_id"]), "audit")
    cut = e.count() * 2 // 3
    train, test = e.filter(F.col("row_id") < cut), e.filter(F.col("row_id") >= cut)
    edge_time = train.agg(F.max(F.struct("sec", "event_id")).alias("m")).first()["m"]
    after = (F.col("sec") > edge_time["sec"]) | ((F.col("sec") == edge_time["sec"]) & (F.col("event_id") > edge_time["event_id"]))
    marked = e.drop("row_id").withColumn("split", after.cast("int"))
    audit = evaluate.leakage_audit(
        train, test, ["event_type", "value"], scale.fit_params(e, ["value"]), scale.fit_params(train, ["value"]),
        boundary_windows(marked, "split", 4, ["sec", "event_id"]),
        evaluate.with_metrics(evaluate.confusion(_decided(spark, sf_dir), prediction="final_class")),
    )
    return rounded(audit, "found", digits=9)


# ---------------------------------------------------------------- checklists


@query(
    "g8_readiness",
    f"""WITH {SENSOR_WIDE}, k AS (SELECT count(*) FILTER (WHERE attack = 1) AS n, (SELECT count(*) FROM wide) * 2 // 3 AS loaded,
                                  (SELECT count(*) FROM (SELECT unnest([{", ".join(repr(c) for c in SENSORS)}]) AS s)
                                   WHERE s IN (SELECT unnest([{", ".join(repr(c) for c in C.DENY_LIST)}]))) AS denied
                           FROM wide WHERE row_id >= (SELECT count(*) FROM wide) * 2 // 3)
    SELECT unnest(['data_loaded', 'stabilization_removed', 'deny_list_removed', 'missing_values_handled', 'low_variance_removed',
        'scaler_fitted_on_train', 'data_quality_validated', 'enough_attack_rows']) AS "check",
        unnest([(loaded > 0)::INT, 1, (denied > 0)::INT, 1, 0, 1, 1, (n >= 50)::INT]) AS passed FROM k""",
)
def g8_readiness(spark, sf_dir):
    """Eight checks after preparing the sensor table."""
    wide = stage(sensor_wide(spark, sf_dir), "wide")
    cut = wide.count() * 2 // 3
    train = wide.filter(F.col("row_id") < cut)
    test = wide.filter(F.col("row_id") >= cut).drop("row_id")
    done = prepare_water(train, with_row_id(test, ["minute"]), settle_rows=360, label="attack", exclude=("minute",))
    return profile.readiness(done.facts)


@query(
    "g9_removal_report",
    f"""WITH {SENSOR_WIDE}, cells AS (SELECT {", ".join(f'coalesce("{c}", 0) AS "{c}"' for c in SENSORS)}, 1.0 AS stuck, NULL::DOUBLE AS empty FROM wide),
    s AS ({" UNION ALL ".join(f"""SELECT '{c}' AS name, count("{c}") AS nn, var_samp("{c}") AS v FROM cells""" for c in (*SENSORS, "stuck", "empty"))}),
    d AS (SELECT s.*, name IN (SELECT unnest([{", ".join(repr(n) for n in C.DENY_LIST)}])) AS denied FROM s)
    SELECT 'deny_list' AS reason, (SELECT count(*) FROM d WHERE denied) AS n_features
    UNION ALL SELECT 'all_null', (SELECT count(*) FROM d WHERE NOT denied AND nn = 0)
    UNION ALL SELECT 'low_variance', (SELECT count(*) FROM d WHERE NOT denied AND nn > 0 AND coalesce(v, 0) < 0.001)
    UNION ALL SELECT 'kept', (SELECT count(*) FROM d WHERE NOT denied AND nn > 0 AND v >= 0.001)""",
)
def g9_removal_report(spark, sf_dir):
    """How many features left for which reason."""
    df = impute.fill_constant(sensor_wide(spark, sf_dir, with_id=False).select(*SENSORS), SENSORS)
    df = df.withColumn("stuck", F.lit(1.0)).withColumn("empty", F.lit(None).cast("double"))
    denied, _ = C.split_deny_list(df.columns)
    empty = profile.all_null_columns(df, df, df.columns)
    left = [c for c in df.columns if c not in (*denied, *empty)]
    low = profile.low_variance_columns(profile.column_stats(df.select(*left), left))
    return profile.removal_report(spark, denied, empty, low, [c for c in left if c not in low])


_FLAG_FILLED = ", ".join(
    f"""coalesce(last_value("{c}" IGNORE NULLS) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING),
    first_value("{c}" IGNORE NULLS) OVER (ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS "{c}" """
    for c in SENSORS
)


@query(
    "flagship_cascade",
    f"""WITH {SENSOR_WIDE}, fl AS (SELECT row_id, minute, attack, {_FLAG_FILLED} FROM wide),
    p AS (SELECT {", ".join(f'min("{c}") AS a_{c}, max("{c}") AS b_{c}' for c in SENSORS)} FROM fl WHERE row_id < (SELECT count(*) FROM wide) * 2 // 3),
    s AS (SELECT minute, attack AS label, ({" + ".join(f'("{c}" - a_{c}) / CASE WHEN b_{c} = a_{c} THEN 1 ELSE b_{c} - a_{c} END' for c in SENSORS)}) / 5 AS level FROM fl, p),
    d AS (SELECT label, round(0.25 * label + 0.75 * {uniform_sql("edge", "minute::VARCHAR")} + 0 * level, 6) AS p_edge,
                 round(least(1.0, 0.5 * label + 0.5 * level + 0.25 * {uniform_sql("central", "minute::VARCHAR")}), 6) AS p_central FROM s),
    f AS (SELECT *, {_UNSURE} AS escalated, {_EDGE} AS edge_class, {_REPLACE} AS final_class FROM d),
    c AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE escalated) AS escalated, {_cells('label', 'edge_class', 'edge_')}, {_cells('label', 'final_class')} FROM f)
    SELECT n_rows, escalated, edge_tn, edge_fp, edge_fn, edge_tp, tn, fp, fn, tp, {_metrics('edge_')}, {_metrics()},
      round((CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END
           - CASE WHEN 2 * edge_tp + edge_fp + edge_fn = 0 THEN 0.0 ELSE 2.0 * edge_tp / (2 * edge_tp + edge_fp + edge_fn) END) * 100, 9) AS cascade_gain FROM c""",
)
def flagship_cascade(spark, sf_dir):
    """Readings to a filled and scaled sensor table, two-stage decisions, one row of metrics."""
    filled = impute.ordered_fill(sensor_wide(spark, sf_dir), SENSORS)
    filled = stage(impute.fill_constant(filled, SENSORS), "filled")
    cut = filled.count() * 2 // 3
    params = scale.params_dict(scale.fit_params(filled.filter(F.col("row_id") < cut), SENSORS))
    scaled = scale.apply_params(filled, params)
    level = sum((F.col(c) for c in SENSORS[1:]), F.col(SENSORS[0])) / 5
    p_edge = F.round(0.25 * F.col("attack") + 0.75 * seeded_uniform("edge", "minute") + 0 * level, 6)
    p_central = F.least(F.lit(1.0), 0.5 * F.col("attack") + 0.5 * level + 0.25 * seeded_uniform("central", "minute"))
    s = scaled.select(F.col("attack").alias("label"), p_edge.alias("p_edge"), F.round(p_central, 6).alias("p_central"))
    s = s.select(
        "*", escalate_unsure(F.col("p_edge")).alias("escalated"), predicted(F.col("p_edge")).alias("edge_class"),
        cascade_replace(F.col("p_edge"), predicted(F.col("p_central"))).alias("final_class"),
    )
    report = evaluate.cascade_report(s).drop("escalation_rate")
    return rounded(report, *METRICS, *[f"edge_{m}" for m in METRICS], "cascade_gain", digits=9)
