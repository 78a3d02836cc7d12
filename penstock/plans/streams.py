"""Queries over Structured Streaming runs of the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from penstock.functions.decisions import cascade_confirm, escalate_suspicious
from penstock.functions.draws import seeded_uniform, uniform_sql
from penstock.models import classifiers as M
from penstock.operators.scale import fit_params, load_params, params_dict, save_params
from penstock.plans.inputs import READINGS, rounded, table
from penstock.plans.registry import query
from penstock.session import scratch_path
from penstock.sources.staging import stage
from penstock.streaming import online


def _events(spark, sf_dir):
    return online.read_stream(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema)


_FILES = 5


def _shuffled_events(spark, sf_dir):
    """The events as several files in order of arrival, one per micro-batch: each row arrives up to nine minutes late."""
    e = table(spark, sf_dir, "events")
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + seeded_uniform("delay", "event_id") * 540e6
    late = stage(e.withColumn("_arrival", arrival), "arrivals")
    low, high = late.agg(F.min("_arrival"), F.max("_arrival")).first()
    part = F.least(F.floor((F.col("_arrival") - low) / (high - low + 1) * _FILES), F.lit(_FILES - 1))
    path = scratch_path(spark, "arrivals")
    for k in range(_FILES):
        late.filter(part == k).drop("_arrival").coalesce(1).write.mode("append").parquet(path)
    return online.read_stream(spark, path, e.schema, max_files=1)


def _stored_params(spark, sf_dir):
    """Scaler of the training period, through its stored table."""
    path = scratch_path(spark, "online-scaler")
    e = table(spark, sf_dir, "events")
    save_params(fit_params(e.filter(F.col("event_type") != "error"), ["value"]), path)
    return params_dict(load_params(spark, path))


_P_EDGE = f"round(0.6 * value + 0.4 * {uniform_sql('edge', 'event_id::VARCHAR')}, 6)"
_P_CENTRAL = f"round(least(1.0, 0.5 * value + {uniform_sql('central', 'event_id::VARCHAR')}), 6)"


@query(
    "t1_online_scoring",
    f"""WITH p AS (SELECT min(value) AS a, max(value) AS b FROM events WHERE event_type <> 'error'),
    s AS (SELECT event_id, (value - a) / (b - a) AS value FROM events, p),
    d AS (SELECT event_id, value, {_P_EDGE} AS p_edge, {_P_CENTRAL} AS p_central FROM s)
    SELECT event_id, round(value, 6) AS value, (p_edge > 0.3)::INT AS escalated, (p_edge > 0.3 AND p_central >= 0.95)::INT AS alarm FROM d""",
)
def t1_online_scoring(spark, sf_dir):
    """Stream of readings, stored scaler, two-stage decision."""

    def decide(df):
        p_edge = F.round(0.6 * F.col("value") + 0.4 * seeded_uniform("edge", "event_id"), 6)
        p_central = F.round(F.least(F.lit(1.0), 0.5 * F.col("value") + seeded_uniform("central", "event_id")), 6)
        return df.select(
            "event_id", F.round("value", 6).alias("value"), escalate_suspicious(p_edge).cast("int").alias("escalated"),
            cascade_confirm(p_edge, p_central).alias("alarm"),
        )

    scored = online.score_online(_events(spark, sf_dir), _stored_params(spark, sf_dir), decide, ["event_id"])
    return online.run_available(scored, "t1")


@query("t1_online_model")
def t1_online_model(spark, sf_dir):
    """Stream of readings scored by a model that was saved and loaded again."""
    params = _stored_params(spark, sf_dir)
    e = table(spark, sf_dir, "events").select("value", (F.col("event_type") == "error").cast("int").alias("label"))
    lone = e.withColumn("value", (F.col("value") - params["value"]["min"]) / (params["value"]["max"] - params["value"]["min"]))
    path = scratch_path(spark, "online-model")
    M.fit_logistic(M.assemble(lone, ["value"])).save(path)
    scorer = M.load_scorer(spark, path)

    def decide(df):
        return scorer.classify(M.assemble(df, ["value"])).drop("features")

    return rounded(online.run_available(online.score_online(_events(spark, sf_dir), params, decide, ["event_id"]), "t1m"), "p", "value")


@query(
    "t2_recent_rows",
    """WITH m AS (SELECT (epoch_ms(max(ts)) - 600000) * 1000 AS mark FROM events),
    r AS (SELECT user_id AS entity, epoch_us(ts) AS "at", avg(value) OVER w AS mean, count(*) OVER w AS n
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value ROWS 3 PRECEDING))
    SELECT entity, "at", round(mean, 6) AS mean, n FROM r, m WHERE "at" < mark""",
)
def t2_recent_rows(spark, sf_dir):
    """Mean of the last four readings per entity over several micro-batches with rows out of order; readings the watermark has passed."""
    return rounded(online.run_available(online.recent_rows(_shuffled_events(spark, sf_dir), "user_id", "ts", "value"), "t2"), "mean")


@query(
    "t3_escalation_monitor",
    f"""WITH {READINGS}, m AS (SELECT max(epoch_us(ts)) - 600000000 AS mark FROM events)
    SELECT sec // 3600 * 3600 AS window_start, count(*) AS n_rows, count(*) FILTER (WHERE {uniform_sql("edge", "event_id::VARCHAR")} > 0.7) AS escalated
    FROM ev, m GROUP BY 1, mark HAVING (sec // 3600 * 3600 + 3600) * 1000000 <= mark""",
)
def t3_escalation_monitor(spark, sf_dir):
    """Escalated readings per hour; hours the watermark has passed."""
    stream = _shuffled_events(spark, sf_dir).withColumn("escalated", seeded_uniform("edge", "event_id") > 0.7)
    return online.run_available(online.escalation_monitor(stream, "ts", "escalated"), "t3")
