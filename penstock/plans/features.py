"""Queries over windowed features, feature selection and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from penstock.functions.draws import hash_sql, uniform_sql
from penstock.operators import selection, splits, windows
from penstock.operators.columns import to_long
from penstock.operators.episodes import with_episode
from penstock.operators.ordering import quantiles, with_row_id
from penstock.operators.scale import fit_params, params_dict
from penstock.plans.flows import combine_training
from penstock.plans.inputs import (
    MEASURES,
    READINGS,
    SENSOR_WIDE,
    SENSORS,
    VECTORS,
    readings,
    rounded,
    sensor_wide,
    table,
    unpivot_sql,
    vector_columns,
    vectors,
)
from penstock.plans.registry import query
from penstock.sources.staging import stage
from penstock.streaming.drift import drift_by_period


def _by_user(spark, sf_dir):
    return windows.sequence(readings(spark, sf_dir), ["sec", "event_id"], ["user_id"])


_U = "PARTITION BY user_id ORDER BY sec, event_id"


@query(
    "w1_lags",
    f"""WITH {READINGS} SELECT event_id, lag(value, 1) OVER ({_U}) AS value_lag1, lag(value, 2) OVER ({_U}) AS value_lag2 FROM ev""",
)
def w1_lags(spark, sf_dir):
    """Readings one and two steps back, per entity."""
    df = windows.lags(_by_user(spark, sf_dir), ["value"], (1, 2), partition=["user_id"])
    return df.select("event_id", "value_lag1", "value_lag2")


@query(
    "w2_rolling_mean_std",
    f"""WITH {READINGS} SELECT event_id, round(avg(value) OVER ({_U} ROWS 4 PRECEDING), 9) AS value_mean5,
        round(stddev_samp(value) OVER ({_U} ROWS 4 PRECEDING), 6) AS value_std5 FROM ev""",
)
def w2_rolling_mean_std(spark, sf_dir):
    """Mean and deviation of the last five readings, per entity."""
    df = windows.rolling(_by_user(spark, sf_dir), ["value"], 5, partition=["user_id"])
    return rounded(rounded(df.select("event_id", "value_mean5", "value_std5"), "value_mean5", digits=9), "value_std5")


@query(
    "w3_sliding_stats",
    f"""WITH {SENSOR_WIDE}, f AS (SELECT row_id, coalesce("view", 0) AS view FROM wide)
    SELECT row_id, round(avg(view) OVER w, 9) AS view_mean20, round(stddev_samp(view) OVER w, 6) AS view_std20,
           min(view) OVER w AS view_min20, max(view) OVER w AS view_max20
    FROM f WINDOW w AS (ORDER BY row_id ROWS 19 PRECEDING)""",
)
def w3_sliding_stats(spark, sf_dir):
    """Four statistics over 20 rows, without an entity: bounded blocks with context rows."""
    df = sensor_wide(spark, sf_dir).select("row_id", F.coalesce("view", F.lit(0.0)).alias("view"))
    df = windows.rolling(df, ["view"], 20, ("mean", "std", "min", "max"), block_rows=1024)
    out = df.select("row_id", "view_mean20", "view_std20", "view_min20", "view_max20")
    return rounded(rounded(out, "view_mean20", digits=9), "view_std20")


@query(
    "w4_complete_windows",
    f"""WITH {SENSOR_WIDE}, f AS (SELECT row_id, (row_id >= (SELECT count(*) FROM wide) * 2 // 3)::INT AS split, coalesce("click", 0) AS click FROM wide),
    x AS (SELECT row_id, split, avg(click) OVER w AS m, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY split ORDER BY row_id ROWS 3 PRECEDING))
    SELECT row_id, split, round(m, 9) AS click_mean4 FROM x WHERE n = 4""",
)
def w4_complete_windows(spark, sf_dir):
    """Windows stay inside their split and incomplete ones are dropped."""
    df = stage(sensor_wide(spark, sf_dir), "wide")
    cut = df.count() * 2 // 3
    df = df.select("row_id", (F.col("row_id") >= cut).cast("int").alias("split"), F.coalesce("click", F.lit(0.0)).alias("click"))
    done = windows.rolling(df, ["click"], 4, ("mean",), complete=True, partition=["split"], block_rows=1024)
    return rounded(done.select("row_id", "split", "click_mean4"), "click_mean4", digits=9)


@query(
    "w5_transitions",
    f"""WITH {SENSOR_WIDE}, s AS (SELECT row_id, ("view" IS NOT NULL)::INT AS pump FROM wide),
    c AS (SELECT *, coalesce((pump <> lag(pump) OVER (ORDER BY row_id))::INT, 0) AS pump_changed FROM s)
    SELECT row_id, pump, pump_changed, sum(pump_changed) OVER (ORDER BY row_id ROWS 9 PRECEDING)::BIGINT AS pump_changes10 FROM c""",
)
def w5_transitions(spark, sf_dir):
    """On/off changes and their count over ten rows."""
    df = sensor_wide(spark, sf_dir).select("row_id", F.col("view").isNotNull().cast("int").alias("pump"))
    return windows.transitions(df, ["pump"], 10, block_rows=2048)


@query(
    "w6_process_features",
    f"""WITH {SENSOR_WIDE}, f AS (SELECT row_id, minute, "view" AS level, coalesce("click", 0) AS up, coalesce("signup", 0) AS down FROM wide)
    SELECT row_id, CASE WHEN level < 20 THEN 'low' WHEN level > 60 THEN 'high' WHEN level IS NOT NULL THEN 'normal' END AS state,
           round(up - down, 6) AS gradient,
           round(CASE WHEN isnan(regr_slope(up, minute) OVER w) THEN NULL ELSE regr_slope(up, minute) OVER w END, 6) AS up_slope8
    FROM f WINDOW w AS (ORDER BY row_id ROWS 7 PRECEDING)""",
)
def w6_process_features(spark, sf_dir):
    """Level state, gradient between two readings, and trend."""
    df = sensor_wide(spark, sf_dir).select(
        "row_id", "minute", F.col("view").alias("level"), F.coalesce("click", F.lit(0.0)).alias("up"),
        F.coalesce("signup", F.lit(0.0)).alias("down"),
    )
    df = windows.trend(df, "up", "minute", 8)
    return rounded(
        df.select(
            "row_id", windows.level_state(F.col("level"), 20, 60).alias("state"),
            windows.gradient(F.col("up"), F.col("down")).alias("gradient"), "up_slope8",
        ),
        "gradient", "up_slope8",
    )


@query("w7_spectral_cleaning")
def w7_spectral_cleaning(spark, sf_dir):
    """Spectral-residual outliers per sensor, in overlapping blocks numbered inside the sensor, replaced by the mode."""
    e = readings(spark, sf_dir).select(F.col("event_type").alias("sensor"), "sec", "event_id", "value")
    ordered = with_row_id(e, ["sensor", "sec", "event_id"])
    cleaned = windows.clean_outliers(ordered.select("sensor", "row_id", "value"))
    return rounded(cleaned, "value", "cleaned")


# ---------------------------------------------------------------- feature selection


def _line_long(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_linestatus", *MEASURES)
    return to_long(li, MEASURES, ["l_linestatus"])


@query(
    "fs1_ks_shift",
    f"""WITH l AS ({unpivot_sql(MEASURES, "lineitem", ["l_linestatus"])}),
    n AS (SELECT feature, count(*) FILTER (WHERE l_linestatus = 'F') AS na, count(*) FILTER (WHERE l_linestatus <> 'F') AS nb FROM l GROUP BY 1),
    g AS (SELECT feature, value, count(*) FILTER (WHERE l_linestatus = 'F') AS a, count(*) FILTER (WHERE l_linestatus <> 'F') AS b FROM l GROUP BY 1, 2),
    c AS (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM g WINDOW w AS (PARTITION BY feature ORDER BY value))
    SELECT feature, na AS n_first, nb AS n_second, round(max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)), 9) AS d FROM c JOIN n USING (feature) GROUP BY ALL""",
)
def fs1_ks_shift(spark, sf_dir):
    """Two-sample Kolmogorov-Smirnov distance of each column between the splits."""
    found = selection.ks_two_sample(_line_long(spark, sf_dir), F.col("l_linestatus") != "F")
    return rounded(found.drop("p_value"), "d", digits=9)


@query(
    "fs1_ks_p_values",
    f"""WITH l AS ({unpivot_sql(MEASURES, "lineitem", ["l_linestatus"])}),
    n AS (SELECT feature, count(*) FILTER (WHERE l_linestatus = 'F') AS na, count(*) FILTER (WHERE l_linestatus <> 'F') AS nb FROM l GROUP BY 1),
    g AS (SELECT feature, value, count(*) FILTER (WHERE l_linestatus = 'F') AS a, count(*) FILTER (WHERE l_linestatus <> 'F') AS b FROM l GROUP BY 1, 2),
    c AS (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM g WINDOW w AS (PARTITION BY feature ORDER BY value)),
    d AS (SELECT feature, na, nb, max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)) AS d FROM c JOIN n USING (feature) GROUP BY ALL),
    x AS (SELECT feature, d, sqrt(na * nb / (na + nb)::DOUBLE) * d AS x FROM d),
    t AS (SELECT feature, d, CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0,
          2.0 * list_sum([(CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * x * x) for j in range(1, 101)]))) END AS p FROM x)
    SELECT feature, round(d, 9) AS d, round(p, 6) AS p_value, (p < 0.05)::INT AS drop_feature FROM t""",
)
def fs1_ks_p_values(spark, sf_dir):
    """The same with the asymptotic p-value and the verdict at 5 %."""
    found = selection.ks_two_sample(_line_long(spark, sf_dir), F.col("l_linestatus") != "F")
    found = found.withColumn("drop_feature", (F.col("p_value") < selection.KS_P_VALUE).cast("int"))
    return rounded(rounded(found.select("feature", "d", "p_value", "drop_feature"), "p_value"), "d", digits=9)


_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS feature, '{b}' AS other, corr({a}, {b}) AS c FROM lineitem" for a in MEASURES for b in MEASURES if a != b
)


@query(
    "fs2_top_correlated",
    f"""WITH p AS ({_PAIRS}), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(abs(c), 9) DESC, other) AS rank FROM p)
    SELECT feature, other, round(c, 7) AS correlation, rank FROM r WHERE rank <= 2""",
)
def fs2_top_correlated(spark, sf_dir):
    """The two most correlated columns of each column."""
    corr = selection.correlations(table(spark, sf_dir, "lineitem"), MEASURES)
    return rounded(selection.top_correlated(corr, 2), "correlation", digits=7)


@query(
    "fs3_drop_redundant",
    f"""WITH {SENSOR_WIDE}, f AS (SELECT coalesce(click, 0) AS a, coalesce(view, 0) AS b, coalesce(click, 0) * 3 + 1 AS c,
                                        coalesce(view, 0) + minute % 2 AS d FROM sw),
    r AS (SELECT abs(corr(b, a)) > {selection.REDUNDANT_CORRELATION} AS ba, abs(corr(c, a)) > {selection.REDUNDANT_CORRELATION} AS ca,
                 abs(corr(c, b)) > {selection.REDUNDANT_CORRELATION} AS cb, abs(corr(d, a)) > {selection.REDUNDANT_CORRELATION} AS da,
                 abs(corr(d, b)) > {selection.REDUNDANT_CORRELATION} AS db, abs(corr(d, c)) > {selection.REDUNDANT_CORRELATION} AS dc FROM f),
    kb AS (SELECT *, NOT ba AS kb FROM r), kc AS (SELECT *, NOT (ca OR (kb AND cb)) AS kc FROM kb),
    kd AS (SELECT *, NOT (da OR (kb AND db) OR (kc AND dc)) AS kd FROM kc)
    SELECT unnest(['click', 'view', 'click_scaled', 'view_noisy']) AS feature, unnest([0, (NOT kb)::INT, (NOT kc)::INT, (NOT kd)::INT]) AS dropped,
           (SELECT count(*) FROM sw) AS n_rows FROM kd""",
)
def fs3_drop_redundant(spark, sf_dir):
    """Columns that repeat an earlier one leave."""
    df = sensor_wide(spark, sf_dir, with_id=False).fillna(0.0)
    df = df.select(
        "click", "view", (F.col("click") * 3 + 1).alias("click_scaled"), (F.col("view") + F.col("minute") % 2).alias("view_noisy")
    )
    gone = selection.redundant_features(selection.correlations(df, df.columns), df.columns)
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(int(c in gone)).alias("dropped")) for c in df.columns])
    return n.select(F.explode(rows).alias("r"), "n_rows").select("r.*", "n_rows")


_FEATURES = [f"f{i}" for i in range(64)]
_LONG = VECTORS + """,
lo AS (SELECT label, 'f' || (i - 1)::VARCHAR AS feature, vec[i] AS value FROM v, range(1, 65) t(i)),
rg AS (SELECT feature, min(value) AS a, max(value) AS b FROM lo GROUP BY 1),
bi AS (SELECT feature, label, greatest(0, least(9, floor((value - a) * 10 / CASE WHEN b = a THEN 1 ELSE b - a END)::INT)) AS bin FROM lo JOIN rg USING (feature)),
ct AS (SELECT feature, bin, label, count(*)::DOUBLE AS n FROM bi GROUP BY ALL),
sm AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS r, sum(n) OVER (PARTITION BY feature, label) AS c FROM ct),
sc AS (SELECT feature, max(t) * (sum(n * n / (r * c)) - 1) AS chi2, sum(n / t * log2(n * t / (r * c))) AS info_gain, sum(-n / t * log2(r / t)) AS h FROM sm GROUP BY 1),
gm AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM lo GROUP BY ALL),
an AS (SELECT feature, ((sum(n * m * m) - sum(n) * pow(sum(n * m) / sum(n), 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS anova_f FROM gm GROUP BY 1),
co AS (SELECT feature, abs(corr(value, label)) AS abs_corr FROM lo GROUP BY 1),
al AS (SELECT feature, chi2, info_gain, CASE WHEN h = 0 THEN 0 ELSE info_gain / h END AS gain_ratio, abs_corr, anova_f FROM sc JOIN an USING (feature) JOIN co USING (feature))"""


def _scores(spark, sf_dir):
    df, names = vector_columns(spark, sf_dir)
    params = params_dict(fit_params(df, names))
    tests = selection.contingency_scores(selection.binned_counts(df, params))
    return tests.join(selection.moment_scores(df, names), "feature")


@query(
    "fs4_feature_scores",
    f"""WITH {_LONG} SELECT feature, round(chi2, 6) AS chi2, round(info_gain, 8) AS info_gain, round(gain_ratio, 8) AS gain_ratio,
        round(abs_corr, 8) AS abs_corr, round(anova_f, 5) AS anova_f FROM al""",
)
def fs4_feature_scores(spark, sf_dir):
    """Chi-square, information gain, gain ratio, correlation and F value of each feature."""
    s = _scores(spark, sf_dir)
    s = rounded(rounded(rounded(s, "chi2"), "anova_f", digits=5), "info_gain", "gain_ratio", "abs_corr", digits=8)
    return s.select("feature", "chi2", "info_gain", "gain_ratio", "abs_corr", "anova_f")


_METHODS = ("chi2", "info_gain", "gain_ratio", "abs_corr", "anova_f")


@query(
    "fs4_vote",
    f"""WITH {_LONG}, rk AS (SELECT feature, {" + ".join(f"rank() OVER (ORDER BY round({m}, 9) DESC)" for m in _METHODS)} AS rank_sum FROM al),
    pl AS (SELECT feature, rank_sum::BIGINT AS rank_sum, row_number() OVER (ORDER BY rank_sum, feature) AS place FROM rk)
    SELECT * FROM pl WHERE place <= 20""",
)
def fs4_vote(spark, sf_dir):
    """Rank-sum vote of the five tests, best 20 features."""
    return selection.vote(_scores(spark, sf_dir), _METHODS, 20)


_RELIEFF = """
    d AS (SELECT a.id, b.id AS neighbor, a.label = b.label AS hit, list_distance(a.vec, b.vec) AS distance, a.vec AS x, b.vec AS y
          FROM v a JOIN v b ON a.id <> b.id),
    nr AS (SELECT *, row_number() OVER (PARTITION BY id, hit ORDER BY distance, neighbor) AS rank FROM d),
    q AS (SELECT hit, i, abs(x[i] - y[i]) AS diff FROM nr, range(1, 65) t(i) WHERE rank <= 5),
    rf AS (SELECT 'f' || (i - 1)::VARCHAR AS feature, avg(diff) FILTER (WHERE NOT hit) - avg(diff) FILTER (WHERE hit) AS relieff FROM q GROUP BY i)"""


@query(
    "fs4_vote_with_relieff",
    f"""WITH {_LONG}, {_RELIEFF},
    rk AS (SELECT feature, {" + ".join(f"rank() OVER (ORDER BY round({m}, 9) DESC)" for m in (*_METHODS, "relieff"))} AS rank_sum FROM al JOIN rf USING (feature)),
    pl AS (SELECT feature, rank_sum::BIGINT AS rank_sum, row_number() OVER (ORDER BY rank_sum, feature) AS place FROM rk)
    SELECT * FROM pl WHERE place <= 20""",
)
def fs4_vote_with_relieff(spark, sf_dir):
    """The vote with ReliefF as a sixth test."""
    weights = selection.relieff(vectors(spark, sf_dir), _FEATURES, k=5)
    return selection.vote(stage(_scores(spark, sf_dir).join(weights, "feature"), "votes"), (*_METHODS, "relieff"), 20)


@query(
    "fs4_relieff",
    f"WITH {VECTORS}, {_RELIEFF} SELECT feature, round(relieff, 8) AS relieff FROM rf",
)
def fs4_relieff(spark, sf_dir):
    """ReliefF weights from nearest hits and misses of all rows."""
    return rounded(selection.relieff(vectors(spark, sf_dir), _FEATURES, k=5), "relieff", digits=8)


@query(
    "fs4_relieff_anchored",
    f"""WITH {VECTORS}, an AS (SELECT id FROM v ORDER BY {hash_sql("relieff", "id::VARCHAR")}, id LIMIT {selection.RELIEFF_ANCHORS}),
    {_RELIEFF.replace("FROM v a JOIN v b ON a.id <> b.id", "FROM v a JOIN v b ON a.id <> b.id WHERE a.id IN (SELECT id FROM an)")}
    SELECT feature, round(relieff, 8) AS relieff FROM rf""",
)
def fs4_relieff_anchored(spark, sf_dir):
    """ReliefF weights from the nearest hits and misses, among all rows, of a bounded set of seeded anchors."""
    weights = selection.relieff(vectors(spark, sf_dir), _FEATURES, k=5, anchors=selection.RELIEFF_ANCHORS)
    return rounded(weights, "relieff", digits=8)


@query("fs5_pca_variance")
def fs5_pca_variance(spark, sf_dir):
    """Explained variance of eight components: Gram matrix by one aggregate, Jacobi rotations."""
    return rounded(selection.pca_jacobi(vectors(spark, sf_dir), "vec")[1], "explained")


@query(
    "fs5_pca_two_measures",
    """WITH c AS (SELECT var_samp(embedding[1]) AS a, var_samp(embedding[2]) AS d, covar_samp(embedding[1], embedding[2]) AS b FROM embeddings),
    e AS (SELECT (a + d) / 2 AS m, sqrt(((a - d) / 2) ^ 2 + b ^ 2) AS r, a + d AS t FROM c)
    SELECT 1 AS component, round((m + r) / t, 6) AS explained FROM e UNION ALL SELECT 2, round((m - r) / t, 6) FROM e""",
)
def fs5_pca_two_measures(spark, sf_dir):
    """Explained variance of the first two vector components, whose eigenvalues have a closed form."""
    two = vectors(spark, sf_dir).select(F.slice("vec", 1, 2).alias("vec"))
    return rounded(selection.pca_jacobi(two, "vec", 2)[1], "explained")


@query(
    "fs6_name_priority",
    """WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '1_FIT_001_PV' WHEN 1 THEN '2_LT_002_PV' WHEN 2 THEN '1_AIT_004_PV'
                       WHEN 3 THEN '2_SV_101_STATUS' ELSE '3_P_004_SPEED' END AS sensor FROM part)
    SELECT sensor, CASE p_partkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'other' END AS tier,
           count(*) AS n FROM s GROUP BY ALL""",
)
def fs6_name_priority(spark, sf_dir):
    """Tier from the instrument code in the sensor name."""
    names = "CASE p_partkey % 5 WHEN 0 THEN '1_FIT_001_PV' WHEN 1 THEN '2_LT_002_PV' WHEN 2 THEN '1_AIT_004_PV' WHEN 3 THEN '2_SV_101_STATUS' ELSE '3_P_004_SPEED' END"
    parts = table(spark, sf_dir, "part").select(F.expr(names).alias("sensor"))
    return parts.groupBy("sensor", selection.priority(F.col("sensor")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "u4_state_overlap",
    f"""WITH {READINGS}, s AS (SELECT minute // 60 AS hour, sec, event_type, user_id % 20 AS valve FROM ev),
    m AS (SELECT quantile_cont(sec, 0.6) AS cut FROM ev), a AS (SELECT DISTINCT event_type, valve, hour % 24 AS h FROM s, m WHERE sec < cut),
    b AS (SELECT DISTINCT event_type, valve, hour % 24 AS h FROM s, m WHERE sec >= cut)
    SELECT (SELECT count(*) FROM a) AS train_states, (SELECT count(*) FROM b) AS test_states, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS shared,
           (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS unseen,
           round(100.0 * (SELECT count(*) FROM (FROM a INTERSECT FROM b)) / (SELECT count(*) FROM b), 9) AS pct_shared""",
)
def u4_state_overlap(spark, sf_dir):
    """Share of actuator-state tuples of the test period already seen in training."""
    e = readings(spark, sf_dir)
    cut = quantiles(e, "sec", [0.6]).first()["quantile"]
    s = e.select("sec", "event_type", (F.col("user_id") % 20).alias("valve"), (F.floor(F.col("minute") / 60) % 24).alias("h"))
    found = selection.state_overlap(s.filter(F.col("sec") < cut), s.filter(F.col("sec") >= cut), ["event_type", "valve", "h"])
    return rounded(found, "pct_shared", digits=9)


# ---------------------------------------------------------------- splits


@query(
    "v1_temporal_split",
    f"""WITH {READINGS}, m AS (SELECT quantile_cont(sec, 0.95) AS cut FROM ev)
    SELECT event_id, CASE WHEN sec < cut - 60 THEN 'train' ELSE 'validation' END AS split FROM ev, m WHERE sec < cut - 60 OR sec >= cut""",
)
def v1_temporal_split(spark, sf_dir):
    """95/5 in time with a gap of 60 seconds."""
    return splits.temporal_split(readings(spark, sf_dir), "sec").select("event_id", "split")


def _edges_sql(n: int) -> str:
    return f"""e0 AS (SELECT min(sec) AS low, max(sec) - min(sec) + 1 AS span FROM ev),
    ed AS (SELECT b, low + (span * b + {n} - 1) // {n} AS a, low + (span * (b + 1) + {n} - 1) // {n} AS z FROM e0, range({n}) t(b))"""


def _fold_counts(df):
    return df.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec")
    )


@query(
    "v2_expanding_folds",
    f"""WITH {READINGS}, {_edges_sql(6)}, f AS (SELECT b AS fold, CASE WHEN sec < a - 3600 THEN 'train' WHEN sec >= a AND sec < z THEN 'test' END AS role, sec
        FROM ev, ed WHERE b >= 1)
    SELECT fold, role, count(*) AS n, min(sec) AS first_sec, max(sec) AS last_sec FROM f WHERE role IS NOT NULL GROUP BY ALL""",
)
def v2_expanding_folds(spark, sf_dir):
    """Five folds with a growing training period and a gap of an hour."""
    return _fold_counts(splits.expanding_folds(readings(spark, sf_dir), "sec", 5, 3600))


@query(
    "v3_blocked_folds",
    f"""WITH {READINGS}, {_edges_sql(5)}, f AS (SELECT b + 1 AS fold, CASE WHEN sec >= a AND sec < z THEN 'test' WHEN sec < a - 7200 OR sec >= z + 7200 THEN 'train' END AS role, sec
        FROM ev, ed)
    SELECT fold, role, count(*) AS n, min(sec) AS first_sec, max(sec) AS last_sec FROM f WHERE role IS NOT NULL GROUP BY ALL""",
)
def v3_blocked_folds(spark, sf_dir):
    """Five contiguous test blocks; training on the rest less two hours on both sides."""
    return _fold_counts(splits.blocked_folds(readings(spark, sf_dir), "sec", 5, 7200))


@query(
    "v4_walk_forward_folds",
    f"""WITH {READINGS}, {_edges_sql(6)}, f AS (SELECT t.b - 1 AS fold, CASE WHEN sec >= p.a AND sec < t.a - 1800 THEN 'train' WHEN sec >= t.a AND sec < t.z THEN 'test' END AS role, sec
        FROM ev, ed t JOIN ed p ON p.b = t.b - 2)
    SELECT fold, role, count(*) AS n, min(sec) AS first_sec, max(sec) AS last_sec FROM f WHERE role IS NOT NULL GROUP BY ALL""",
)
def v4_walk_forward_folds(spark, sf_dir):
    """Four folds that slide: two blocks train, the next one tests."""
    return _fold_counts(splits.walk_forward_folds(readings(spark, sf_dir), "sec", 4, 1800, train_blocks=2))


@query(
    "u1_training_sets",
    f"""WITH {SENSOR_WIDE}, c AS (SELECT *, row_id >= (SELECT count(*) FROM wide) * 2 // 3 AS late FROM wide),
    f AS (SELECT row_id, {uniform_sql("episode", "(minute - row_number() OVER (ORDER BY minute) + 1)::VARCHAR")} < 0.5 AS held FROM c WHERE late AND attack = 1),
    r AS (SELECT 'reference' AS mode, 'train' AS side, 0 AS label, count(*) AS n FROM c WHERE NOT late AND attack = 0
      UNION ALL SELECT 'reference', 'train', 1, count(*) FROM f UNION ALL SELECT 'reference', 'test', attack, count(*) FROM c WHERE late GROUP BY attack
      UNION ALL SELECT 'holdout', 'train', 0, count(*) FROM c WHERE NOT late AND attack = 0
      UNION ALL SELECT 'holdout', 'train', 1, count(*) FROM f WHERE NOT held UNION ALL SELECT 'holdout', 'test', 0, count(*) FROM c WHERE late AND attack = 0
      UNION ALL SELECT 'holdout', 'test', 1, count(*) FROM f WHERE held)
    SELECT * FROM r""",
)
def u1_training_sets(spark, sf_dir):
    """Training and evaluation rows of both modes: all test attacks reused, or whole episodes held out."""
    df = stage(sensor_wide(spark, sf_dir), "wide")
    cut = df.count() * 2 // 3
    normal = df.filter((F.col("row_id") < cut) & (F.col("attack") == 0)).select("minute", "view")
    mixed = df.filter(F.col("row_id") >= cut).select("minute", "view", F.col("attack").alias("label"))
    out = None
    for mode in ("reference", "holdout"):
        for side, rows in zip(("train", "test"), combine_training(normal, mixed, "minute", mode)):
            one = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
            one = one.select(F.lit(mode).alias("mode"), F.lit(side).alias("side"), "label", "n")
            out = one if out is None else out.unionByName(one)
    return out


@query(
    "u1_episode_holdout",
    f"""WITH {SENSOR_WIDE}, f AS (SELECT minute, minute - row_number() OVER (ORDER BY minute) + 1 AS episode FROM sw WHERE attack = 1)
    SELECT minute, episode, ({uniform_sql("episode", "episode::VARCHAR")} < 0.5)::INT AS held_out FROM f""",
)
def u1_episode_holdout(spark, sf_dir):
    """Before stacking, whole attack episodes are held out, so that no episode is on both sides."""
    runs = with_episode(sensor_wide(spark, sf_dir, with_id=False).select("minute", "attack"), "attack", "minute")
    return splits.episode_holdout(runs, 0.5).select("minute", "episode", "held_out")


@query(
    "t4_drift_by_day",
    f"""WITH {READINGS}, b AS (SELECT min(minute) // 1440 AS d0 FROM ev),
    base AS (SELECT event_type AS sensor, value FROM ev, b WHERE minute // 1440 < d0 + 10),
    cur AS (SELECT event_type AS sensor, minute // 1440 AS day, value FROM ev, b WHERE minute // 1440 >= d0 + 10),
    k AS (SELECT DISTINCT sensor, day FROM cur),
    al AS (SELECT sensor, day, value, 0 AS s FROM base JOIN k USING (sensor) UNION ALL SELECT sensor, day, value, 1 FROM cur),
    n AS (SELECT sensor, day, count(*) FILTER (WHERE s = 0) AS na, count(*) FILTER (WHERE s = 1) AS nb FROM al GROUP BY ALL),
    g AS (SELECT sensor, day, value, count(*) FILTER (WHERE s = 0) AS a, count(*) FILTER (WHERE s = 1) AS b FROM al GROUP BY ALL),
    c AS (SELECT sensor, day, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM g WINDOW w AS (PARTITION BY sensor, day ORDER BY value))
    SELECT sensor, day, nb AS n_current, round(max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)), 9) AS d FROM c JOIN n USING (sensor, day) GROUP BY ALL""",
)
def t4_drift_by_day(spark, sf_dir):
    """Distance of each day's distribution from the training baseline, per sensor."""
    e = readings(spark, sf_dir).select(
        F.col("event_type").alias("sensor"), F.floor(F.col("minute") / 1440).cast("long").alias("day"), "value"
    )
    start = e.agg(F.min("day")).first()[0]
    found = drift_by_period(e.filter(F.col("day") < start + 10), e.filter(F.col("day") >= start + 10), "sensor", "day", "value")
    return rounded(found.select("sensor", "day", "n_current", "d"), "d", digits=9)
