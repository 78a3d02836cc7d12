"""Queries over sampling, class balance and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from penstock.functions.draws import hash_sql, uniform_sql
from penstock.operators import sampling
from penstock.operators.neighbors import knn_classify, knn_join
from penstock.operators.ordering import with_row_id
from penstock.operators.smote import synthetic_rows, balance
from penstock.plans.inputs import (
    LINE_ITEMS,
    READINGS,
    SENSOR_WIDE,
    SENSORS,
    VECTORS,
    line_items,
    readings,
    rounded,
    sensor_wide,
    table,
    vectors,
)
from penstock.plans.registry import query
from penstock.sources.staging import stage


def _quota_cte(source: str, label: str, total: str) -> str:
    """CTEs cnt, quo: exact proportional quotas by largest remainder."""
    return f"""cnt AS (SELECT {label} AS label, count(*) AS n FROM {source} GROUP BY 1),
    tot AS (SELECT sum(n) AS all_rows, ({total})::BIGINT AS total FROM cnt),
    fair AS (SELECT label, n, n * total / all_rows::DOUBLE AS f, total FROM cnt, tot),
    rest AS (SELECT label, n, floor(f)::BIGINT AS whole, round(f - floor(f), 9) AS r, total FROM fair),
    quo AS (SELECT label, n, whole + CASE WHEN row_number() OVER (ORDER BY r DESC, label)
                   <= total - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM rest)"""


_RANKED = f"""rk AS (SELECT row_key, l_returnflag AS label,
      row_number() OVER (PARTITION BY l_returnflag ORDER BY {hash_sql(42, "row_key")}, row_key) AS r FROM lk)"""


def _keyed_classes(spark, sf_dir):
    """Row key and class of each line item; staged because the sampler passes over it more than once."""
    return stage(line_items(spark, sf_dir).select("row_key", F.col("l_returnflag").alias("label")), "keyed")


@query(
    "m2_stratified_sample",
    f"""WITH {LINE_ITEMS}, {_quota_cte("lk", "l_returnflag", "floor(sum(n) * 0.15)")}, {_RANKED}
    SELECT row_key, rk.label FROM rk JOIN quo ON rk.label = quo.label WHERE r <= quota""",
)
def m2_stratified_sample(spark, sf_dir):
    """15 % of each class without replacement, exactly."""
    li = _keyed_classes(spark, sf_dir)
    return sampling.stratified_sample(li, ["label"], 0.15, ["row_key"])


@query(
    "m3_stratified_bootstrap",
    f"""WITH {LINE_ITEMS}, {_quota_cte("lk", "l_returnflag", "floor(sum(n) * 0.1)")},
    ranked AS (SELECT row_key, l_returnflag AS label, row_number() OVER (PARTITION BY l_returnflag ORDER BY row_key) - 1 AS k FROM lk),
    offs AS (SELECT label, n, quota, coalesce(sum(quota) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM quo),
    draws AS (SELECT label, start + j AS draw, floor({uniform_sql(42, "label || ':' || j::VARCHAR")} * n)::BIGINT AS k
              FROM (SELECT label, n, start, unnest(range(quota)) AS j FROM offs))
    SELECT draw, row_key, d.label FROM draws d JOIN ranked r ON d.label = r.label AND d.k = r.k""",
)
def m3_stratified_bootstrap(spark, sf_dir):
    """10 % draws with replacement, class shares kept exactly."""
    li = _keyed_classes(spark, sf_dir)
    return sampling.bootstrap(li, "label", 0.1, ["row_key"])


@query(
    "m4_capped_sample",
    f"""WITH {LINE_ITEMS}, {_quota_cte("lk", "l_returnflag", "least(floor(sum(n) * 0.2), 5000)")}, {_RANKED}
    SELECT rk.label, count(*) AS n, min(row_key) AS first_key, max(row_key) AS last_key
    FROM rk JOIN quo ON rk.label = quo.label WHERE r <= quota GROUP BY rk.label""",
)
def m4_capped_sample(spark, sf_dir):
    """The sample size is capped; the cap is the feature."""
    li = _keyed_classes(spark, sf_dir)
    got = sampling.stratified_sample(li, ["label"], 0.2, ["row_key"], cap=5000)
    return got.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_key").alias("first_key"), F.max("row_key").alias("last_key")
    )


@query(
    "m5_balanced_weights",
    f"""WITH {SENSOR_WIDE}, c AS (SELECT attack AS label, count(*) AS n FROM sw GROUP BY 1)
    SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 9) AS weight FROM c""",
)
def m5_balanced_weights(spark, sf_dir):
    """n / (classes * n_class)."""
    df = sensor_wide(spark, sf_dir, with_id=False).select(F.col("attack").alias("label"))
    weighted = sampling.balanced_weights(df).groupBy("label", "weight").agg(F.count(F.lit(1)).alias("n"))
    return rounded(weighted, "weight", digits=9)


_NEIGHBORS = f"""WITH {VECTORS}, m AS (SELECT * FROM v WHERE label = 1),
    d AS (SELECT a.id, b.id AS neighbor, list_distance(a.vec, b.vec) AS distance FROM m a JOIN m b ON a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS rank FROM d),
    nn AS (SELECT * FROM r WHERE rank <= 5)"""


@query("m6_nearest_neighbors", f"{_NEIGHBORS} SELECT id, neighbor, rank, round(distance, 6) AS distance FROM nn")
def m6_nearest_neighbors(spark, sf_dir):
    """The 5 nearest other rows inside the rare class."""
    v = vectors(spark, sf_dir).filter("label = 1").select("id", "vec")
    return rounded(knn_join(v, v, 5, same_table=True), "distance")


@query(
    "m1_smote",
    f"""{_NEIGHBORS},
    ranked AS (SELECT id, vec, row_number() OVER (ORDER BY id) - 1 AS k FROM m),
    size AS (SELECT (SELECT count(*) FROM m) AS n, floor(0.5 * (SELECT count(*) FROM v WHERE label = 0))::BIGINT - (SELECT count(*) FROM m) AS wanted),
    draws AS (SELECT draw, floor({uniform_sql("42:base", "draw::VARCHAR")} * n)::BIGINT AS k,
                     floor({uniform_sql("42:neighbor", "draw::VARCHAR")} * least(5, n - 1))::BIGINT + 1 AS rank, least(5, n - 1) AS near,
                     {uniform_sql("42:gap", "draw::VARCHAR")} AS u
              FROM (SELECT n, unnest(range(wanted)) AS draw FROM size)),
    hit AS (SELECT draw, b.id AS base, nn.neighbor, u, near, b.vec AS x, o.vec AS y FROM draws
            JOIN ranked b ON b.k = draws.k JOIN nn ON nn.id = b.id AND nn.rank = draws.rank JOIN m o ON o.id = nn.neighbor)
    SELECT draw, base, neighbor, near, round(u, 6) AS u, round(x[1] + u * (y[1] - x[1]), 6) AS x_first,
           round(x[64] + u * (y[64] - x[64]), 6) AS x_last,
           round(list_sum([a + u * (y[i] - a) for a, i in x]), 6) AS x_sum FROM hit""",
)
def m1_smote(spark, sf_dir):
    """Synthetic rare-class rows up to half of the common class."""
    new = synthetic_rows(vectors(spark, sf_dir))
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x)
    out = new.select(
        "draw", "base", "neighbor", F.col("near").cast("long").alias("near"), "u", F.col("vec")[0].alias("x_first"), F.col("vec")[63].alias("x_last"),
        total.alias("x_sum")
    )
    return rounded(out, "u", "x_first", "x_last", "x_sum")


@query(
    "m1_balanced_classes",
    f"""WITH {VECTORS}, c AS (SELECT count(*) FILTER (WHERE label = 0) AS neg, count(*) FILTER (WHERE label = 1) AS pos FROM v)
    SELECT 0 AS label, false AS synthetic, neg AS n FROM c UNION ALL SELECT 1, false, pos FROM c
    UNION ALL SELECT 1, true, floor(0.5 * neg)::BIGINT - pos FROM c""",
)
def m1_balanced_classes(spark, sf_dir):
    """Class sizes after balancing."""
    return balance(vectors(spark, sf_dir)).groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


_SPLIT_70 = f"""{_quota_cte("v", "label", "floor(sum(n) * 0.7)")},
    rk AS (SELECT id, vec, label, row_number() OVER (PARTITION BY label ORDER BY {hash_sql(42, "id::VARCHAR")}, id) AS r FROM v),
    sp AS (SELECT id, vec, rk.label, CASE WHEN r <= quota THEN 'train' ELSE 'test' END AS split FROM rk JOIN quo ON rk.label = quo.label)"""


@query("m7_stratified_split", f"WITH {VECTORS}, {_SPLIT_70} SELECT id, label, split FROM sp")
def m7_stratified_split(spark, sf_dir):
    """70/30 with the class shares kept exactly."""
    train, test = sampling.stratified_split(vectors(spark, sf_dir), ["label"], 0.7, ["id"])
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.select("id", "label", "split")


@query(
    "m8_positive_weight",
    f"""WITH {SENSOR_WIDE} SELECT attack AS label, count(*) AS n, sum(CASE WHEN attack = 1 THEN 20.0 ELSE 1.0 END)::DOUBLE AS weight FROM sw GROUP BY 1""",
)
def m8_positive_weight(spark, sf_dir):
    """Attack rows weigh 20."""
    df = sensor_wide(spark, sf_dir, with_id=False).select(F.col("attack").alias("label"))
    return sampling.positive_weight(df).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@query(
    "m9_weighted_draws",
    f"""WITH {READINGS}, e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM ev),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM e),
    sizes AS (SELECT label, count(*) AS n FROM e GROUP BY 1),
    draws AS (SELECT draw, floor({uniform_sql("42:class", "draw::VARCHAR")} * 2)::INT AS label FROM (SELECT unnest(range((SELECT count(*) FROM e))) AS draw)),
    spot AS (SELECT draw, d.label, floor({uniform_sql("42:row", "draw::VARCHAR")} * n)::BIGINT AS k FROM draws d JOIN sizes s ON d.label = s.label)
    SELECT draw, event_id, s.label FROM spot s JOIN ranked r ON s.label = r.label AND s.k = r.k""",
)
def m9_weighted_draws(spark, sf_dir):
    """As many draws as rows, each class equally likely."""
    e = readings(spark, sf_dir).select("event_id", (F.col("event_type") == "error").cast("int").alias("label"))
    return sampling.weighted_draws(e, "label", e.count(), ["event_id"])


@query(
    "m10_downsample",
    f"WITH {SENSOR_WIDE} SELECT row_id, minute, attack FROM wide WHERE row_id % 5 = 0",
)
def m10_downsample(spark, sf_dir):
    """Every fifth row."""
    return sampling.downsample(sensor_wide(spark, sf_dir)).select("row_id", "minute", "attack")


@query(
    "m10_downsample_mean",
    f"""WITH {SENSOR_WIDE} SELECT minute // 5 AS step, {", ".join(f'round(avg("{c}"), 6) AS "{c}"' for c in SENSORS)} FROM sw GROUP BY 1""",
)
def m10_downsample_mean(spark, sf_dir):
    """Mean over five time steps."""
    return rounded(sampling.downsample_mean(sensor_wide(spark, sf_dir, with_id=False), SENSORS, "minute"), *SENSORS)


@query(
    "l13_knn_classifier",
    f"""WITH {VECTORS}, {_SPLIT_70},
    d AS (SELECT a.id, b.id AS neighbor, b.label, list_distance(a.vec, b.vec) AS distance
          FROM sp a JOIN sp b ON a.split = 'test' AND b.split = 'train'),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS rank FROM d)
    SELECT id, sum(label)::BIGINT AS votes, CASE WHEN sum(label) * 2 > count(*) THEN 1 ELSE 0 END AS prediction
    FROM r WHERE rank <= 5 GROUP BY id""",
)
def l13_knn_classifier(spark, sf_dir):
    """Majority of the 5 nearest training rows."""
    train, test = sampling.stratified_split(vectors(spark, sf_dir), ["label"], 0.7, ["id"])
    return knn_classify(train, test.select("id", "vec"), 5)


@query(
    "u1_vertical_stack",
    f"""WITH {SENSOR_WIDE} SELECT 0 AS label, count(*) AS n, round(avg("view"), 6) AS mean_view FROM wide WHERE attack = 0 AND row_id < (SELECT count(*) FROM wide) // 2
    UNION ALL SELECT 1, count(*), round(avg("view"), 6) FROM wide WHERE attack = 1 AND row_id >= (SELECT count(*) FROM wide) // 2""",
)
def u1_vertical_stack(spark, sf_dir):
    """Normal rows of the first half on top of attack rows of the second, with new labels."""
    df = sensor_wide(spark, sf_dir)
    half = df.count() // 2
    normal = df.filter((F.col("row_id") < half) & (F.col("attack") == 0)).withColumn("label", F.lit(0))
    attack = df.filter((F.col("row_id") >= half) & (F.col("attack") == 1)).withColumn("label", F.lit(1))
    both = normal.unionByName(attack)
    return rounded(both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("view").alias("mean_view")), "mean_view")


@query(
    "u2_ragged_chunks",
    f"""WITH {READINGS} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS even_value,
            CASE WHEN event_id % 2 = 1 THEN value END AS odd_value, row_number() OVER (ORDER BY event_id) - 1 AS row_id FROM ev""",
)
def u2_ragged_chunks(spark, sf_dir):
    """Chunks with different columns under one another, with a fresh row id."""
    e = table(spark, sf_dir, "events")
    even = e.filter("event_id % 2 = 0").select("event_id", F.col("value").alias("even_value"))
    odd = e.filter("event_id % 2 = 1").select("event_id", F.col("value").alias("odd_value"))
    return with_row_id(even.unionByName(odd, allowMissingColumns=True), ["event_id"])
