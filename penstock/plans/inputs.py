"""Inputs derived from the given tables, each with the same derivation as DuckDB text.

* `readings`      one row per event: sensor = event type, entity = user
* `sensor_wide`   per-minute mean of each sensor, with real gaps, and an attack flag
* `measures`      the numeric matrix of the line items with a row key and a class
* `scores`        seeded pseudo-probabilities of both models for each event
* `vectors`       64-feature rows with a binary label
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.functions.draws import seeded_uniform, uniform_sql
from penstock.functions.timecols import epoch_minute, epoch_seconds
from penstock.operators.ordering import with_row_id

SENSORS = ("click", "error", "purchase", "signup", "view")
MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_KEY = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(name: str, digits: int = 6):
    """Column rounded for comparison, NaN as NULL."""
    c = F.col(name).cast("double")
    return F.round(F.when(~F.isnan(c), c), digits).alias(name)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[r6(c, digits) if c in names else F.col(f"`{c}`") for c in df.columns])


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "event_type", "value", epoch_seconds("ts").alias("sec"), epoch_minute("ts").alias("minute")
    )


READINGS = """ev AS (
  SELECT event_id, user_id, event_type, value,
         epoch_us(ts) // 1000000 AS sec, epoch_us(ts) // 60000000 AS minute
  FROM events)"""


def sensor_wide(spark: SparkSession, sf_dir: str, with_id: bool = True) -> DataFrame:
    e = readings(spark, sf_dir)
    wide = e.groupBy("minute").agg(
        *[F.avg(F.when(F.col("event_type") == s, F.col("value"))).alias(s) for s in SENSORS],
        F.max((F.col("event_type") == "error").cast("int")).alias("attack"),
    )
    return with_row_id(wide, ["minute"]) if with_id else wide


SENSOR_WIDE = (
    READINGS
    + """,
sw AS (
  SELECT minute, """
    + ", ".join(f"avg(value) FILTER (WHERE event_type = '{s}') AS \"{s}\"" for s in SENSORS)
    + """,
         max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS attack
  FROM ev GROUP BY minute),
wide AS (SELECT *, row_number() OVER (ORDER BY minute) - 1 AS row_id FROM sw)"""
)


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the dense `row_id` in key order."""
    return with_row_id(table(spark, sf_dir, "lineitem"), LINE_KEY)


MEASURES_SQL = (
    "li AS (SELECT *, row_number() OVER (ORDER BY " + ", ".join(LINE_KEY) + ") - 1 AS row_id FROM lineitem)"
)

# A row key as text; prices and shares are written as whole hundredths so that both sides print the same.
_KEY_CENTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_KEY_PLAIN = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the text key `row_key`; whole rows are distinct."""
    li = table(spark, sf_dir, "lineitem")
    parts = [F.col(c).cast("string") for c in _KEY_PLAIN]
    parts += [F.floor(F.col(c) * 100 + 0.5).cast("string") for c in _KEY_CENTS]
    return li.withColumn("row_key", F.concat_ws("|", *parts, epoch_seconds("l_shipdate").cast("string")))


LINE_ITEMS = (
    "lk AS (SELECT *, concat_ws('|', "
    + ", ".join(f"{c}::VARCHAR" for c in _KEY_PLAIN)
    + ", "
    + ", ".join(f"floor({c} * 100 + 0.5)::BIGINT::VARCHAR" for c in _KEY_CENTS)
    + ", (epoch_us(l_shipdate) // 1000000)::VARCHAR) AS row_key FROM lineitem)"
)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(event_id, sec, minute, user_id, label, p_edge, p_central)`; attacks get higher seeded scores."""
    e = readings(spark, sf_dir).withColumn("label", (F.col("event_type") == "error").cast("int"))
    p_edge = F.round(0.25 * F.col("label") + 0.75 * seeded_uniform("edge", "event_id"), 3)
    p_central = F.round(F.when(F.col("label") == 1, 1.0 - 0.4 * seeded_uniform("central", "event_id") ** 3)
                        .otherwise(seeded_uniform("central", "event_id")), 3)
    return e.select("event_id", "sec", "minute", "user_id", "label", p_edge.alias("p_edge"), p_central.alias("p_central"))


_UE, _UC = uniform_sql("edge", "event_id::VARCHAR"), uniform_sql("central", "event_id::VARCHAR")
SCORES = (
    READINGS
    + f""",
sc0 AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM ev),
sc AS (
  SELECT event_id, sec, minute, user_id, label,
         round(0.25 * label + 0.75 * {_UE}, 3) AS p_edge,
         round(CASE WHEN label = 1 THEN 1.0 - 0.4 * pow({_UC}, 3) ELSE {_UC} END, 3) AS p_central
  FROM sc0)"""
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(id, vec, label)`; label 1 is the rare class."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"),
        (F.col("label") == 0).cast("int").alias("label"),
    )


VECTORS = """v AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS vec, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM embeddings)"""


def vector_columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Vectors with one column per feature `f0…`."""
    v = vectors(spark, sf_dir)
    width = 64
    names = [f"f{i}" for i in range(width)]
    return v.select("id", "vec", "label", *[F.col("vec")[i].alias(n) for i, n in enumerate(names)]), names


def unpivot_sql(columns: Sequence[str], source: str, keys: Sequence[str] = (), name: str = "feature", value: str = "value") -> str:
    """UNION ALL of one SELECT per column."""
    head = ", ".join(keys) + ", " if keys else ""
    return " UNION ALL ".join(f"SELECT {head}'{c}' AS {name}, \"{c}\" AS {value} FROM {source}" for c in columns)
