"""Random Fourier features (Rahimi and Recht, 2007): a map whose inner products approximate the RBF kernel exp(-gamma |x - y|^2).

z_j(x) = sqrt(2 / D) cos(w_j . x + b_j) with w_j ~ N(0, 2 gamma I) and b_j ~ U[0, 2 pi). The draws are seeded hashes of
(seed, j, i) made normal by Box-Muller, so SQL draws the same numbers. A linear support vector machine on z is then an RBF
support vector machine, trained and scored as one MLlib `LinearSVC` whose cost grows with the rows only.

The map is one column expression over a literal matrix of D x p numbers: its size is set by the parameters, never by the rows.
`gamma` "scale" is 1 / (p * variance of all feature values of the training rows), as the usual default of RBF machines.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.functions.draws import seeded_uniform, uniform_sql

FEATURES, SEED = 256, 12


def draws(spark: SparkSession, width: int, gamma: float, features: int = FEATURES, seed: int = SEED) -> tuple[list[list[float]], list[float]]:
    """The matrix w (features x width) and the phases b."""
    cells = spark.range(features * width).select((F.col("id") / width).cast("long").alias("j"), (F.col("id") % width).alias("i"))
    normal = F.sqrt(-2 * F.log(1 - seeded_uniform(f"{seed}:a", "j", "i"))) * F.cos(2 * math.pi * seeded_uniform(f"{seed}:b", "j", "i"))
    rows = cells.select("j", "i", (math.sqrt(2 * gamma) * normal).alias("w")).collect()  # features x width numbers
    w = [[0.0] * width for _ in range(features)]
    for r in rows:
        w[r["j"]][r["i"]] = r["w"]
    phases = spark.range(features).select("id", (2 * math.pi * seeded_uniform(f"{seed}:c", "id")).alias("b")).orderBy("id").collect()
    return w, [r["b"] for r in phases]


def mapped(x: Column, w: list[list[float]], b: list[float]) -> Column:
    """z(x) as an array column."""
    scale = math.sqrt(2.0 / len(w))
    rows = F.lit(w).cast("array<array<double>>")
    phase = F.lit(b).cast("array<double>")
    dot = lambda row: F.aggregate(F.zip_with(row, x, lambda a, c: a * c), F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(rows, lambda row, j: F.lit(scale) * F.cos(dot(row) + phase[j]))


def scale_gamma(train: DataFrame, vec: str = "vec") -> float:
    """1 / (p * variance of all feature values); 1 / p where the values do not vary."""
    stats = train.select(F.size(vec).alias("p"), F.explode(vec).alias("x")).agg(F.var_pop("x").alias("v"), F.max("p").alias("p")).first()
    width, var = stats["p"] or 1, stats["v"] or 0.0
    return 1.0 / (width * var) if var > 0 else 1.0 / width


def with_fourier_features(df: DataFrame, w: list[list[float]], b: list[float], features: str = "features") -> DataFrame:
    """`df` with its `features` vector replaced by the mapped one."""
    x = vector_to_array(features)
    return df.withColumn(features, array_to_vector(mapped(x, w, b)))


def map_sql(source: str, gamma: float, width: int, features: int = FEATURES, seed: int = SEED) -> str:
    """DuckDB text of `mapped` over `source(id, vec)`: per id, the sum and the first and last value of z."""
    key = "j::VARCHAR || ':' || i::VARCHAR"
    normal = f"sqrt(-2 * ln(1 - {uniform_sql(f'{seed}:a', key)})) * cos(2 * pi() * {uniform_sql(f'{seed}:b', key)})"
    return f"""fw AS (SELECT j, i, sqrt(2 * {gamma!r}) * {normal} AS w FROM range({features}) t(j), range({width}) s(i)),
    fb AS (SELECT j, 2 * pi() * {uniform_sql(f'{seed}:c', 'j::VARCHAR')} AS b FROM range({features}) t(j)),
    fx AS (SELECT id, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM {source}),
    fz AS (SELECT fx.id, fw.j, sqrt(2.0 / {features}) * cos(sum(fw.w * fx.x) + any_value(fb.b)) AS z
           FROM fx JOIN fw USING (i) JOIN fb USING (j) GROUP BY fx.id, fw.j)"""
