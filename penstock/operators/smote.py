"""Synthetic minority over-sampling as seeded draws joined to nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penstock.functions.draws import seeded_uniform
from penstock.operators.neighbors import knn_join
from penstock.operators.sampling import draw_rows, rank_in_class
from penstock.sources.staging import stage

# Minority size over majority size after balancing, and neighbours considered.
MINORITY_RATIO = 0.5
NEIGHBORS = 5


def synthetic_rows(df: DataFrame, ratio: float = MINORITY_RATIO, k: int = NEIGHBORS, seed: int = 42, strict: bool = False) -> DataFrame:
    """New minority points `x + u * (neighbour - x)` of a table `(id, vec, label)`, label 1 = minority.

    Returns `(draw, base, neighbor, u, vec, near)` with `floor(ratio * majority) - minority` rows. Draw j picks the
    base by its rank among the minority, the neighbour by its rank, and u, each from a seeded hash of j. With fewer
    than `k + 1` minority rows a base has only `n - 1` neighbours: `near` reports the number drawn from, and
    `strict=True` refuses instead. Fewer than two minority rows are always refused.
    """
    minority = stage(df.filter(F.col("label") == 1).select("id", F.col("vec").cast("array<double>").alias("vec"), "label"), "minority")
    ranked, counts = rank_in_class(minority, "label", ["id"])
    n_minority = minority.count()
    n_majority = df.filter(F.col("label") == 0).count()
    wanted = max(0, int(ratio * n_majority) - n_minority)
    near = min(k, n_minority - 1)
    if near < 1:
        raise ValueError("at least two minority rows are needed")
    if strict and near < k:
        raise ValueError(f"{n_minority} minority rows give {near} neighbours, {k} asked")
    draws = df.sparkSession.range(wanted).select(
        F.col("id").alias("draw"),
        F.lit(1).cast(minority.schema["label"].dataType).alias("label"),
        F.floor(seeded_uniform(f"{seed}:base", F.col("id")) * n_minority).cast("long").alias("_rank"),
        (F.floor(seeded_uniform(f"{seed}:neighbor", F.col("id")) * near) + 1).cast("int").alias("rank"),
        seeded_uniform(f"{seed}:gap", F.col("id")).alias("u"),
    )
    # Each base row carries its few neighbours, so one salted join serves base and neighbour alike.
    pairs = knn_join(minority, minority, near, same_table=True)
    points = minority.select(F.col("id").alias("neighbor"), F.col("vec").alias("n_vec"))
    around = pairs.join(points, "neighbor").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "neighbor", "n_vec"))).alias("around")
    )
    bases = ranked.withColumnRenamed("id", "base").join(around.withColumnRenamed("id", "base"), "base")
    hit = draw_rows(bases, draws, "label", counts.withColumn("drawn", F.lit(wanted)))
    picked = hit.withColumn("_n", F.element_at("around", F.col("rank")))
    return picked.select(
        "draw", "base", F.col("_n.neighbor").alias("neighbor"), "u",
        F.zip_with("vec", F.col("_n.n_vec"), lambda x, y: x + F.col("u") * (y - x)).alias("vec"), F.lit(near).alias("near"),
    )


def balance(df: DataFrame, ratio: float = MINORITY_RATIO, k: int = NEIGHBORS, seed: int = 42) -> DataFrame:
    """`df` plus its synthetic minority rows, as `(id, vec, label, synthetic)`; new ids follow the largest id."""
    top = df.agg(F.max("id")).first()[0]
    new = synthetic_rows(df, ratio, k, seed).select(
        (F.col("draw") + top + 1).alias("id"), "vec", F.lit(1).cast(df.schema["label"].dataType).alias("label"),
        F.lit(True).alias("synthetic"),
    )
    real = df.select("id", F.col("vec").cast("array<double>").alias("vec"), "label", F.lit(False).alias("synthetic"))
    return real.unionByName(new)
