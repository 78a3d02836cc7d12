"""Scaling with parameters fitted on the training split only.

Fitted state is a table with one row per feature. It is collected (bounded by the number of columns) and
applied as literals, so scaling is a projection without a join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penstock.functions.draws import seeded_uniform
from penstock.operators.columns import to_long
from penstock.operators.ordering import quantiles
from penstock.operators.profile import column_stats
from penstock.sources.staging import materialize

Params = dict[str, dict[str, float]]


def fit_params(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """`(feature, position, min, max, mean, std)`; std is the population deviation."""
    order = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature"))
    return column_stats(train, cols).select(
        "feature", (order - 1).cast("long").alias("position"), "min", "max", "mean", F.sqrt("var_pop").alias("std")
    )


def save_params(params: DataFrame, path: str) -> DataFrame:
    """Persist scaler state and the selected-feature list in one small table."""
    return materialize(params.coalesce(1), path, force=True)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def params_dict(params: DataFrame) -> Params:
    """Parameters by feature, in feature order."""
    rows = params.orderBy("position").collect()  # one row per feature
    return {r["feature"]: r.asDict() for r in rows}


def min_max(cell: Column, p: dict[str, float]) -> Column:
    """(x - min) / (max - min), not clipped; a feature without spread is only shifted."""
    spread = p["max"] - p["min"]
    return (cell - F.lit(p["min"])) / F.lit(spread if spread != 0 else 1.0)


def z_score(cell: Column, p: dict[str, float]) -> Column:
    """(x - mean) / std of the training split; a feature without spread is only centred."""
    return (cell - F.lit(p["mean"])) / F.lit(p["std"] if p["std"] != 0 else 1.0)


def apply_params(df: DataFrame, params: Params, how=min_max) -> DataFrame:
    """Scale the fitted features, pass other columns through."""
    return df.select(*[how(F.col(c), params[c]).alias(c) if c in params else F.col(c) for c in df.columns])


# Scaled cells outside this range count as out of range.
RANGE_LOW, RANGE_HIGH = -0.1, 1.1


def out_of_range(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """`(cells, outside, pct_outside)` of scaled cells strictly outside the tolerated range."""
    hits = reduce(
        lambda a, b: a + b,
        [F.when((F.col(c) < RANGE_LOW) | (F.col(c) > RANGE_HIGH), 1).otherwise(0) for c in cols],
    )
    cells = F.count(F.lit(1)) * len(cols)
    return df.agg(
        cells.alias("cells"),
        F.sum(hits).cast("long").alias("outside"),
        (100.0 * F.sum(hits) / cells).alias("pct_outside"),
    )


def fit_quantiles(train: DataFrame, cols: Sequence[str], landmarks: int = 1000) -> dict[str, list[float]]:
    """Evenly spaced training quantiles per feature, exact."""
    probs = [i / (landmarks - 1) for i in range(landmarks)]
    long = to_long(train, cols)
    rows = quantiles(long, "value", probs, ["feature"]).collect()  # features × landmarks
    found: dict[str, list[tuple[float, float]]] = {c: [] for c in cols}
    for r in rows:
        found[r["feature"]].append((r["prob"], r["quantile"]))
    return {c: [q for _, q in sorted(pairs)] for c, pairs in found.items()}


def quantile_transform(df: DataFrame, fitted: dict[str, list[float]], normal: bool = False) -> DataFrame:
    """Map each feature to U(0,1), or to N(0,1), by its training quantiles.

    Ties are centred by averaging the interpolation from below and from above.
    """

    def mapper(marks: list[float]):
        @F.pandas_udf(T.DoubleType())
        def to_uniform(values: pd.Series) -> pd.Series:
            xs = np.asarray(marks)
            ps = np.linspace(0.0, 1.0, len(xs))
            v = values.to_numpy(dtype=float)
            up = np.interp(v, xs, ps)
            down = -np.interp(-v, -xs[::-1], -ps[::-1])
            out = pd.Series((up + down) / 2.0)
            return out.where(~np.isnan(v), None)

        return to_uniform

    scaled = df.select(*[mapper(fitted[c])(F.col(c)).alias(c) if c in fitted else F.col(c) for c in df.columns])
    if not normal:
        return scaled
    return scaled.select(*[inverse_normal(F.col(c)).alias(c) if c in fitted else F.col(c) for c in df.columns])


# Acklam's rational approximation of the normal quantile (relative error below 1.2e-9), highest power first.
NORMAL_CENTRE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
NORMAL_TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
NORMAL_TAIL_BELOW, NORMAL_CLIP = 0.02425, 1e-7


def inverse_normal(p: Column) -> Column:
    """Quantile function of N(0,1), clipped just inside (0, 1); NULL stays NULL."""

    def fraction(parts: tuple, x: Column) -> Column:
        over, under = (reduce(lambda total, c: total * x + c, part[1:], F.lit(part[0])) for part in parts)
        return over / under

    low = F.least(p, 1.0 - p)
    low = F.when(low < NORMAL_CLIP, F.lit(NORMAL_CLIP)).otherwise(low)
    q = p - 0.5
    tail = fraction(NORMAL_TAIL, F.sqrt(-2.0 * F.log(low)))
    return F.when(low >= NORMAL_TAIL_BELOW, fraction(NORMAL_CENTRE, q * q) * q).when(q < 0, tail).otherwise(-tail)


# Fixed value: noise deviation when none is given; it was never published, so it is a parameter.
NOISE_SIGMA = 0.01


def add_noise(df: DataFrame, cols: Sequence[str], key: Sequence[str], sigma: float = NOISE_SIGMA, seed: int = 42) -> DataFrame:
    """Add N(0, sigma^2) noise to training features; drawn per (column, key), so stable on any partitioning."""

    def noise(column: str) -> Column:
        u1 = 1.0 - seeded_uniform(f"{seed}:a:{column}", *key)
        u2 = seeded_uniform(f"{seed}:b:{column}", *key)
        return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)

    return df.select(*[(F.col(c) + sigma * noise(c)).alias(c) if c in cols else F.col(c) for c in df.columns])
