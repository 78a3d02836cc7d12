"""Temporal splits and folds with gaps. Cuts come from one aggregate; membership is a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstock.functions.draws import seeded_uniform
from penstock.operators.ordering import quantiles

# Training share of the normal period and seconds left out at the cut.
TRAIN_SHARE, GAP_SECONDS = 0.95, 60


def temporal_split(df: DataFrame, at: str, train_share: float = TRAIN_SHARE, gap: int = GAP_SECONDS) -> DataFrame:
    """Add `split`: train before the cut less the gap, validation from the cut on; gap rows are left out."""
    cut = quantiles(df, at, [train_share]).first()["quantile"]
    side = F.when(F.col(at) < cut - gap, "train").when(F.col(at) >= cut, "validation")
    return df.withColumn("split", side).filter(F.col("split").isNotNull())


def episode_holdout(runs: DataFrame, test_share: float, episode: str = "episode") -> DataFrame:
    """Add `held_out`: whole episodes, chosen by hash, so no episode is on both sides."""
    return runs.withColumn("held_out", (seeded_uniform("episode", episode) < test_share).cast("int"))


def time_blocks(df: DataFrame, at: str, blocks: int) -> DataFrame:
    """Add `block`: equal spans of time, 0 to blocks-1."""
    edge = df.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    span = edge["high"] - edge["low"] + 1
    return df.withColumn("block", F.floor((F.col(at) - edge["low"]) * blocks / F.lit(span)).cast("int"))


def _edges(df: DataFrame, at: str, blocks: int) -> list[tuple[int, int]]:
    """(first, end) of each span in whole time units."""
    edge = df.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    low, span = edge["low"], edge["high"] - edge["low"] + 1
    cuts = [low + -(-span * b // blocks) for b in range(blocks + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def _roles(df: DataFrame, roles: list[Column]) -> DataFrame:
    """One row per fold a row takes part in; the fold list is a literal, so this is a map-side copy."""
    entries = [F.struct(F.lit(i + 1).alias("fold"), role.alias("role")) for i, role in enumerate(roles)]
    copies = F.explode(F.filter(F.array(*entries), lambda e: e["role"].isNotNull()))
    return df.withColumn("_f", copies).select(*df.columns, "_f.fold", "_f.role")


def expanding_folds(df: DataFrame, at: str, folds: int, gap: int) -> DataFrame:
    """Fold k trains on all time before block k less the gap, and tests on block k."""
    spans = _edges(df, at, folds + 1)
    t = F.col(at)
    return _roles(df, [F.when(t < a - gap, "train").when((t >= a) & (t < b), "test") for a, b in spans[1:]])


def blocked_folds(df: DataFrame, at: str, folds: int, gap: int) -> DataFrame:
    """Fold k tests on block k and trains on the rest, less the gap on both sides."""
    t = F.col(at)
    return _roles(
        df,
        [
            F.when((t >= a) & (t < b), "test").when((t < a - gap) | (t >= b + gap), "train")
            for a, b in _edges(df, at, folds)
        ],
    )


def walk_forward_folds(df: DataFrame, at: str, folds: int, gap: int, train_blocks: int = 1) -> DataFrame:
    """Fold k tests on one block and trains on the `train_blocks` spans before it, less the gap."""
    spans = _edges(df, at, folds + train_blocks)
    t = F.col(at)
    roles = []
    for k in range(train_blocks, len(spans)):
        (first, _), (a, b) = spans[k - train_blocks], spans[k]
        roles.append(F.when((t >= first) & (t < a - gap), "train").when((t >= a) & (t < b), "test"))
    return _roles(df, roles)


def one_fold(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one fold."""
    chosen = df.filter(F.col("fold") == fold)
    return tuple(chosen.filter(F.col("role") == r).drop("fold", "role") for r in ("train", "test"))
