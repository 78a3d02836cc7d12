"""Join helpers for small and for skewed sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penstock.sources.staging import stage

BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Stage a summary table, count it, and mark it for broadcast only when it is small.

    Beyond the bound the plain table is returned and the join is shuffled.
    """
    staged = stage(df, "small-side")
    return F.broadcast(staged) if staged.count() <= max_rows else staged


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on `keys` in which null matches null (a null class is a class); the keys appear once, from `left`."""
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], salts: str, spread: str) -> DataFrame:
    """Inner equi-join that splits hot keys of `big` over several tasks.

    `salts` is a column of both sides with the number of salts of the key; `spread` is a whole-number
    column of `big` that varies inside a key. Rows of `small` are copied once per salt.
    """
    left = big.withColumn("_salt", F.pmod(F.col(spread), F.col(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col(salts) - 1))).drop(salts)
    return join_null_safe(left, right, [*keys, "_salt"]).drop("_salt", salts)
