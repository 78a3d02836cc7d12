"""Seeded hash draws: the same row gets the same draw on any partitioning, and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 1 << 32


def seeded_hash(seed: object, *keys: str | Column) -> Column:
    """32-bit draw in [0, 2^32) from the md5 of `seed:key:key…`."""
    parts = [F.lit(str(seed))]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def seeded_uniform(seed: object, *keys: str | Column) -> Column:
    """Draw in [0, 1)."""
    return seeded_hash(seed, *keys) / F.lit(float(DRAW_RANGE))


def hash_sql(seed: object, key: str) -> str:
    """DuckDB text of `seeded_hash`; `key` is a SQL expression already joined with ':'."""
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT)"


def uniform_sql(seed: object, key: str) -> str:
    """DuckDB text of `seeded_uniform`."""
    return f"({hash_sql(seed, key)} / {float(DRAW_RANGE)})"
