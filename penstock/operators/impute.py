"""Filling gaps: chunk means, ordered fills, constants, statistics, interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penstock.functions.timecols import floor_div
from penstock.operators.ordering import block_rows_for

# Fixed value: rows per chunk of the chunk-mean fill.
CHUNK_ROWS = 50_000


def chunk_mean_fill(df: DataFrame, cols: Sequence[str], row_id: str = "row_id", rows: int = CHUNK_ROWS) -> DataFrame:
    """Fill gaps with the mean of the same chunk; a chunk without values stays NULL.

    The window partition is one chunk, so a task holds a bounded number of rows.
    """
    chunk = Window.partitionBy("_chunk")
    filled = df.withColumn("_chunk", floor_div(row_id, rows))
    return filled.select(
        *[
            F.coalesce(F.col(c), F.avg(c).over(chunk)).alias(c) if c in cols else F.col(c)
            for c in df.columns
        ]
    )


def ordered_fill(
    df: DataFrame,
    cols: Sequence[str],
    row_id: str = "row_id",
    entity: Sequence[str] = (),
    forward: bool = True,
    backward: bool = True,
    block_rows: int | None = None,
) -> DataFrame:
    """Forward then backward fill in row order, over gaps of any length.

    Each block of rows is filled on its own; gaps that reach a block edge take the nearest value of an earlier (later)
    block from a summary with one row per block and column. The join reuses the partitioning of the window, so the data
    is shuffled once.
    """
    near, last_seen, next_seen = _with_nearest(df, cols, row_id, entity, forward, backward, block_rows)
    filled = {}
    for c in cols:
        steps = [F.col(f"`{c}`")]
        if forward:
            steps += last_seen[c]
        if backward:
            steps += next_seen[c]
        filled[c] = F.coalesce(*steps)
    return near.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in df.columns])


def _with_nearest(df, cols, row_id, entity, forward, backward, block_rows):
    """`df` with the last and next non-NULL values, and for each column the expressions to read them."""
    keys = [*entity, "_block"]
    block_rows = block_rows or block_rows_for(df, row_id)
    blocked = df.withColumn("_block", floor_div(row_id, block_rows))
    frame = (Window.unboundedPreceding, 0)
    up = Window.partitionBy(*keys).orderBy(row_id).rowsBetween(*frame)
    # A descending order keeps the frame growing, so the fill stays linear in the block size.
    down = Window.partitionBy(*keys).orderBy(F.col(row_id).desc()).rowsBetween(*frame)
    inside = []
    for i, c in enumerate(cols):
        if forward:
            inside.append(F.last(f"`{c}`", ignorenulls=True).over(up).alias(f"_f{i}"))
        if backward:
            inside.append(F.last(f"`{c}`", ignorenulls=True).over(down).alias(f"_b{i}"))
    near = blocked.select("*", *inside)
    back, ahead = {}, {}
    kinds = {c: df.schema[c].dataType for c in cols}
    for number, kind in enumerate(dict.fromkeys(kinds.values())):
        same = [c for c in cols if kinds[c] == kind]
        name = f"_carry{number}"
        near = near.join(_carried(blocked, same, row_id, entity, keys).withColumnRenamed("_carry", name), keys)
        for i, c in enumerate(same):
            at = cols.index(c)
            back[c] = [F.col(f"_f{at}"), F.col(name)[i]["before"]]
            ahead[c] = [F.col(f"_b{at}"), F.col(name)[i]["after"]]
    return near, back, ahead


def _carried(blocked, cols, row_id, entity, keys) -> DataFrame:
    """`(entity…, _block, _carry)`: nearest value before and after the block for each column, by position.

    Cells are aggregated by (block, position), so the plan does not grow with the columns; the windows run per column
    over one row per block.
    """
    cells = blocked.select(*keys, F.col(row_id).alias("_row"), F.posexplode(F.array(*[F.col(f"`{c}`") for c in cols])).alias("_at", "_x"))
    present = F.when(F.col("_x").isNotNull(), F.col("_row"))
    ends = cells.groupBy(*keys, "_at").agg(F.max_by("_x", present).alias("_last"), F.min_by("_x", present).alias("_first"))
    before = Window.partitionBy(*entity, "_at").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*entity, "_at").orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    known = ends.select(
        *keys, "_at", F.last("_last", ignorenulls=True).over(before).alias("before"),
        F.last("_first", ignorenulls=True).over(after).alias("after"),
    )
    # One short list per block: its length is the number of columns.
    in_order = F.array_sort(
        F.collect_list(F.struct("_at", "before", "after")), lambda a, b: a["_at"] - b["_at"]
    )
    return known.groupBy(*keys).agg(in_order.alias("_carry"))


def interpolate(
    df: DataFrame, cols: Sequence[str], at: str, row_id: str = "row_id", entity: Sequence[str] = (),
    block_rows: int | None = None,
) -> DataFrame:
    """Linear interpolation over `at` between the neighbouring values; edge gaps stay NULL."""
    points = [f"_p{i}" for i in range(len(cols))]
    with_points = df.select(
        "*",
        *[
            F.when(F.col(c).isNotNull(), F.struct(F.col(at).cast("double").alias("t"), F.col(c).alias("v"))).alias(p)
            for c, p in zip(cols, points)
        ],
    )
    near, back, ahead = _with_nearest(with_points, points, row_id, entity, True, True, block_rows)
    done = {}
    for c, p in zip(cols, points):
        a, b, t = F.coalesce(*back[p]), F.coalesce(*ahead[p]), F.col(at).cast("double")
        done[c] = F.coalesce(F.col(c), a["v"] + (b["v"] - a["v"]) * (t - a["t"]) / (b["t"] - a["t"]))
    return near.select(*[done[c].alias(c) if c in done else F.col(c) for c in df.columns])


def fill_constant(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    """Fill what remains with a constant."""
    return df.fillna(value, subset=list(cols))


def fill_from_params(df: DataFrame, params: dict[str, dict[str, float]], statistic: str) -> DataFrame:
    """Fill gaps with a training statistic (`mean` or `median`) of each column."""
    return df.select(
        *[
            F.coalesce(F.col(c), F.lit(params[c][statistic])).alias(c) if c in params else F.col(c)
            for c in df.columns
        ]
    )
