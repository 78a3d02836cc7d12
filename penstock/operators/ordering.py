"""Order-dependent building blocks that never put a whole table, or a hot key, into one task.

* `with_row_id`     dense position in a total order
* `running_totals`  running sums in a total order, optionally inside groups
* `quantiles`       exact interpolated quantiles
* `in_blocks`       bounded row blocks with context rows from the block before

All of them range-partition once, stage the placed rows (range bounds are sampled, so the placement
must not be recomputed), and combine per-partition totals. The totals table has one row for each range
partition (and group), so its size does not follow the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstock.functions.timecols import floor_div
from penstock.operators.joins import small_side
from penstock.sources.staging import stage

MIN_BLOCK_ROWS, MAX_BLOCK_ROWS = 1 << 12, 1 << 20


def with_row_id(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Add the dense 0-based position of each row in `order`.

    `order` should identify rows; among equal keys the position is arbitrary but still unique.
    A hot first key is no problem: the later keys split it over many partitions.
    """
    placed = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "row-id",
    )
    part, inside = F.shiftright("_slot", 33), F.col("_slot").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")  # one row per range partition
        .withColumn(name, F.col("_start") + inside)
        .drop("_part", "_slot", "_start")
    )


def running_totals(
    df: DataFrame, order: Sequence[str], values: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """Add `cum_<value>`: inclusive running sums in `order` inside each `group`.

    Aggregate to unique (group, order) keys first; then no partition can grow with one hot key.
    """
    placed = stage(
        df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "running"
    )
    here = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy(*group, "_part").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *group, "_part", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_s_{v}") for v in values]
    )
    local = placed.select("*", *[F.sum(v).over(here).alias(f"_l_{v}") for v in values])
    return local.join(starts, [*group, "_part"]).select(
        *df.columns, *[(F.col(f"_l_{v}") + F.col(f"_s_{v}")).alias(f"cum_{v}") for v in values]
    )


_POSITION_BUCKETS = 1 << 16


def quantiles(df: DataFrame, value: str, probs: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles per group: `(group…, prob, quantile)`.

    Spark's own exact percentile keeps every distinct value of a group in one buffer. Here distinct values are
    counted and get running counts, so each covers a span of positions; the few wanted positions are then found by
    an equi-join on position buckets.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, [value], ["n"], group)
    spans = stage(ranked.select(*group, F.col(value).alias("_value"), "n", "cum_n"), "spans")
    wanted_probs = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    totals = spans.groupBy(*group).agg(F.max("cum_n").alias("_all"))
    wanted = totals.select(*group, "_all", wanted_probs).withColumn("_pos", F.col("prob") * (F.col("_all") - 1))
    wanted = wanted.withColumn("_low", F.floor("_pos").cast("long")).withColumn("_high", F.ceil("_pos").cast("long"))
    wanted = small_side(wanted)
    sought = wanted.select(*group, "_all", F.explode(F.array("_low", "_high")).alias("_at")).distinct()

    def bucket(position: Column) -> Column:
        return F.floor(position / (F.floor(F.col("_all") / _POSITION_BUCKETS) + 1)).cast("long")

    if group:
        spans = spans.join(small_side(totals), list(group))
    else:
        spans = spans.withColumn("_all", F.lit(totals.first()["_all"]))
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    spread = spans.select(
        *group, "_value", first.alias("_first"), last.alias("_last"),
        F.explode(F.sequence(bucket(first), bucket(last))).alias("_bucket"),
    )
    keyed_positions = small_side(sought.select(*group, "_at", bucket(F.col("_at")).alias("_bucket")))
    found = spread.join(keyed_positions, [*group, "_bucket"]).filter(F.col("_at").between(F.col("_first"), F.col("_last")))
    found = small_side(found.select(*group, "_at", "_value"))
    low = found.select(*group, F.col("_at").alias("_low"), F.col("_value").alias("_low_value"))
    high = found.select(*group, F.col("_at").alias("_high"), F.col("_value").alias("_high_value"))
    both = wanted.join(low, [*group, "_low"]).join(high, [*group, "_high"])
    span = F.col("_high_value") - F.col("_low_value")
    return both.select(*group, "prob", (F.col("_low_value") + span * (F.col("_pos") - F.col("_low"))).alias("quantile"))


def block_rows_for(df: DataFrame, row_id: str) -> int:
    """Rows per block: about four blocks per core, within bounds that keep a block in the memory of a task."""
    top = df.agg(F.max(row_id)).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(MIN_BLOCK_ROWS, min(MAX_BLOCK_ROWS, top // (4 * cores)))


def in_blocks(df: DataFrame, row_id: str, context: int = 0, block_rows: int | None = None) -> DataFrame:
    """Add `_block` and `_context`: each block also holds the last `context` rows of the block before.

    The copies are made map-side. Windows partitioned by `_block` are then exact for up to `context`
    preceding rows; drop rows with `_context` afterwards.
    """
    block_rows = max(block_rows or block_rows_for(df, row_id), 2 * context)
    own = floor_div(row_id, block_rows)
    if context == 0:
        return df.withColumn("_block", own).withColumn("_context", F.lit(False))
    near_end = F.pmod(F.col(row_id), F.lit(block_rows)) >= block_rows - context
    return (
        df.withColumn("_own", own)
        .withColumn(
            "_block",
            F.explode(
                F.when(near_end, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
            ),
        )
        .withColumn("_context", F.col("_block") != F.col("_own"))
        .drop("_own")
    )


def keyed(df: DataFrame, keys: Sequence[str]) -> Column:
    """Text key of a row from several columns, NULL written as the empty string."""
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
