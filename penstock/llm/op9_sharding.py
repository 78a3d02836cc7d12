"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number from the record's key and its own name, -ln(u) / weight, and the least wins. A record's shard depends
on its key and the list of shards alone; a new shard takes records only into itself, and a shard's share follows its weight. No
shuffle is needed to place records.

Slots number the records of a shard without gaps, in the order of a key hash. Rows are range-partitioned by (shard, hash, key), so
a shard is spread over many tasks, and each task adds the rows of the earlier ones.

Results: rows with equal ids, null among them, go to one shard and get different slots; null text has size 0 (+ 1); a shard whose
weight is 0 gets nothing. `shard_documents` keeps all other columns of its input, whatever their names; its own, `shard`, `slot` and
`grown_shard`, replace input columns of these names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penstock.llm.common import table
from penstock.sources.staging import stage

SEED = "rendezvous-1"
SHARDS = 16


def draw(key: Column, shard: int) -> Column:
    """Number in (0, 1) from the first 52 bits of an MD5 of seed, shard and key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:{shard}:").cast("binary"), key.cast("string").cast("binary"))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose draw is least; ties go to the smaller shard."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be positive")
    bids = [F.struct((-F.log(draw(key, s)) / float(w)).alias("bid"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return F.least(*bids)["shard"] if len(bids) > 1 else bids[0]["shard"]


def shard_documents(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", grown: Sequence[float] | None = None) -> DataFrame:
    """`docs` with `shard` and `slot`, and with `grown_shard` under the longer list `grown`.

    Wide columns are shuffled once, for the range partitioning that numbers the slots.
    """
    own = ("shard", "slot", "grown_shard")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in own])
    base = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("key"), row.alias("row"))
    lists = {"shard": weights} | ({"grown_shard": grown} if grown is not None else {})
    placed = base.select("key", "row", F.xxhash64("row").alias("hash"), *[rendezvous(F.col("key"), w).alias(c) for c, w in lists.items()])
    order = ["shard", "hash", "key"]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = stage(ranged.withColumn("at", F.monotonically_increasing_id()), "shards")  # range bounds are sampled: place once
    part = F.shiftright("at", 33)
    counts = cut.groupBy("shard", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (
        cut.withColumn("part", part).join(F.broadcast(starts), ["shard", "part"])  # a row per shard and range partition
        .select("row.*", *lists, (F.col("start") + F.col("at") - F.col("first")).alias("slot"))
    )


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("key").alias("law"),
    )
    done = shard_documents(narrow, [1.0] * SHARDS, grown=[1.0] * (SHARDS + 1))
    return done.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
