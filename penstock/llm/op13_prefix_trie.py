"""Conversation prefix trie on a minimal-perfect-hash node table.

Conversations are rebuilt from their turns (null turn first, ties by role and text; null role or text is empty): conversation c takes
the first h turns of conversation c - c % 20 (all if fewer, none if absent), then its own turns after its first h, with
h = crc32(decimal c) % 4. Each distinct sequence of the first d rebuilt turns is a node of depth d; the root (d = 0) holds every
conversation.

1. Digests: the d-th turn of a rebuilt conversation gets three 31-bit hashes of (d, role, text); a prefix's digest is their running
   sums (a window over the conversation) with its depth, so a node's parent digest is its own less its last turn's hashes. The
   digest of every prefix is enumerated once per conversation, in a pass that grows with the number of turns.
2. Node table: distinct digests, each verified: all rows of a digest must agree on a hash of (parent digest, role, text), else the
   run stops with an error. Digests are dealt to `shards` by hash, and each shard numbers its digests densely from its offset: a
   minimal perfect hash of the nodes onto 0..N-1, the node's slot.
3. Scatter: members, ends, children and the smallest member are counted into the slots (aggregates by slot).
4. Accumulate through parent slots in depth order: a node's subtree values (childless nodes, saved tokens) are scattered to the path of
   its smallest member at the node's depth, summed along each conversation's chain of parent slots from the deepest up (a window by
   descending depth), and gathered per slot. Each node lies on one such path, so it counts once, and no step moves a whole subtree.
5. The digest of the members that end at a node streams through SHA-256 over rows sorted by (node, conversation), never a list.

Results, one row per node: see `trie`. Rows with a null conv_id take no part; a conversation whose rebuilt form has no turns is a
member of the root only, and ends there. Repeated rows are repeated turns. Empty table: no rows (not even a root). Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penstock.llm.common import small_batches, table
from penstock.sources.staging import stage

BASE, PREFIX, SHARD_NODES = 20, 4, 1 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()
_MASK = (1 << 31) - 1
_KEY = ["depth", "s1", "s2", "s3"]


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def rebuilt(conv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(conv_id, n)` of every conversation with the length of its rebuilt form, and its turns `(conv_id, depth, role, text)`, depth from 1."""
    turns = conv.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = stage(turns.withColumn("pos", F.row_number().over(order) - 1).drop("turn"), "trie-turns")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(PREFIX))
    convs = sizes.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BASE).alias("b"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("b"), F.col("own").alias("nb")), "b", "left")
    convs = stage(convs.select("conv_id", "b", "h", F.least("h", F.coalesce("nb", F.lit(0))).alias("taken"), "own"), "trie-convs")
    head = convs.join(turns.filter(F.col("pos") < PREFIX - 1).select(F.col("conv_id").alias("b"), "pos", "role", "text"), "b").filter(
        F.col("pos") < F.col("h")
    ).select("conv_id", (F.col("pos") + 1).alias("depth"), "role", "text")
    tail = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter(F.col("pos") >= F.col("h")).select(
        "conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "role", "text"
    )
    n = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return n, head.unionByName(tail)


def paths(conv: DataFrame) -> DataFrame:
    """One row per conversation and depth 0..n: the prefix's digest, its parent's, the last turn's words, and whether it ends there."""
    n, steps = rebuilt(conv)
    parts = [F.pmod(F.xxhash64(F.lit(k), "depth", "role", "text"), F.lit(_MASK + 1)) for k in (1, 2, 3)]
    upto = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.select("conv_id", "depth", "role", "text", *[p.alias(f"t{k}") for k, p in zip((1, 2, 3), parts, strict=True)])
    steps = steps.select(
        "conv_id", "depth", words(F.col("text")).alias("words"),
        *[F.sum(f"t{k}").over(upto).alias(f"s{k}") for k in (1, 2, 3)], *[F.col(f"t{k}") for k in (1, 2, 3)], "role", "text",
    ).select(
        "conv_id", "depth", "s1", "s2", "s3",
        *[(F.col(f"s{k}") - F.col(f"t{k}")).alias(f"p{k}") for k in (1, 2, 3)], "words",
        F.xxhash64(F.col("s1") - F.col("t1"), F.col("s2") - F.col("t2"), F.col("s3") - F.col("t3"), "role", "text").alias("vh"),
    )
    root = n.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(f"s{k}") for k in (1, 2, 3)],
                    *[F.lit(None).cast("long").alias(f"p{k}") for k in (1, 2, 3)], F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("vh"))
    rows = steps.unionByName(root).join(n, "conv_id").withColumn("ends", F.col("depth") == F.col("n")).drop("n")
    return stage(rows, "trie-paths")


def ends_digest(ends: DataFrame) -> DataFrame:
    """`(depth, s1, s2, s3, ends_sha256)`: SHA-256 of the ascending decimal ids that end at each node, streamed over sorted rows."""
    small_batches(ends.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, digests, at, h = [], [], None, None

        def flush():
            cols = list(zip(*keys, strict=True)) if keys else [[]] * 4
            out = {k: pa.array(list(c), pa.int64()) for k, c in zip(_KEY, cols, strict=True)}
            return pa.record_batch({**out, "ends_sha256": pa.array(digests, pa.string())})

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in [*_KEY, "conv_id"]]
            for *key, c in zip(*cols, strict=True):
                key = tuple(key)
                if key != at:
                    if at is not None:
                        keys.append(at)
                        digests.append(h.hexdigest())
                    at, h = key, hashlib.sha256(str(c).encode())
                else:
                    h.update(b"," + str(c).encode())
            if len(keys) >= 1000:
                yield flush()
                keys, digests = [], []
        if at is not None:
            keys.append(at)
            digests.append(h.hexdigest())
        if keys:
            yield flush()

    return ends.repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id").mapInArrow(
        run, "depth long, s1 long, s2 long, s3 long, ends_sha256 string"
    )


def trie(conv: DataFrame) -> DataFrame:
    """Per node, all long: conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves (childless nodes
    of its subtree), saved_tokens (over its subtree, each node's (n_convs - 1) times the words of its last text), and ends_sha256."""
    spark = conv.sparkSession
    rows = paths(conv)
    nodes = rows.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
        F.first("p3").alias("p3"), F.max("words").alias("words"), F.min("vh").alias("vlo"), F.max("vh").alias("vhi"),
    )
    nodes = stage(nodes, "trie-nodes")
    clash = nodes.filter(F.col("vlo") != F.col("vhi")).limit(1).collect()
    if clash:
        raise ValueError(f"two prefixes share the digest {tuple(clash[0][k] for k in _KEY)}")
    count = nodes.count()
    shards = max(1, math.ceil(count / SHARD_NODES))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64(*_KEY), F.lit(shards)).cast("int"))
    sizes = nodes.groupBy("shard").count().collect()  # one row per shard: nodes / SHARD_NODES of them
    offsets, at = [], 0
    for r in sorted(sizes, key=lambda r: r["shard"]):
        offsets.append((r["shard"], at))
        at += r["count"]
    start = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "shard int, offset long"))
    local = F.row_number().over(Window.partitionBy("shard").orderBy(*_KEY)) - 1
    nodes = stage(nodes.join(start, "shard").withColumn("slot", F.col("offset") + local).drop("offset", "vlo", "vhi"), "trie-slots")

    parent = nodes.select(*[F.col(c).alias(f"p{c[1]}") for c in ("s1", "s2", "s3")], (F.col("depth") + 1).alias("depth"),
                          F.col("slot").alias("parent_slot"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.join(parent, ["depth", "p1", "p2", "p3"], "left")
    children = linked.filter(F.col("parent_slot").isNotNull()).groupBy(F.col("parent_slot").alias("slot")).agg(F.count(F.lit(1)).alias("n_children"))
    linked = stage(linked.join(children, "slot", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "trie-linked")

    own = linked.select(
        "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("g_leaf"),
        F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("words")).otherwise(F.lit(0)).cast("long").alias("g_tok"),
    )
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = rows.join(own, ["conv_id", "depth"], "left").select(
        *_KEY, F.sum(F.coalesce("g_leaf", F.lit(0))).over(below).alias("a_leaf"), F.sum(F.coalesce("g_tok", F.lit(0))).over(below).alias("a_tok"),
    )
    subtree = along.groupBy(*_KEY).agg(F.sum("a_leaf").cast("long").alias("n_leaves"), F.sum("a_tok").cast("long").alias("saved_tokens"))
    ends = rows.filter("ends").select(*[F.col(k).cast("long") for k in _KEY], "conv_id")
    out = linked.join(subtree, _KEY).join(ends_digest(ends), _KEY, "left")
    return out.select(
        "conv_id", F.col("depth").cast("long"), "parent_conv_id", F.col("n_convs").cast("long"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
