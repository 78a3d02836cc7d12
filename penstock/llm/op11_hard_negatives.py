"""Hard-negative mining with a GNAT-style multiway tree: split points keep distance ranges of their siblings' subtrees.

Rows are the embeddings with an id, a label and a vector of finite components of the table's most common length (ties: the longer).
Where the id is divisible by 7 the label first becomes (label + 1) % 10; every component x becomes floor(256 x). A row's score against a
query is the integer inner product of the two.

1. Inner products become distances. Every row x gets one more coordinate sqrt(M2 - |x|^2), with M2 the largest squared norm of all
   rows, so rows lie on one sphere and |q - x'|^2 = |q|^2 + M2 - 2 <q, x> for a query q padded with 0. A window lo <= score <= hi is an
   annulus of distances around q.
2. The tree is fitted on at most `FIT_ROWS` rows chosen by hash (the documented bound of the fit): a node takes up to `BRANCH` split
   points of its points, farthest first, and every point goes to its nearest one; nodes of at most `LEAF_FIT` points are leaves.
3. Every row of the table is routed down the tree, and in the same pass every node learns, for each split point of its parent (its
   own and its siblings'), the least and largest distance from that point to the rows of its subtree. The ranges are aggregated over
   all rows, so they bound every row, not only the sample.
4. A query visits a node only if, for every one of those split points p, the distances its subtree can have,
   [max(d(q,p) - far, near - d(q,p)), d(q,p) + far], meet the window's annulus; leaves are searched exactly, in whole numbers.
5. Top k per query in two passes: leaves with the best bound, until `SEED_ROWS` rows, give a threshold (the k-th score found); the
   second pass searches the narrowed window through the tree and alone gives the result.
6. A leaf's rows are cut into chunks of at most `CHUNK_ROWS`, the queries that visit it into blocks of at most `QUERY_BLOCK`; each
   (leaf, chunk, block) is one group of a cogroup, which meets its rows as one matrix product. A vector with very many copies
   therefore never lands in one task, and only the k best of each group leave it.

Results: rows with a null id, label or vector, a null or non-finite component, or another length take no part; equal scores go to
the smaller id; a positive is any other row id of the anchor's label; an empty table, or one without anchors, gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penstock.llm.common import small_batches, table
from penstock.sources.staging import stage

BRANCH, LEAF_FIT, MAX_DEPTH, FIT_ROWS = 8, 24, 8, 8192
SEED_ROWS, CHUNK_ROWS, QUERY_BLOCK, QUERY_TASK = 512, 4096, 512, 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
INF = float("inf")


def prepared(emb: DataFrame) -> DataFrame:
    """`(vec_id, label, v)`: rows that take part, label turned where the id is divisible by 7, components as whole numbers."""
    vec = F.col("embedding")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(INF)))
    ok = emb.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vec.isNotNull() & ~bad)
    dims = ok.groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not dims:
        return ok.select("vec_id", F.col("label").cast("int").alias("label"), F.transform(vec, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    return ok.filter(F.size(vec) == dims[0][0]).select(
        "vec_id", label.alias("label"), F.transform(vec, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v")
    )


@dataclass
class Tree:
    """Nodes in breadth-first order. `first[u]:first[u]+width[u]` are u's split points in `points` (none for a leaf);
    `child[u]` their nodes. `near[u]`, `far[u]`: distance ranges from its parent's split points to u's rows."""

    points: np.ndarray
    m2: float
    parent: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    width: list[int] = field(default_factory=list)
    child: list[list[int]] = field(default_factory=list)
    near: list[np.ndarray] = field(default_factory=list)
    far: list[np.ndarray] = field(default_factory=list)
    rows: np.ndarray | None = None

    @property
    def leaves(self) -> list[int]:
        return [u for u in range(len(self.parent)) if not self.width[u]]


def padded(v: np.ndarray, m2: float) -> np.ndarray:
    """Rows on the sphere of radius sqrt(m2)."""
    x = v.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(m2 - (x * x).sum(1), 0.0))[:, None]])


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T
    return np.sqrt(np.maximum(d2, 0.0))


def farthest_first(x: np.ndarray, k: int) -> list[int]:
    """Up to k indices of distinct points, each the farthest from those before; the first is the farthest from the mean."""
    chosen = [int(np.argmax(distances(x, x.mean(0, keepdims=True))[:, 0]))]
    gap = distances(x, x[chosen])[:, 0]
    while len(chosen) < k and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, distances(x, x[chosen[-1:]])[:, 0])
    return chosen


def fit_tree(sample: np.ndarray, m2: float, branch: int = BRANCH, leaf: int = LEAF_FIT, depth: int = MAX_DEPTH) -> Tree:
    """Tree over padded sample points; a node of equal points, or at the depth limit, is a leaf."""
    tree, points = Tree(np.zeros((0, sample.shape[1])), m2), []
    queue, total = [(sample, -1, 0)], 0
    while queue:
        x, up, level = queue.pop(0)
        u = len(tree.parent)
        tree.parent.append(up)
        tree.child.append([])
        pick = farthest_first(x, branch) if len(x) > leaf and level < depth else []
        if len(pick) < 2:
            tree.first.append(total)
            tree.width.append(0)
            continue
        tree.first.append(total)
        tree.width.append(len(pick))
        total += len(pick)
        points.append(x[pick])
        owner = np.argmin(distances(x, x[pick]), 1)
        for j in range(len(pick)):
            queue.append((x[owner == j], u, level + 1))
    for u in range(len(tree.parent)):
        b = tree.width[tree.parent[u]] if u else 0
        tree.near.append(np.full(b, INF))
        tree.far.append(np.full(b, -INF))
    n_nodes = len(tree.parent)
    tree.child = [[] for _ in range(n_nodes)]
    for u in range(1, n_nodes):
        tree.child[tree.parent[u]].append(u)
    tree.points = np.vstack(points) if points else np.zeros((0, sample.shape[1]))
    return tree


def route(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray, int]]]:
    """Leaf of each padded row, and for every node reached: least and largest distances to the parent's split points, and rows."""
    at = np.zeros(len(x), dtype=np.int64)
    seen: dict[int, tuple[np.ndarray, np.ndarray, int]] = {0: (np.zeros(0), np.zeros(0), len(x))} if len(x) else {}
    inner = np.array([tree.width[u] > 0 for u in range(len(tree.parent))])
    while len(x) and inner[at].any():
        for u in np.unique(at[inner[at]]):
            idx = np.nonzero(at == u)[0]
            d = distances(x[idx], tree.points[tree.first[u]: tree.first[u] + tree.width[u]])
            pick = np.argmin(d, 1)
            for j in np.unique(pick):
                c = tree.child[u][j]
                mine = d[pick == j]
                seen[c] = (mine.min(0), mine.max(0), len(mine))
                at[idx[pick == j]] = c
    return at, seen


def bounds(tree: Tree, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score each node's rows can have against each query (rows of q are whole-number vectors)."""
    qp = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
    dq = distances(qp, tree.points) if len(tree.points) else np.zeros((len(q), 0))
    n = len(tree.parent)
    low, high = np.zeros((len(q), n)), np.full((len(q), n), INF)
    for u in range(1, n):
        p = tree.parent[u]
        d = dq[:, tree.first[p]: tree.first[p] + tree.width[p]]
        with np.errstate(invalid="ignore"):
            lo = np.nanmax(np.maximum(d - tree.far[u], tree.near[u] - d), 1)
            hi = np.nanmin(d + tree.far[u], 1)
        low[:, u] = np.maximum(np.maximum(lo, 0.0), low[:, p])
        high[:, u] = np.minimum(hi, high[:, p])
    base = (qp * qp).sum(1)[:, None] + tree.m2
    slack = 1e-9 * base + 1.0
    with np.errstate(invalid="ignore"):
        best = np.where(np.isfinite(low), (base - low * low) / 2 + slack, -INF)
        worst = np.where(np.isfinite(high), (base - high * high) / 2 - slack, -INF)
    best[:, 0], worst[:, 0] = INF, -INF
    return worst, best


def leaves_to_visit(tree: Tree, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: bool) -> list[np.ndarray]:
    """Leaves whose score range meets each query's window; with `seed`, only the best of them, until `SEED_ROWS` rows."""
    worst, best = bounds(tree, q)
    leaves = np.array(tree.leaves)
    out = []
    for i in range(len(q)):
        ok = (best[i, leaves] >= lo[i]) & (worst[i, leaves] <= hi[i]) & (tree.rows[leaves] > 0)
        found = leaves[ok]
        if seed and len(found):
            order = np.argsort(-np.minimum(best[i, found], hi[i]), kind="stable")
            found = found[order]
            reach = np.searchsorted(np.cumsum(tree.rows[found]), SEED_ROWS) + 1
            found = found[:reach]
        out.append(found)
    return out


def index(rows: DataFrame) -> tuple[Tree, DataFrame]:
    """Fit the tree on a bounded sample, route every row, and learn the ranges of every node from all rows."""
    spark = rows.sparkSession
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda acc, x: acc + x * x)
    n, m2, dim = rows.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
    m2, dim = float(m2 or 0), int(dim or 0)
    share = min(1.0, 1.5 * FIT_ROWS / max(n, 1))
    picked = rows.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("v").limit(FIT_ROWS).collect()
    sample = padded(np.array([r.v for r in picked], dtype=np.int64).reshape(len(picked), dim), m2)
    tree = fit_tree(sample, m2)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column("v").to_pylist(), dtype=np.int64).reshape(batch.num_rows, dim)
            at, seen = route(tree, padded(v, m2))
            yield pa.record_batch({
                "vec_id": batch.column("vec_id"), "label": batch.column("label"), "v": batch.column("v"), "_row": batch.column("_row"),
                "leaf": pa.array(at.astype(np.int32)), "node": pa.nulls(batch.num_rows, pa.int32()),
                "near": pa.nulls(batch.num_rows, pa.list_(pa.float64())), "far": pa.nulls(batch.num_rows, pa.list_(pa.float64())),
                "n": pa.nulls(batch.num_rows, pa.int64()),
            })
            if seen:
                nodes = sorted(seen)
                k = len(nodes)
                yield pa.record_batch({
                    "vec_id": pa.nulls(k, pa.int64()), "label": pa.nulls(k, pa.int32()), "v": pa.nulls(k, pa.list_(pa.int64())),
                    "_row": pa.nulls(k, pa.int64()), "leaf": pa.nulls(k, pa.int32()), "node": pa.array(nodes, pa.int32()),
                    "near": pa.array([seen[u][0].tolist() for u in nodes], pa.list_(pa.float64())),
                    "far": pa.array([seen[u][1].tolist() for u in nodes], pa.list_(pa.float64())),
                    "n": pa.array([seen[u][2] for u in nodes], pa.int64()),
                })

    schema = "vec_id long, label int, v array<long>, _row long, leaf int, node int, near array<double>, far array<double>, n long"
    routed = stage(rows.select("vec_id", "label", "v", F.monotonically_increasing_id().alias("_row")).mapInArrow(run, schema), "hn-routed")
    width = max(tree.width) if tree.width else 0
    parts = routed.filter(F.col("node").isNotNull()).select("node", "n", F.posexplode_outer("near").alias("j", "d"), F.col("far"))
    summary = parts.groupBy("node").agg(
        F.sum(F.when(F.col("j").isNull() | (F.col("j") == 0), F.col("n"))).alias("n"),
        *[F.min(F.when(F.col("j") == j, F.col("d"))).alias(f"lo{j}") for j in range(width)],
        *[F.max(F.when(F.col("j") == j, F.col("far")[j])).alias(f"hi{j}") for j in range(width)],
    ).collect()
    tree.rows = np.zeros(len(tree.parent), dtype=np.int64)
    for r in summary:
        u = r["node"]
        tree.rows[u] = r["n"] or 0
        for j in range(len(tree.near[u])):
            tree.near[u][j] = r[f"lo{j}"] if r[f"lo{j}"] is not None else INF
            tree.far[u][j] = r[f"hi{j}"] if r[f"hi{j}"] is not None else -INF
    return tree, routed.filter(F.col("leaf").isNotNull()).select("vec_id", "label", "v", "_row", "leaf")


QUERY = "qid long, q array<long>, label int, same boolean, skip long, lo double, hi double"


def search(tree: Tree, rows: DataFrame, queries: DataFrame, k: int, seed: bool) -> DataFrame:
    """`(qid, vec_id, score)`: the k best rows of each query in its window (`seed`: among its seed leaves only)."""
    spark = rows.sparkSession
    dim = tree.points.shape[1] - 1 if len(tree.points) else None

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = np.array(batch.column("q").to_pylist(), dtype=np.int64).reshape(batch.num_rows, -1)
            lo = np.nan_to_num(batch.column("lo").to_numpy(zero_copy_only=False).astype(np.float64), nan=-INF)
            hi = np.nan_to_num(batch.column("hi").to_numpy(zero_copy_only=False).astype(np.float64), nan=INF)
            found = leaves_to_visit(tree, q, lo, hi, seed) if dim is not None else [np.array(tree.leaves)] * batch.num_rows
            take = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            out = batch.take(pa.array(take, pa.int64()))
            yield pa.record_batch([*out.columns, pa.array(np.concatenate(found).astype(np.int32) if len(take) else [], pa.int32())],
                                  [*out.schema.names, "leaf"])

    small_batches(spark)
    asked = queries.select(*[c.split(" ")[0] for c in QUERY.split(", ")])
    asked = asked.repartition(max(1, -(-asked.count() // QUERY_TASK)), "qid")  # bounds per query cost a pass over the tree: spread them
    visits = stage(asked.mapInArrow(visit, QUERY + ", leaf int"), "hn-visits")
    per_leaf = {r["leaf"]: r["n"] for r in visits.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(
        [(int(u), max(1, math.ceil(int(tree.rows[u]) / CHUNK_ROWS)), max(1, math.ceil(per_leaf[u] / QUERY_BLOCK))) for u in per_leaf],
        "leaf int, chunks int, blocks int",
    )
    plan = F.broadcast(plan)  # one row per leaf of a tree fitted on at most FIT_ROWS rows
    left = visits.join(plan, "leaf").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int").alias("block")
    ).drop("chunks", "blocks")
    right = rows.join(plan, "leaf").select(
        "leaf", "vec_id", "label", "v", F.pmod(F.xxhash64("_row"), F.col("chunks")).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )

    def best(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or xs.empty:
            return pd.DataFrame({"qid": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        qm = np.array(qs["q"].tolist(), dtype=np.float64)
        xm = np.array(xs["v"].tolist(), dtype=np.float64)
        score = np.rint(qm @ xm.T).astype(np.int64)  # exact: every sum is far below 2**53
        ids, labels = xs["vec_id"].to_numpy(np.int64), xs["label"].to_numpy(np.int64)
        same = qs["label"].to_numpy(np.int64)[:, None] == labels[None, :]
        ok = np.where(qs["same"].to_numpy(bool)[:, None], same, ~same)
        skip = qs["skip"]
        if skip.isna().any():
            skip = skip.astype("Int64").fillna(np.iinfo(np.int64).min)
        ok &= ids[None, :] != skip.to_numpy(np.int64)[:, None]
        ok &= (score >= np.nan_to_num(qs["lo"].to_numpy(np.float64), nan=-INF)[:, None]) & (score <= np.nan_to_num(qs["hi"].to_numpy(np.float64), nan=INF)[:, None])
        out_q, out_id, out_s = [], [], []
        for i, qid in enumerate(qs["qid"].to_numpy(np.int64)):
            j = np.nonzero(ok[i])[0]
            if len(j) > k:
                cut = np.partition(-score[i, j], k - 1)[k - 1]
                j = j[-score[i, j] <= cut]
            j = j[np.lexsort((ids[j], -score[i, j]))][:k]
            out_q.extend([qid] * len(j))
            out_id.extend(ids[j].tolist())
            out_s.extend(score[i, j].tolist())
        return pd.DataFrame({"qid": out_q, "vec_id": out_id, "score": out_s})

    keys = ["leaf", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "qid long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top(tree: Tree, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact k best per query: a seed pass narrows each window to the k-th score it found, the second pass answers."""
    queries = stage(queries, "hn-queries")
    seeds = search(tree, rows, queries, k, seed=True).filter(F.col("rank") == k).select("qid", F.col("score").cast("double").alias("t"))
    narrowed = queries.join(seeds, "qid", "left").withColumn("lo", F.greatest(F.coalesce("lo", F.lit(-INF)), F.coalesce("t", F.lit(-INF)))).drop("t")
    return stage(search(tree, rows, narrowed, k, seed=False), "hn-top")


def mine(emb: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """`(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)` for every anchor (id divisible by 100)."""
    rows = prepared(emb)
    tree, routed = index(rows)
    anchors = routed.filter(F.col("vec_id") % 100 == 0).select(
        F.col("_row").alias("qid"), F.col("v").alias("q"), "label", F.lit(True).alias("same"), F.col("vec_id").alias("skip"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
    )
    pos = top(tree, routed, anchors, positives).join(anchors.select("qid", "q", "label", F.col("skip").alias("anchor_id")), "qid")
    windows = stage(pos.select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "q", "label",
    ).withColumn("qid", F.monotonically_increasing_id()), "hn-windows")
    ps = F.col("positive_score")
    queries = windows.filter(ps >= 0).select(
        "qid", "q", "label", F.lit(False).alias("same"), F.lit(None).cast("long").alias("skip"),
        F.ceil(ps * LOW / 100).cast("double").alias("lo"), F.floor(ps * HIGH / 100).cast("double").alias("hi"),
    )
    neg = top(tree, routed, queries, negatives)
    return neg.join(windows.select("qid", "anchor_id", "positive_id", "positive_score"), "qid").select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


ORACLE = """
    WITH d AS (SELECT len(embedding) AS n, count(*) AS c FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))) GROUP BY 1 ORDER BY c DESC, n DESC LIMIT 1),
    e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * x::DOUBLE))::DOUBLE[] AS v
          FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = (SELECT n FROM d)
            AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)),
    s AS (SELECT a.vec_id AS anchor_id, a.label = x.label AS same, x.vec_id, list_dot_product(a.v, x.v)::BIGINT AS score
          FROM e a JOIN e x ON a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
            SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same AND vec_id <> anchor_id) WHERE r <= 5),
    n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
          FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
           AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
