"""Extra-trees grown level by level: all nodes of all trees of one depth in one pass over the rows.

Extremely randomised trees (Geurts, Ernst and Wehenkel, 2006): a node draws up to `max(1, floor(sqrt(p)))` of its non-constant
features without replacement, a cut uniform between the node's least and largest value of each, and keeps the cut of largest
weighted Gini decrease. No bootstrap. A node is a leaf at the depth limit, below `min_split` rows, below `2 * min_leaf` rows,
when pure, or when no drawn cut leaves `min_leaf` rows on both sides. A leaf's value is its weighted share of label 1, and the
forest's P(attack) is the mean over trees.

Each depth costs two passes (`mapInArrow`, then an aggregate by tree and node), whatever the number of trees:
1. ranges: the least and largest value of every feature, the weights of both classes and the rows of every open node;
2. splits: the weights and rows on both sides of every drawn cut of every open node, as sums over (tree, node, cut, side).
Rows find their node by walking the trees grown so far (numpy, on the executors); only the small per-node sums reach the
driver: the executors draw each open node's features and cuts and pick its best cut, so k numbers a node and one row a split
node are collected. Beyond `MERGE_ROWS` rows, equal rows are merged and counted (`_n`), so a pass costs the distinct rows. Draws come from generators seeded by (seed, tree, node), so a run gives the same forest every time. Scoring walks all trees on Arrow batches.

Rows need finite features; a null or non-finite feature is refused by `assemble`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from penstock.sources.staging import stage

OPEN, LEAF = -2, -1
MERGE_ROWS = 20_000


class Tree:
    """Nodes in order of creation; `feat` is the split feature, `LEAF`, or `OPEN` while the node still waits for its split."""

    def __init__(self):
        self.feat, self.cut, self.left, self.right, self.value, self.depth = [OPEN], [0.0], [0], [0], [0.5], [0]

    def arrays(self) -> dict[str, np.ndarray]:
        return {"feat": np.array(self.feat, np.int64), "cut": np.array(self.cut), "left": np.array(self.left, np.int64),
                "right": np.array(self.right, np.int64), "value": np.array(self.value)}

    def add(self, value: float, depth: int) -> int:
        self.feat.append(OPEN)
        self.cut.append(0.0)
        self.left.append(0)
        self.right.append(0)
        self.value.append(value)
        self.depth.append(depth)
        return len(self.feat) - 1


def walk(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Node of each row: the leaf, or the open node where the walk stops."""
    node = np.zeros(len(x), np.int64)
    while len(x):
        f = tree["feat"][node]
        idx = np.nonzero(f >= 0)[0]
        if not len(idx):
            break
        at = node[idx]
        go = x[idx, f[idx]] <= tree["cut"][at]
        node[idx] = np.where(go, tree["left"][at], tree["right"][at])
    return node


def _features(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column("_x")
    width = len(col[0]) if batch.num_rows else 0
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, width)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, label, summed weight and number of the merged rows of a batch."""
    y, w, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "_w", "_n"))
    return _features(batch), y, w * n, n


def _ranges(rows: DataFrame, trees: list[dict[str, np.ndarray]]) -> DataFrame:
    """Per open node: least and largest value of every feature, class weights and rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, w, c = _rows(batch)
            out = {k: [] for k in ("tree", "node", "lo", "hi", "w0", "w1", "n")}
            for t, tree in enumerate(trees):
                node = walk(tree, x)
                m = np.nonzero(tree["feat"][node] == OPEN)[0]
                if not len(m):
                    continue
                order = m[np.argsort(node[m], kind="stable")]
                keys, starts = np.unique(node[order], return_index=True)
                xs = x[order]
                out["tree"] += [t] * len(keys)
                out["node"] += keys.tolist()
                out["lo"] += list(np.minimum.reduceat(xs, starts, axis=0))
                out["hi"] += list(np.maximum.reduceat(xs, starts, axis=0))
                out["w0"] += np.add.reduceat(w[order] * (1 - y[order]), starts).tolist()
                out["w1"] += np.add.reduceat(w[order] * y[order], starts).tolist()
                out["n"] += np.add.reduceat(c[order], starts).tolist()
            if out["tree"]:
                yield pa.record_batch({
                    "tree": pa.array(out["tree"], pa.int32()), "node": pa.array(out["node"], pa.int64()),
                    "lo": pa.array([a.tolist() for a in out["lo"]], pa.list_(pa.float64())), "hi": pa.array([a.tolist() for a in out["hi"]], pa.list_(pa.float64())),
                    "w0": pa.array(out["w0"], pa.float64()), "w1": pa.array(out["w1"], pa.float64()), "n": pa.array(out["n"], pa.int64()),
                })

    parts = rows.mapInArrow(run, "tree int, node long, lo array<double>, hi array<double>, w0 double, w1 double, n long")
    both = lambda f: lambda acc, a: F.zip_with(acc, a, lambda u, v: f(u, v))
    merged = parts.groupBy("tree", "node").agg(
        F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"), F.sum("w0").alias("w0"), F.sum("w1").alias("w1"), F.sum("n").alias("n")
    ).select(
        "tree", "node", F.aggregate(F.slice("los", 2, 1 << 30), F.col("los")[0], both(F.least)).alias("lo"),
        F.aggregate(F.slice("his", 2, 1 << 30), F.col("his")[0], both(F.greatest)).alias("hi"), "w0", "w1", "n",
    )
    return merged


def _plans(ranges: DataFrame, k: int, seed: int, split_here: bool, least: int) -> pd.DataFrame:
    """Per open node: its value, and the drawn features and cuts (none for a leaf); drawn on the executors, k numbers a node reach the driver."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            feats, cuts = [], []
            for r in f.itertuples(index=False):
                lo, hi = np.asarray(r.lo), np.asarray(r.hi)
                free = np.nonzero(lo < hi)[0]
                if not split_here or r.n < least or r.w0 <= 0 or r.w1 <= 0 or not len(free):
                    feats.append([])
                    cuts.append([])
                    continue
                draw = np.random.default_rng([seed, int(r.tree), int(r.node)])
                picked = draw.choice(free, min(k, len(free)), replace=False)
                feats.append(picked.tolist())
                cuts.append((lo[picked] + draw.uniform(size=len(picked)) * (hi[picked] - lo[picked])).tolist())
            total = f["w0"] + f["w1"]
            yield pd.DataFrame({"tree": f["tree"], "node": f["node"], "value": np.where(total > 0, f["w1"] / total.where(total > 0, 1), 0.5),
                                "feats": feats, "cuts": cuts})

    return ranges.mapInPandas(run, "tree int, node long, value double, feats array<int>, cuts array<double>").toPandas()


# Partial (tree, node, cut, side) rows a task holds before it sends their merged sums.
MERGE_KEYS = 1 << 20


def _splits(rows: DataFrame, trees: list[dict[str, np.ndarray]], plans: list[tuple[np.ndarray, np.ndarray]], k: int, min_leaf: int) -> pd.DataFrame:
    """Per open node with drawn cuts: the cut of largest weighted Gini decrease that leaves `min_leaf` rows on both sides (ties: the
    first drawn), with the class weights of both sides. Sums by (tree, node, cut, side) and the choice run as aggregates."""
    def merged(keys, w0s, w1s, ns) -> pa.RecordBatch:
        both, inv = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
        inv = inv.reshape(-1)
        tree_col, uniq = both[:, 0], both[:, 1]
        return pa.record_batch({
            "tree": pa.array(tree_col.astype(np.int32)), "node": pa.array(uniq // (2 * k)), "k": pa.array(((uniq // 2) % k).astype(np.int32)),
            "side": pa.array((uniq % 2).astype(np.int32)), "w0": pa.array(np.bincount(inv, np.concatenate(w0s), len(both))),
            "w1": pa.array(np.bincount(inv, np.concatenate(w1s), len(both))),
            "n": pa.array(np.rint(np.bincount(inv, np.concatenate(ns), len(both))).astype(np.int64)),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums are merged over the batches of a task until MERGE_KEYS partial rows are held, then sent: a task sends each
        # (tree, node, cut, side) it saw about once, in bounded memory.
        keys, w0s, w1s, ns, held = [], [], [], [], 0
        for batch in batches:
            x, y, w, c = _rows(batch)
            for t, tree in enumerate(trees):
                feats, cuts = plans[t]
                node = walk(tree, x)
                m = np.nonzero((tree["feat"][node] == OPEN) & (feats[node, 0] >= 0))[0]
                if not len(m):
                    continue
                f, cut = feats[node[m]], cuts[node[m]]
                valid = f >= 0
                side = (x[m[:, None], np.maximum(f, 0)] > cut).astype(np.int64)
                key = (node[m][:, None] * k + np.arange(k)[None, :]) * 2 + side
                key, ww, yy = key[valid], np.broadcast_to(w[m][:, None], f.shape)[valid], np.broadcast_to(y[m][:, None], f.shape)[valid]
                uniq, inv = np.unique(key, return_inverse=True)
                keys.append(np.stack([np.full(len(uniq), t, np.int64), uniq], axis=1))
                w0s.append(np.bincount(inv, ww * (1 - yy), len(uniq)))
                w1s.append(np.bincount(inv, ww * yy, len(uniq)))
                ns.append(np.bincount(inv, np.broadcast_to(c[m][:, None], f.shape)[valid], len(uniq)))
                held += len(uniq)
            if held >= MERGE_KEYS:
                yield merged(keys, w0s, w1s, ns)
                keys, w0s, w1s, ns, held = [], [], [], [], 0
        if keys:
            yield merged(keys, w0s, w1s, ns)

    parts = rows.mapInArrow(run, "tree int, node long, k int, side int, w0 double, w1 double, n long")
    side = lambda c, v: F.sum(F.when(F.col("side") == v, F.col(c)).otherwise(F.lit(0)))
    sums = parts.groupBy("tree", "node", "k").agg(
        side("w0", 0).alias("l0"), side("w1", 0).alias("l1"), side("n", 0).alias("ln"),
        side("w0", 1).alias("r0"), side("w1", 1).alias("r1"), side("n", 1).alias("rn"),
    ).filter((F.col("ln") >= min_leaf) & (F.col("rn") >= min_leaf))
    gain = _gini_column(F.col("l0") + F.col("r0"), F.col("l1") + F.col("r1")) - _gini_column(F.col("l0"), F.col("l1")) - _gini_column(F.col("r0"), F.col("r1"))
    best = sums.groupBy("tree", "node").agg(F.max(F.struct(gain.alias("gain"), (-F.col("k")).alias("nk"), "l0", "l1", "r0", "r1")).alias("b"))
    return best.select("tree", "node", (-F.col("b.nk")).alias("k"), "b.l0", "b.l1", "b.r0", "b.r1").toPandas()  # one row per split node


def _gini_column(w0, w1):
    s = w0 + w1
    return F.when(s > 0, s * (1 - (w0 / s) * (w0 / s) - (w1 / s) * (w1 / s))).otherwise(F.lit(0.0))


def grow(train: DataFrame, trees: int, depth: int, min_leaf: int = 1, min_split: int = 2, seed: int = 42, weight: str | None = None) -> list[dict[str, np.ndarray]]:
    """Fit `trees` extra-trees on `(features, label[, weight])`, all nodes of one depth at a time."""
    rows = train.select(vector_to_array("features").alias("_x"), F.col("label").cast("double").alias("label"),
                        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    if train.count() > MERGE_ROWS:  # sorted, so that sums are added in the same order every time
        rows = rows.groupBy("_x", "label", "_w").agg(F.count(F.lit(1)).alias("_n")).sortWithinPartitions("label", "_w", "_x")
    else:
        rows = rows.withColumn("_n", F.lit(1).cast("long"))
    rows = stage(rows, "extra-rows")
    forest = [Tree() for _ in range(trees)]
    width = len(rows.first()["_x"]) if rows.take(1) else 0
    k = max(1, int(math.sqrt(width))) if width else 1
    for level in range(depth + 1):
        arrays = [t.arrays() for t in forest]
        if not any((a["feat"] == OPEN).any() for a in arrays):
            break
        planned = _plans(_ranges(rows, arrays), k, seed, level < depth, max(min_split, 2 * min_leaf))
        plans = [(np.full((len(t.feat), k), -1, np.int64), np.zeros((len(t.feat), k))) for t in forest]
        for r in planned.itertuples(index=False):
            u = int(r.node)
            forest[r.tree].value[u] = float(r.value)
            if len(r.feats):
                plans[r.tree][0][u, : len(r.feats)] = r.feats
                plans[r.tree][1][u, : len(r.cuts)] = r.cuts
        chosen: dict[tuple[int, int], tuple] = {}
        if any((p[0][:, 0] >= 0).any() for p in plans):
            for r in _splits(rows, arrays, plans, k, min_leaf).itertuples(index=False):
                chosen[(int(r.tree), int(r.node))] = (int(r.k), (r.l0, r.l1), (r.r0, r.r1))
        for t, tree in enumerate(forest):
            for u in np.nonzero(np.array(tree.feat) == OPEN)[0]:
                u = int(u)
                if (t, u) not in chosen:
                    tree.feat[u] = LEAF
                    continue
                j, (l0, l1), (r0, r1) = chosen[(t, u)]
                tree.feat[u], tree.cut[u] = int(plans[t][0][u, j]), float(plans[t][1][u, j])
                tree.left[u] = tree.add(l1 / (l0 + l1) if l0 + l1 > 0 else 0.5, tree.depth[u] + 1)
                tree.right[u] = tree.add(r1 / (r0 + r1) if r0 + r1 > 0 else 0.5, tree.depth[u] + 1)
    for tree in forest:
        tree.feat = [LEAF if f == OPEN else f for f in tree.feat]
    return [t.arrays() for t in forest]


def score(df: DataFrame, forest: list[dict[str, np.ndarray]], out: str = "p") -> DataFrame:
    """`df` with `out`, the mean leaf value over all trees, from its `features`."""
    spark = SparkSession.active()
    shared = spark.sparkContext.broadcast(forest)  # the fitted forest: its size is set by trees, depth and leaf sizes, not by the rows
    keep = [f for f in df.schema.fields if f.name != "features"]
    schema = StructType([*keep, StructField("_x", df.select(vector_to_array("features").alias("_x")).schema["_x"].dataType), StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            x = _features(batch)
            p = np.zeros(batch.num_rows)
            for tree in trees:
                p += tree["value"][walk(tree, x)]
            yield pa.record_batch([*batch.columns, pa.array(p / max(1, len(trees)), pa.float64())], [*batch.schema.names, out])

    scored = df.select(*[f.name for f in keep], vector_to_array("features").alias("_x")).mapInArrow(run, schema)
    return scored.withColumn("features", array_to_vector("_x")).select(*df.columns, out)


def node_table(forest: list[dict[str, np.ndarray]]) -> list[tuple]:
    return [(t, i, int(a["feat"][i]), float(a["cut"][i]), int(a["left"][i]), int(a["right"][i]), float(a["value"][i]))
            for t, a in enumerate(forest) for i in range(len(a["feat"]))]


def from_node_table(rows) -> list[dict[str, np.ndarray]]:
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    forest = []
    for t in sorted(by):
        nodes = sorted(by[t], key=lambda r: r[1])
        forest.append({"feat": np.array([r[2] for r in nodes], np.int64), "cut": np.array([r[3] for r in nodes]),
                       "left": np.array([r[4] for r in nodes], np.int64), "right": np.array([r[5] for r in nodes], np.int64),
                       "value": np.array([r[6] for r in nodes])})
    return forest


NODES = "tree int, node int, feat int, cut double, left int, right int, value double"
