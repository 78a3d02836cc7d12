"""Bagged forests on counted cells, for many rows of few features.

A forest of binned features sees a row only by its bins, class and weight. So rows are counted per cell (one bin per feature, class,
weight) and the forest is grown on the cells; their number is bounded by the bins, not by the rows. The rest is MLlib's forest:
* cuts: at most `bins - 1` a feature, weighted quantiles of a seeded sample of `max(bins * bins, 10000)` rows, or all midpoints where
  a feature has few values. Every row is counted; the sample places cuts only, as in MLlib.
* bags: a row is in a tree's bag Poisson(1) times, so n equal rows are in it Poisson(n) times. The draws are seeded by bucket of cells.
* splits: `ceil(sqrt(p))` features a node (all for a single tree), the cut of largest weighted Gini decrease that leaves `min_leaf`
  drawn rows on both sides; sibling leaves of one class become one leaf.

Each depth costs one pass over the cells, whatever the number of trees: sums over (tree, node, feature, bin), then a window along the
bins. One row a split node reaches the driver. A fitted forest is scored by its decision table, the mean leaf value of every cell, so
a row costs a search per feature and one look-up; the scores equal those of walking all trees.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penstock.models.extra_trees import LEAF, MERGE_KEYS, OPEN, Tree, walk
from penstock.sources.staging import stage

CELL_LIMIT = 1 << 20  # cells of a forest's bins, at most: its decision table holds one number each
BUCKET_CELLS = 4096  # cells whose bags are drawn by one task at a time
CUT_ROWS = 10_000


def bounded(train: DataFrame, bins: int) -> bool:
    """Whether the features have at most `CELL_LIMIT` cells, whatever the rows."""
    first = train.select(F.size(vector_to_array("features")).alias("p")).first()
    width = (first["p"] or 0) if first else 0
    return width > 0 and bins**width <= CELL_LIMIT


def place_cuts(x: np.ndarray, w: np.ndarray, bins: int) -> np.ndarray:
    """Cuts of one feature: midpoints between neighbouring values, at the weighted quantiles where there are more than `bins` values."""
    values, at = np.unique(x, return_inverse=True)
    mids = (values[:-1] + values[1:]) / 2
    if len(values) <= bins:
        return mids[~np.isnan(mids)]
    total = np.cumsum(np.bincount(at.reshape(-1), w, len(values)))
    stride, cuts = total[-1] / bins, []
    for i in range(1, len(values)):
        target = stride * (len(cuts) + 1)
        if abs(total[i - 1] - target) < abs(total[i] - target):
            cuts.append(mids[i - 1])
    return np.array([c for c in cuts if not math.isnan(c)])


def place_sampled_cuts(rows: DataFrame, n: int, bins: int, seed: int) -> list[np.ndarray]:
    share = min(1.0, max(bins * bins, CUT_ROWS) / n)
    sample = (rows.sample(False, share, seed) if share < 1 else rows).select(vector_to_array("features").alias("x"), "w").toPandas()
    if not len(sample):
        return []
    x = np.array(sample["x"].tolist(), np.float64)
    return [place_cuts(x[:, f], sample["w"].to_numpy(np.float64), bins) for f in range(x.shape[1])]


def codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Cell number of each row: the bins of its features in mixed radix. A value is right of the cuts below it."""
    at = np.zeros(len(x), np.int64)
    for f, cut in enumerate(cuts):
        at = at * (len(cut) + 1) + np.searchsorted(cut, x[:, f], "left")
    return at


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), width)


def _code_column(cuts: list[np.ndarray]) -> Column:
    def run(features: pa.Array) -> pa.Array:
        return pa.array(codes(_matrix(features, len(cuts)), cuts), pa.int64())

    run.__annotations__ = {"features": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long")(vector_to_array("features"))


def draw_bags(cells: DataFrame, trees: int, seed: int) -> DataFrame:
    """Cells with the number of times that their rows are in each tree's bag."""
    buckets = max(1, -(-cells.count() // BUCKET_CELLS))

    def draw(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["code", "y", "w"])
        drawn = np.random.default_rng([seed, int(key[0])]).poisson(f["n"].to_numpy()[:, None], (len(f), trees))
        return pd.DataFrame({"code": f["code"], "y": f["y"], "w": f["w"], "bags": list(drawn.astype(np.int64))})

    bucket = F.pmod(F.xxhash64("code", "y", "w"), F.lit(buckets))
    spread = cells.withColumn("bucket", bucket).repartition(buckets, "bucket")  # small in bytes, much work per cell: kept apart
    drawn = spread.groupBy("bucket").applyInPandas(draw, "code long, y int, w double, bags array<long>")
    return stage(drawn, "forest-bags")


def best_splits(rows: DataFrame, decode: Callable[[pa.RecordBatch], Iterator[tuple]], bins: int, trees: list[dict[str, np.ndarray]],
                drawn: list[np.ndarray], k: int, min_leaf: int) -> list:
    """Per open node its split, if any: the feature's number `k` among the drawn ones, the last bin on the left, and the class weights
    and drawn rows of both sides. `decode` gives bins, classes, weights and the bag of a tree of the rows in a batch."""

    def merged(found: list[tuple]) -> pa.RecordBatch:
        tree, key, w0, w1, n = (np.concatenate(c) for c in zip(*found, strict=True))
        both, at = np.unique(np.stack([tree, key], 1), axis=0, return_inverse=True)
        at, key = at.reshape(-1), both[:, 1]
        return pa.record_batch({
            "tree": pa.array(both[:, 0].astype(np.int32)), "node": pa.array(key // (k * bins)), "k": pa.array((key // bins % k).astype(np.int32)),
            "bin": pa.array((key % bins).astype(np.int32)), "w0": pa.array(np.bincount(at, w0, len(both))),
            "w1": pa.array(np.bincount(at, w1, len(both))), "n": pa.array(np.rint(np.bincount(at, n, len(both))).astype(np.int64)),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for x, y, w, bag in (part for batch in batches for part in decode(batch)):
            for t, tree in enumerate(trees):
                if not (tree["feat"] == OPEN).any():
                    continue
                bags = bag(t)
                m = np.nonzero(bags > 0)[0]
                node = walk(tree, x[m])
                opened = tree["feat"][node] == OPEN
                m, node = m[opened], node[opened]
                if not len(m):
                    continue
                f = drawn[t][node]
                key = ((node[:, None] * k + np.arange(k)) * bins + x[m[:, None], f]).reshape(-1)
                c = np.repeat(bags[m], k)
                cw, cy = c * np.repeat(w[m], k), np.repeat(y[m], k)
                uniq, at = np.unique(key, return_inverse=True)
                at = at.reshape(-1)
                found.append((np.full(len(uniq), t, np.int64), uniq, np.bincount(at, cw * (1 - cy), len(uniq)),
                              np.bincount(at, cw * cy, len(uniq)), np.bincount(at, c, len(uniq))))
                held += len(uniq)
                if held >= MERGE_KEYS:
                    yield merged(found)
                    found, held = [], 0
        if found:
            yield merged(found)

    parts = rows.mapInArrow(run, "tree int, node long, k int, bin int, w0 double, w1 double, n long").repartition("tree", "node")
    sums = parts.groupBy("tree", "node", "k", "bin").agg(*[F.sum(c).alias(c) for c in ("w0", "w1", "n")])
    left = Window.partitionBy("tree", "node", "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("tree", "node", "k")
    sides = sums.select(
        "tree", "node", "k", "bin", *[F.sum(c).over(left).alias(f"l{c}") for c in ("w0", "w1", "n")],
        *[F.sum(c).over(whole).alias(f"t{c}") for c in ("w0", "w1", "n")],
    ).withColumns({f"r{c}": F.col(f"t{c}") - F.col(f"l{c}") for c in ("w0", "w1", "n")})
    total = F.col("tw0") + F.col("tw1")
    gain = _gini("t") - sum((F.col(f"{s}w0") + F.col(f"{s}w1")) / total * _gini(s) for s in "lr")
    best = sides.filter((F.col("ln") >= min_leaf) & (F.col("rn") >= min_leaf)).withColumn("gain", gain).filter("gain > 0").groupBy("tree", "node").agg(
        F.max(F.struct("gain", (-F.col("k")).alias("nk"), (-F.col("bin")).alias("nb"), "lw0", "lw1", "rw0", "rw1", "ln", "rn")).alias("b"))
    return best.select("tree", "node", (-F.col("b.nk")).alias("k"), (-F.col("b.nb")).alias("bin"), "b.lw0", "b.lw1", "b.rw0", "b.rw1", "b.ln", "b.rn").collect()


def _gini(side: str) -> Column:
    w0, w1 = F.col(f"{side}w0"), F.col(f"{side}w1")
    s = w0 + w1
    return F.when(s > 0, 1 - (w0 / s) * (w0 / s) - (w1 / s) * (w1 / s)).otherwise(F.lit(0.0))


def _share(w0: float, w1: float) -> float:
    return min(1.0, max(0.0, w1 / (w0 + w1))) if w0 + w1 > 0 else 0.0


def _pruned(tree: Tree, cuts: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The tree with sibling leaves of one class merged, bottom up, and its bins turned into cuts."""
    for u in reversed(range(len(tree.feat))):
        if tree.feat[u] >= 0:
            a, b = tree.left[u], tree.right[u]
            if tree.feat[a] < 0 and tree.feat[b] < 0 and (tree.value[a] > 0.5) == (tree.value[b] > 0.5):
                tree.feat[u] = LEAF
    out, todo = Tree(), [(0, 0)]
    out.value[0] = tree.value[0]
    while todo:
        u, v = todo.pop()
        out.feat[v] = tree.feat[u] if tree.feat[u] >= 0 else LEAF
        if tree.feat[u] >= 0:
            out.cut[v] = float(cuts[tree.feat[u]][int(tree.cut[u])])
            for side in ("left", "right"):
                child = getattr(tree, side)[u]
                getattr(out, side)[v] = out.add(tree.value[child], 0)
                todo.append((child, getattr(out, side)[v]))
    return out.arrays()


def grow_cells(cells: DataFrame, cuts: list[np.ndarray], trees: int, depth: int, min_leaf: int, seed: int) -> list[dict[str, np.ndarray]]:
    """The forest on `(code, y, w, bags)`, all nodes of one depth at a time."""
    shape = tuple(len(c) + 1 for c in cuts)
    width, k = len(cuts), len(cuts) if trees == 1 else math.ceil(math.sqrt(len(cuts)))
    forest = [Tree() for _ in range(trees)]

    def decode(batch: pa.RecordBatch) -> Iterator[tuple]:
        code, y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("code", "y", "w"))
        bags = _matrix(batch.column("bags"), trees)
        yield np.stack(np.unravel_index(code, shape), 1), y, w, lambda t: bags[:, t]

    in_bags = cells.select("y", "w", F.posexplode("bags").alias("tree", "c")).groupBy("tree").agg(
        *[F.sum(F.when(F.col("y") == v, F.col("c") * F.col("w")).otherwise(0.0)).alias(f"w{v}") for v in (0, 1)])
    for r in in_bags.collect():
        forest[r.tree].value[0] = _share(r.w0, r.w1)
    for level in range(depth):
        arrays = [t.arrays() for t in forest]
        drawn = []
        for t, a in enumerate(arrays):  # features of the nodes of this depth, drawn without replacement
            nodes = np.zeros((len(a["feat"]), k), np.int64)
            opened = np.nonzero(a["feat"] == OPEN)[0]
            nodes[opened] = np.argsort(np.random.default_rng([seed, t, level]).random((len(opened), width)), 1)[:, :k]
            drawn.append(nodes)
        if not any((a["feat"] == OPEN).any() for a in arrays):
            break
        chosen = {(r.tree, r.node): r for r in best_splits(cells, decode, max(shape), arrays, drawn, k, min_leaf)}
        for t, tree in enumerate(forest):
            for u in np.nonzero(arrays[t]["feat"] == OPEN)[0].tolist():
                r = chosen.get((t, u))
                if r is None:
                    tree.feat[u] = LEAF
                    continue
                tree.feat[u], tree.cut[u] = int(drawn[t][u, r.k]), float(r.bin)
                for side, w0, w1 in (("left", r.lw0, r.lw1), ("right", r.rw0, r.rw1)):
                    child = tree.add(_share(w0, w1), level + 1)
                    getattr(tree, side)[u] = child
                    if tree.value[child] in (0.0, 1.0):
                        tree.feat[child] = LEAF
    return [_pruned(t, cuts) for t in forest]


def grow(train: DataFrame, trees: int, depth: int, min_leaf: int = 1, seed: int = 42, weight: str | None = None,
         bins: int = 32) -> tuple[list[dict[str, np.ndarray]], list[np.ndarray]] | None:
    """Fit a bagged forest on `(features, label[, weight])`: its trees and the cuts of every feature.

    None where the labels are not both 0 and 1 or a weight is null, negative or not finite (MLlib refuses or handles those rows), and
    where rows of very many different weights leave too many cells."""
    rows = train.select("features", F.col("label").cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    cuts = place_sampled_cuts(rows, train.count(), bins, seed)
    if not cuts:
        return None
    cells = stage(rows.groupBy(_code_column(cuts).alias("code"), "y", "w").agg(F.count(F.lit(1)).alias("n")), "forest-cells")
    usable = F.col("y").isin(0.0, 1.0) & (F.col("w") >= 0) & (F.col("w") < float("inf"))
    labels, odd, number = cells.agg(F.count_distinct("y"), F.count_if(~F.coalesce(usable, F.lit(False))), F.count(F.lit(1))).first()
    if labels != 2 or odd or number > 4 * CELL_LIMIT:
        return None
    bagged = draw_bags(cells.withColumn("y", F.col("y").cast("int")), trees, seed)
    return grow_cells(bagged, cuts, trees, depth, min_leaf, seed), cuts


def decision_table(forest: list[dict[str, np.ndarray]], cuts: list[np.ndarray]) -> np.ndarray:
    """Mean leaf value of every cell: each leaf is a box of cells, and its value is added to the whole box."""
    table = np.zeros(tuple(len(c) + 1 for c in cuts))
    for tree in forest:
        todo = [(0, [0] * len(cuts), list(table.shape))]
        while todo:
            u, lo, hi = todo.pop()
            f = int(tree["feat"][u])
            if f < 0:
                table[tuple(map(slice, lo, hi))] += tree["value"][u]
                continue
            at = int(np.searchsorted(cuts[f], tree["cut"][u], "left")) + 1  # bins up to this cut go left
            todo.append((int(tree["left"][u]), lo, [*hi[:f], min(hi[f], at), *hi[f + 1:]]))
            todo.append((int(tree["right"][u]), [*lo[:f], max(lo[f], at), *lo[f + 1:]], hi))
    return table.reshape(-1) / max(1, len(forest))


def score(df: DataFrame, cuts: list[np.ndarray], table: np.ndarray, out: str = "p") -> DataFrame:
    """`df` with `out`, the mean leaf value over all trees, from its `features`."""
    shared = SparkSession.active().sparkContext.broadcast((cuts, table))  # at most CELL_LIMIT numbers

    def run(features: pa.Array) -> pa.Array:
        cuts, table = shared.value
        return pa.array(table[codes(_matrix(features, len(cuts)), cuts)], pa.float64())

    run.__annotations__ = {"features": pa.Array, "return": pa.Array}
    return df.select(*df.columns, F.arrow_udf(run, "double")(vector_to_array("features")).alias(out))
