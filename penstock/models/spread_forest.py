"""Bagged forests whose nodes stay on the executors, for many rows of many features.

The nodes of deep trees grow with the rows, so a forest of hundreds of them does not fit the driver. Here rows are binned once and
staged in chunks of bytes; each subtree is grown inside one task, written as one row of arrays to shared storage, and scored where it
is read. The driver holds the tops of the trees: nodes of more than `LOCAL_ROWS` drawn rows, split by sums over (tree, node, feature,
bin) as in `cell_forest`. Up to `LOCAL_ROWS` rows a tree has no top and is grown as a whole. The rest is MLlib's forest:
* cuts: `cell_forest` places them, at most `bins - 1` a feature, from a seeded sample; every row is binned and used.
* bags: a row is in a tree's bag Poisson(1) times, drawn by a hash of (seed, tree, chunk, place), so any task draws the same bag.
* splits: `ceil(sqrt(p))` features a node (all for a single tree), the cut of largest weighted Gini decrease that leaves `min_leaf`
  drawn rows on both sides; sibling leaves of one class become one leaf.

A task holds at most about `LOCAL_ROWS` rows of one byte a feature, and `SCORE_NODES` nodes or one subtree when scoring.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from penstock.models.cell_forest import best_splits, place_sampled_cuts
from penstock.models.extra_trees import LEAF, OPEN, Tree, walk
from penstock.sources.staging import stage

HELD = -3  # a node of a top that is grown as a subtree inside a task
LOCAL_ROWS = 1 << 20
GROUPS = 32  # tasks that grow or score the trees of one forest, where no limit asks for more
SCORE_NODES = 1 << 22
CHUNK_ROWS = 1 << 13
HISTOGRAM = 1 << 18  # sums held at once per class while a subtree is grown
LEAST_GAIN = 1e-12

UNIT = "tree int, top int, n long, pure boolean, share double, feat binary, cut binary, left binary, value binary"


@dataclass
class Forest:
    """`tops` end in `HELD` nodes; `units` has their subtrees, `sizes` the nodes of each by (tree, top)."""

    tops: list[dict[str, np.ndarray]]
    cuts: list[np.ndarray]
    units: DataFrame
    sizes: dict[tuple[int, int], int]

    @property
    def nodes(self) -> int:
        return sum(self.sizes.values()) + sum(int((t["feat"] != HELD).sum()) for t in self.tops)


# ---------------------------------------------------------------- rows as bytes


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), width)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of every feature as one byte. A value is right of the cuts below it."""
    return np.stack([np.searchsorted(cut, x[:, f], "left").astype(np.uint8) for f, cut in enumerate(cuts)], 1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of `CHUNK_ROWS` rows, numbered over all partitions."""
    at = TaskContext.get().partitionId() << 32
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK_ROWS):
            yield at, batch.slice(start, CHUNK_ROWS)
            at += 1


def packed(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """`(features, y, w)` in chunks: bins, labels and weights as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, b in _chunks(batches):
            y, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            yield pa.record_batch({
                "chunk": pa.array([chunk], pa.int64()), "n": pa.array([b.num_rows], pa.int32()), "at": pa.array([b""], pa.binary()),
                "x": pa.array([binned(_matrix(b.column("x"), len(cuts)), cuts).tobytes()], pa.binary()),
                "y": pa.array([y.astype(np.uint8).tobytes()], pa.binary()), "w": pa.array([w.astype(np.float64).tobytes()], pa.binary()),
            })

    flat = rows.select(vector_to_array("features").alias("x"), "y", "w")
    return stage(flat.mapInArrow(run, "chunk long, n int, at binary, x binary, y binary, w binary"), "forest-rows")


def _unpacked(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["x"], np.uint8).reshape(-1, width), np.frombuffer(row["y"], np.uint8), np.frombuffer(row["w"], np.float64)


# ---------------------------------------------------------------- bags

# P(a row is in a bag at most i times)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def _mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bag(seed: int, tree: int, chunk: int, n: int) -> np.ndarray:
    """How often each row of a chunk is in a tree's bag."""
    start = np.zeros(1, np.uint64)
    for part in (seed, tree, chunk):
        start = _mix(start + np.array([part & (2**64 - 1)], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    u = _mix(start + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
    return np.searchsorted(_POISSON, u * 2.0**-53, "right")


# ---------------------------------------------------------------- subtrees


def _drawn(rng: np.random.Generator, nodes: int, k: int, width: int) -> np.ndarray:
    """`k` features a node without replacement (Floyd's sampling, all nodes at once)."""
    out = np.empty((nodes, k), np.int64)
    for i, top in enumerate(range(width - k, width)):
        pick = rng.integers(0, top + 1, nodes)
        out[:, i] = np.where((out[:, :i] == pick[:, None]).any(1), top, pick)
    return out


def _share(w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
    total = w0 + w1
    return np.where(total > 0, w1 / np.where(total > 0, total, 1.0), 0.0)


def _level(x, c, c0, c1, rows, counts, k, bins, min_leaf, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split feature (`LEAF`: none) and bin of every open node, and the side of each row; `rows` come node by node, `counts` a node."""
    feat, cut, right = np.full(len(counts), LEAF, np.int64), np.zeros(len(counts), np.int64), np.zeros(len(rows), bool)
    ends, some = np.concatenate([[0], np.cumsum(counts)]), max(1, HISTOGRAM // (k * bins))
    for a in range(0, len(counts), some):
        b = min(a + some, len(counts))
        r, m = rows[ends[a]:ends[b]], b - a
        node = np.repeat(np.arange(m), counts[a:b])
        f = _drawn(rng, m, k, x.shape[1])
        sums = np.empty((3, m, k, bins))
        weights = [v[r] for v in (c0, c1, c)]
        for j in range(k):
            key = node * bins + x[r, f[node, j]]
            for i, v in enumerate(weights):
                sums[i, :, j] = np.bincount(key, v, m * bins).reshape(m, bins)
        left = np.cumsum(sums, axis=3)
        whole = left[..., -1:]
        l0, l1, ln = left
        r0, r1, rn = np.maximum(whole - left, 0.0)
        lw, rw = l0 + l1, r0 + r1
        pure = (l0 * l0 + l1 * l1) / np.where(lw > 0, lw, 1.0) + (r0 * r0 + r1 * r1) / np.where(rw > 0, rw, 1.0)
        pure = np.where((ln >= min_leaf) & (rn >= min_leaf), pure, -np.inf).reshape(m, -1)
        best = pure.argmax(1)
        w0, w1 = whole[0, :, 0, 0], whole[1, :, 0, 0]
        total = w0 + w1
        gain = (pure[np.arange(m), best] - (w0 * w0 + w1 * w1) / total) / total
        ok = gain > LEAST_GAIN
        feat[a:b] = np.where(ok, f[np.arange(m), best // bins], LEAF)
        cut[a:b] = np.where(ok, best % bins, 0)
        right[ends[a]:ends[b]] = x[r, np.maximum(feat[a:b], 0)[node]] > cut[a:b][node]
    return feat, cut, right


def grow_unit(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: np.ndarray, depth: int, min_leaf: int, k: int, bins: int,
              rng: np.random.Generator) -> dict[str, np.ndarray]:
    """A tree on bins `x`, rows drawn `c` times: `feat`, `cut` (last bin on the left), `left` (the right child follows it), `value`."""
    c = c.astype(np.float64)
    c0, c1 = c * w * (1.0 - y), c * w * y
    value = _share(c0.sum()[None], c1.sum()[None])
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    levels = []
    for level in range(depth + 1):
        feat, cut, left = np.full(len(value), LEAF, np.int64), np.zeros(len(value), np.int64), np.zeros(len(value), np.int64)
        levels.append((feat, cut, left, value))
        is_open = (value > 0) & (value < 1)
        if level == depth or not is_open.any():
            break
        keep = is_open[node]
        rows, node = rows[keep], node[keep]
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        opened, counts = np.unique(node, return_counts=True)
        feat[opened], cut[opened], right = _level(x, c, c0, c1, rows, counts, k, bins, min_leaf, rng)
        split = feat >= 0
        if not split.any():
            break
        left[split] = 2 * np.arange(split.sum())
        keep = split[node]
        rows, node = rows[keep], left[node[keep]] + right[keep]
        value = _share(np.bincount(node, c0[rows], 2 * split.sum()), np.bincount(node, c1[rows], 2 * split.sum()))
    return _pruned(levels)


def _pruned(levels: list[tuple[np.ndarray, ...]]) -> dict[str, np.ndarray]:
    """Sibling leaves of one class merged, bottom up; the nodes that remain, level by level."""
    for (feat, _, left, _), (below, _, _, value) in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        at = np.nonzero(feat >= 0)[0]
        a, b = left[at], left[at] + 1
        feat[at[(below[a] < 0) & (below[b] < 0) & ((value[a] > 0.5) == (value[b] > 0.5))]] = LEAF
    out, reached, end = [], np.zeros(1, np.int64), 1
    for feat, cut, left, value in levels:
        split = feat[reached] >= 0
        to = np.where(split, end + 2 * (np.cumsum(split) - 1), 0)
        out.append((feat[reached], cut[reached], to, value[reached]))
        first = left[reached[split]]
        reached = np.stack([first, first + 1], 1).reshape(-1)
        end += len(reached)
        if not len(reached):
            break
    feat, cut, left, value = (np.concatenate(c) for c in zip(*out, strict=True))
    return {"feat": feat.astype(np.int32), "cut": cut.astype(np.uint8), "left": left.astype(np.int32), "value": value}


_KINDS = {"feat": np.int32, "cut": np.uint8, "left": np.int32, "value": np.float64}


def walk_unit(unit: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Leaf value of each row of bins."""
    node, idx = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(idx):
        f = unit["feat"][node[idx]]
        idx, f = idx[f >= 0], f[f >= 0]
        at = node[idx]
        node[idx] = unit["left"][at] + (x[idx, f] > unit["cut"][at])
    return unit["value"][node]


# ---------------------------------------------------------------- the forest


def _tops(rows: DataFrame, cuts: list[np.ndarray], trees: int, depth: int, min_leaf: int, seed: int, k: int, bins: int, n: int) -> list[Tree]:
    """The trees down to nodes of at most `LOCAL_ROWS` drawn rows, one pass a level over all trees."""
    forest, width = [Tree() for _ in range(trees)], len(cuts)
    if n <= LOCAL_ROWS:
        for tree in forest:
            tree.feat[0] = HELD
        return forest

    def decode(batch: pa.RecordBatch) -> Iterator[tuple]:
        for row in batch.to_pylist():
            x, y, w = _unpacked(row, width)
            yield x, y.astype(np.float64), w, lambda t, row=row: bag(seed, t, row["chunk"], row["n"])

    for level in range(depth):
        arrays = [t.arrays() for t in forest]
        if not any((a["feat"] == OPEN).any() for a in arrays):
            break
        drawn = [_drawn(np.random.default_rng([seed, t, level]), len(a["feat"]), k, width) for t, a in enumerate(arrays)]
        chosen = {(r.tree, r.node): r for r in best_splits(rows, decode, bins, arrays, drawn, k, min_leaf)}
        for t, tree in enumerate(forest):
            for u in np.nonzero(arrays[t]["feat"] == OPEN)[0].tolist():
                r = chosen.get((t, u))
                if r is None:
                    tree.feat[u] = LEAF
                    continue
                tree.feat[u], tree.cut[u] = int(drawn[t][u, r.k]), float(r.bin)
                tree.value[u] = float(_share(np.float64(r.lw0 + r.rw0), np.float64(r.lw1 + r.rw1)))
                for side, w0, w1, m in (("left", r.lw0, r.lw1, r.ln), ("right", r.rw0, r.rw1, r.rn)):
                    child = tree.add(float(_share(np.float64(w0), np.float64(w1))), level + 1)
                    getattr(tree, side)[u] = child
                    if m <= LOCAL_ROWS or level + 1 == depth:
                        tree.feat[child] = HELD
    for tree in forest:
        tree.feat = [LEAF if f == OPEN else f for f in tree.feat]
    return forest


def _dealt(units: list[tuple[int, int]], sizes: list[int], limit: int, least: int) -> list[list[tuple[int, int]]]:
    """Units in groups, each unit to the smallest group: as many groups as keep the sizes below `limit`, and `least` if there are units."""
    groups: list[list] = [[] for _ in range(min(len(units), max(least, -(-2 * sum(sizes) // limit))))]
    held = np.zeros(len(groups))
    for size, unit in sorted(zip(sizes, units, strict=True), reverse=True):
        g = int(held.argmin())
        groups[g].append(unit)
        held[g] += size
    return groups


def _routed(rows: DataFrame, groups: list[list], tops: list[dict], width: int) -> DataFrame:
    """Chunks of rows for every group: whole ones where trees have no tops, else the rows that reach one of the group's units."""
    if all(len(t["feat"]) == 1 for t in tops):
        return rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1))))
    where = {unit: g for g, some in enumerate(groups) for unit in some}
    group = [np.array([where.get((t, u), -1) for u in range(len(a["feat"]))]) for t, a in enumerate(tops)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            x, y, w = _unpacked(row, width)
            seen = np.zeros((len(groups) + 1, len(x)), bool)
            for t, top in enumerate(tops):
                seen[group[t][walk(top, x)], np.arange(len(x))] = True
            for g in np.nonzero(seen[:-1].any(1))[0].tolist():
                at = np.nonzero(seen[g])[0].astype(np.int32)
                yield pa.record_batch({
                    "chunk": pa.array([row["chunk"]], pa.int64()), "n": pa.array([row["n"]], pa.int32()), "at": pa.array([at.tobytes()], pa.binary()),
                    "x": pa.array([x[at].tobytes()], pa.binary()), "y": pa.array([y[at].tobytes()], pa.binary()),
                    "w": pa.array([w[at].tobytes()], pa.binary()), "g": pa.array([g], pa.int32()),
                })

    return rows.mapInArrow(run, "chunk long, n int, at binary, x binary, y binary, w binary, g int")


def _grown(routed: DataFrame, groups: list[list], forest: list[Tree], depth: int, min_leaf: int, seed: int, k: int, bins: int, width: int) -> DataFrame:
    tops, depths = [t.arrays() for t in forest], [t.depth for t in forest]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunks = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        parts = [_unpacked(r, width) for r in chunks]
        x, y, w = (np.concatenate(c) for c in zip(*parts, strict=True))
        at = [np.frombuffer(r["at"], np.int32) if r["at"] else slice(None) for r in chunks]
        ids = [(r["chunk"], r["n"]) for r in chunks]
        del chunks, parts, table
        out: list[dict] = []
        for t, u in groups[key[0].as_py()]:
            c = np.concatenate([bag(seed, t, chunk, n)[some] for (chunk, n), some in zip(ids, at, strict=True)])
            here = c > 0
            if len(tops[t]["feat"]) > 1:
                here &= walk(tops[t], x) == u
            rng = np.random.default_rng([seed, t, u, depth])
            unit = grow_unit(x[here], y[here], w[here], c[here], depth - depths[t][u], min_leaf, k, bins, rng)
            out.append({"tree": t, "top": u, "n": len(unit["feat"]), "pure": len(unit["feat"]) == 1, "share": float(unit["value"][0])}
                       | {c: v.tobytes() for c, v in unit.items()})
        return pa.Table.from_pylist(out, schema=pa.schema([
            ("tree", pa.int32()), ("top", pa.int32()), ("n", pa.int64()), ("pure", pa.bool_()), ("share", pa.float64()),
            *[(c, pa.binary()) for c in _KINDS]]))

    return stage(routed.repartitionByRange(len(groups), "g").groupBy("g").applyInArrow(run, UNIT), "forest-units")


def grow(train: DataFrame, trees: int, depth: int, min_leaf: int = 1, seed: int = 42, weight: str | None = None, bins: int = 32) -> Forest | None:
    """Fit a bagged forest on `(features, label[, weight])`.

    None where MLlib refuses or handles the rows: labels that are not both 0 and 1, no or odd weights, features that are null, of
    several widths or of more than 256 bins."""
    rows = train.select("features", F.col("label").cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    usable = F.col("y").isin(0.0, 1.0) & (F.col("w") >= 0) & (F.col("w") < float("inf")) & F.col("features").isNotNull()
    size = F.size(vector_to_array("features"))
    n, labels, odd, least, width = rows.agg(
        F.count(F.lit(1)), F.count_distinct("y"), F.count_if(~F.coalesce(usable, F.lit(False))), F.min(size), F.max(size)).first()
    if labels != 2 or odd or least != width or width < 1 or bins > 256:
        return None
    cuts = place_sampled_cuts(rows, n, bins, seed)
    if not cuts:
        return None
    chunks, k = packed(rows, cuts), width if trees == 1 else math.ceil(math.sqrt(width))
    forest = _tops(chunks, cuts, trees, depth, min_leaf, seed, k, bins, n)
    tops = [t.arrays() for t in forest]
    units = [(t, u) for t, a in enumerate(tops) for u in np.nonzero(a["feat"] == HELD)[0].tolist()]
    whole = all(len(a["feat"]) == 1 for a in tops)  # a group of whole trees holds each row once
    groups = _dealt(units, [1] * len(units), 1 << 62, GROUPS) if whole else _dealt(units, [1] * len(units), 2, GROUPS)
    found = _grown(_routed(chunks, groups, tops, width), groups, forest, depth, min_leaf, seed, k, bins, width)
    made = {(r.tree, r.top): r for r in found.select("tree", "top", "n", "pure", "share").collect()}  # five numbers a subtree
    if len(made) != len(units):
        raise RuntimeError(f"{len(made)} of {len(units)} subtrees were grown")
    for t, tree in enumerate(forest):
        leaf = {u: float(made[t, u].share) for u in range(len(tree.feat)) if tree.feat[u] == HELD and made[t, u].pure}
        leaf |= {u: tree.value[u] for u in range(len(tree.feat)) if tree.feat[u] == LEAF}
        for u in reversed(range(len(tree.feat))):
            a, b = tree.left[u], tree.right[u]
            if tree.feat[u] >= 0 and a in leaf and b in leaf and (leaf[a] > 0.5) == (leaf[b] > 0.5):
                tree.feat[u], leaf[u] = LEAF, tree.value[u]
                tree.feat[a] = tree.feat[b] = LEAF
    tops = [t.arrays() for t in forest]
    sizes = {at: int(r.n) for at, r in made.items() if tops[at[0]]["feat"][at[1]] == HELD}
    return Forest(tops, cuts, found, sizes)


def score(df: DataFrame, forest: Forest, out: str = "p") -> DataFrame:
    """`df` with `out`, the mean leaf value over all trees, from its `features`. Chunks of rows meet groups of subtrees; sums go back by chunk."""
    spark = SparkSession.active()
    units = list(forest.sizes)
    groups = _dealt(units, [forest.sizes[u] for u in units], SCORE_NODES, GROUPS) or [[]]
    slices = max(1, -(-df.count() // LOCAL_ROWS))
    cuts, tops, trees = forest.cuts, forest.tops, len(forest.tops)
    whole = all(len(a["feat"]) == 1 and a["feat"][0] == HELD for a in tops)
    keep = [f for f in df.schema.fields if f.name != "features"]
    flat = df.select(*[f.name for f in keep], vector_to_array("features").alias("_x"))
    schema = StructType([*keep, flat.schema["_x"], StructField(out, DoubleType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, b in _chunks(batches):
            x, sink = binned(_matrix(b.column("_x"), len(cuts)), cuts), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as writer:
                writer.write_batch(b)
            whole_batch = sink.getvalue().to_pybytes()
            yield pa.record_batch({  # the checksum keeps a chunk apart from another content that a repeated task may give it
                "chunk": pa.array([f"{chunk}-{zlib.crc32(whole_batch)}"]), "s": pa.array([(chunk + (chunk >> 32)) % slices], pa.int32()),
                "x": pa.array([x.tobytes()], pa.binary()), "rows": pa.array([whole_batch], pa.binary())})

    def walked(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        g, chunks = key[0].as_py(), left.to_pylist()
        if not chunks:
            return pa.table({"chunk": pa.array([], pa.string()), "g": pa.array([], pa.int32()), "p": pa.array([], pa.binary()), "rows": pa.array([], pa.binary())})
        x = np.concatenate([np.frombuffer(r["x"], np.uint8).reshape(-1, len(cuts)) for r in chunks])
        p = np.zeros(len(x))
        if g == 0 and not whole:
            for top in tops:
                node = walk(top, x)
                p += np.where(top["feat"][node] == LEAF, top["value"][node], 0.0)
        for i in sorted(range(right.num_rows), key=lambda i: (right["tree"][i].as_py(), right["top"][i].as_py())):
            t, u = right["tree"][i].as_py(), right["top"][i].as_py()
            unit = {c: np.frombuffer(right[c][i].as_buffer(), kind) for c, kind in _KINDS.items()}
            if len(tops[t]["feat"]) == 1:
                p += walk_unit(unit, x)
            else:
                here = np.nonzero(walk(tops[t], x) == u)[0]
                p[here] += walk_unit(unit, x[here])
        ends = np.cumsum([len(r["x"]) // len(cuts) for r in chunks])[:-1]
        return pa.table({
            "chunk": pa.array([r["chunk"] for r in chunks], pa.string()), "g": pa.array([g] * len(chunks), pa.int32()),
            "p": pa.array([part.tobytes() for part in np.split(p, ends)], pa.binary()), "rows": pa.array([r["rows"] for r in chunks], pa.binary())})

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["g"])
        if [r["g"] for r in parts] != list(range(len(groups))):
            raise RuntimeError("a chunk of rows was not scored by every group of trees")
        p = sum(np.frombuffer(r["p"], np.float64) for r in parts) / max(1, trees)
        rows = pa.ipc.open_stream(parts[0]["rows"]).read_all()
        return rows.append_column(out, pa.array(p, pa.float64()))

    chunks = flat.mapInArrow(pack, "chunk string, s int, x binary, rows binary").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1))))
    chunks = chunks.withColumn("rows", F.when(F.col("g") == 0, F.col("rows")))
    where = spark.createDataFrame([(t, u, g) for g, some in enumerate(groups) for t, u in some], "tree int, top int, g int")
    subtrees = forest.units.join(F.broadcast(where), ["tree", "top"]).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    parts = chunks.groupBy("g", "s").cogroup(subtrees.groupBy("g", "s")).applyInArrow(walked, "chunk string, g int, p binary, rows binary")
    scored = parts.groupBy("chunk").applyInArrow(summed, schema)
    return scored.withColumn("features", array_to_vector("_x")).select(*df.columns, out)


# ---------------------------------------------------------------- saved forests


def save(forest: Forest, path: str) -> None:
    spark = SparkSession.active()
    kept = [(t, u) for t, u in forest.sizes]
    forest.units.join(F.broadcast(spark.createDataFrame(kept, "tree int, top int")), ["tree", "top"]).write.mode("overwrite").parquet(f"{path}/units")
    told = json.dumps({"cuts": [c.tolist() for c in forest.cuts], "tops": [{c: v.tolist() for c, v in t.items()} for t in forest.tops]})
    spark.createDataFrame([(told,)], "forest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/tops")


def load(spark: SparkSession, path: str) -> Forest:
    told = json.loads(spark.read.parquet(f"{path}/tops").first()["forest"])
    units = spark.read.parquet(f"{path}/units")
    sizes = {(r.tree, r.top): int(r.n) for r in units.select("tree", "top", "n").collect()}
    kinds = {"feat": np.int64, "cut": np.float64, "left": np.int64, "right": np.int64, "value": np.float64}
    tops = [{c: np.array(v, kinds[c]) for c, v in t.items()} for t in told["tops"]]
    return Forest(tops, [np.array(c, np.float64) for c in told["cuts"]], units, sizes)
