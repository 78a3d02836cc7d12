"""Exact k nearest neighbours as a pruned, skew-safe join.

1. Copies of a vector are joined once: each distinct vector stands for its rows, with the few smallest ids
   that can still be among the k best.
2. A bounded number of reference points (pivots) is drawn; each vector joins the cell of its nearest pivot.
3. From the cell radii and the smallest distances to each pivot, the triangle inequality bounds the
   distance of the k-th neighbour of every query; cells that lie beyond the bound are skipped.
4. Queries travel only to the cells they still need. A cell with many candidates is cut into slices, and its
   queries into batches, so no task holds more than about one slice and one batch.
5. Every (batch, slice) yields the best k per query; a final top-k merges the slices. Squared distances from one matrix
   product leave the candidates that may be among the k best by more than the rounding error; those alone are measured by differences.

The number of pivots follows from the slice size, so a query that needs every cell is sent once a slice of candidates, and
the cells of a query stay one short list until the join. Work arrays hold `_CELLS` numbers.

Nothing is dropped to save work: a skipped cell provably holds no neighbour. The method follows the
published pivot-based kNN join (Lu, Shen, Chen, Ooi; VLDB 2012).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penstock.functions.draws import seeded_hash
from penstock.sources.staging import stage

MAX_PIVOTS = 4096
SLICE_ROWS = 16384
_SPREAD = 64
_SLACK = 1e-9
_CELLS = 500_000


def knn_join(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    same_table: bool = False,
    pivots: int | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """`(id, neighbor, distance, rank)`: the k nearest candidates of each query row, ties by id.

    Both tables hold `id BIGINT` and `vec ARRAY<DOUBLE>`. With `same_table` a row is not its own neighbour.
    """
    need = k + (1 if same_table else 0)
    distinct = stage(_distinct_vectors(candidates, need), "knn-distinct")
    if same_table:
        asked = distinct.select("id", "vec")
    else:
        asked = stage(queries.groupBy("vec").agg(F.min("id").alias("id")), "knn-asked")
    pairs = _nearest_vectors(asked, distinct.select("id", "vec"), need, pivots, slice_rows)
    copies = distinct.select(F.col("id").alias("neighbor"), "ids")
    first = Window.partitionBy("id").orderBy("distance", "neighbor")
    near = (
        pairs.join(copies, "neighbor")
        .select("id", "distance", F.explode("ids").alias("neighbor"))
        .withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= need)
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("distance", "neighbor"))).alias("near"))
    )
    answers = asked.join(near, "id").select("vec", "near")
    rows = queries.select("id", "vec").join(answers, "vec")
    if same_table:
        rows = rows.withColumn("near", F.filter("near", lambda x: x["neighbor"] != F.col("id")))
    return rows.select("id", F.posexplode(F.slice("near", 1, k)).alias("at", "hit")).select(
        "id", F.col("hit.neighbor").alias("neighbor"), F.col("hit.distance").alias("distance"), (F.col("at") + 1).alias("rank")
    )


def _distinct_vectors(candidates: DataFrame, need: int) -> DataFrame:
    """`(vec, id, ids)`: smallest id and the `need` smallest ids of each distinct vector.

    Ids are ranked within hash parts first, so a vector with very many copies is not sorted in one task.
    """
    part = Window.partitionBy("vec", "_part").orderBy("id")
    spread = candidates.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(_SPREAD)).alias("_part"))
    few = spread.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= need)
    ids = F.slice(F.sort_array(F.collect_list("id")), 1, need)
    return few.groupBy("vec").agg(F.min("id").alias("id"), ids.alias("ids"))


def _nearest_vectors(asked: DataFrame, distinct: DataFrame, need: int, pivots: int | None, slice_rows: int) -> DataFrame:
    """`(id, neighbor, distance)`: the `need` nearest distinct candidate vectors of each asked vector."""
    spark = asked.sparkSession
    total = distinct.count()
    n_pivots = max(1, min(pivots or min(int(total**0.5), -(-total // slice_rows)), MAX_PIVOTS))
    chosen = distinct.orderBy(seeded_hash("pivot", "id"), "id").limit(n_pivots).select("vec").collect()
    if not chosen:
        return spark.createDataFrame([], "id long, neighbor long, distance double")
    points = np.array([r["vec"] for r in chosen], dtype=float)  # at most MAX_PIVOTS rows
    n_pivots = len(points)

    cells = stage(_nearest_pivot(distinct, points), "knn-cells")
    radius, bounds, sizes = _cell_facts(cells, n_pivots, need)
    routed = stage(_route(asked, points, radius, bounds, sizes, need), "knn-routed")
    visited = routed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    visits = {r["cell"]: r["n"] for r in visited.collect()}  # one row per pivot
    grid = spark.createDataFrame(
        [(c, max(1, -(-int(sizes[c]) // slice_rows)), max(1, -(-visits.get(c, 0) // slice_rows))) for c in range(n_pivots)],
        "cell int, n_slices long, n_batches long",
    )
    grid = F.broadcast(grid)  # one row per pivot

    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    spot = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    left = routed.select("id", "vec", F.explode("cells").alias("cell")).join(grid, "cell").withColumn("batch", spot("n_batches")).withColumn("slice", numbers("n_slices"))
    right = cells.join(grid, "cell").withColumn("slice", spot("n_slices")).withColumn("batch", numbers("n_batches"))
    keys, columns = ["cell", "batch", "slice"], ["cell", "batch", "slice", "id", "vec"]
    found = (
        left.select(*columns)
        .groupBy(*keys)
        .cogroup(right.select(*columns).groupBy(*keys))
        .applyInPandas(_best_of(need), "id long, neighbor long, distance double")
    )
    merge = Window.partitionBy("id").orderBy("distance", "neighbor")
    return found.withColumn("_r", F.row_number().over(merge)).filter(F.col("_r") <= need).drop("_r")


def _cell_facts(cells: DataFrame, n_pivots: int, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Radius, `need` smallest distances to the pivot, and row count of each cell."""
    part = Window.partitionBy("cell", "_part").orderBy("to_pivot")
    spread = cells.select("cell", "to_pivot", F.pmod(F.xxhash64("id"), F.lit(_SPREAD)).alias("_part"))
    few = spread.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= need)
    closest = few.groupBy("cell").agg(F.slice(F.sort_array(F.collect_list("to_pivot")), 1, need).alias("closest"))
    extent = cells.groupBy("cell").agg(F.max("to_pivot").alias("radius"), F.count(F.lit(1)).alias("n"))
    radius, sizes = np.full(n_pivots, -1.0), np.zeros(n_pivots, dtype="int64")
    bounds = np.full((n_pivots, need), np.inf)
    for fact in extent.join(closest, "cell").collect():  # one row per pivot
        radius[fact["cell"]], sizes[fact["cell"]] = fact["radius"], fact["n"]
        bounds[fact["cell"], : len(fact["closest"])] = fact["closest"]
    return radius, bounds, sizes


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, in bounded memory."""
    out = np.empty((len(rows), len(points)))
    step = max(1, _CELLS // max(1, points.size))
    for i in range(0, len(rows), step):
        delta = rows[i : i + step, None, :] - points[None, :, :]
        out[i : i + step] = np.sqrt((delta * delta).sum(axis=2))
    return out


def _nearest_pivot(df: DataFrame, points: np.ndarray) -> DataFrame:
    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = max(1, _CELLS // len(points))
        for whole in frames:
            for start in range(0, len(whole), rows):
                frame = whole.iloc[start : start + rows]
                d = _distances(np.stack(frame["vec"].to_numpy()), points)
                cell = d.argmin(axis=1)
                yield frame.assign(cell=cell, to_pivot=d[np.arange(len(frame)), cell])

    return df.mapInPandas(assign, "id long, vec array<double>, cell int, to_pivot double")


def _route(asked: DataFrame, points: np.ndarray, radius: np.ndarray, bounds: np.ndarray, sizes: np.ndarray, need: int) -> DataFrame:
    """Asked vectors with the cells that may hold one of their neighbours."""

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = max(1, _CELLS // bounds.size)
        for whole in frames:
            for start in range(0, len(whole), rows):
                frame = whole.iloc[start : start + rows]
                d = _distances(np.stack(frame["vec"].to_numpy()), points)
                upper = (d[:, :, None] + bounds[None, :, :]).reshape(len(frame), -1)
                reach = np.partition(upper, need - 1, axis=1)[:, need - 1]
                lower = np.maximum(d - radius[None, :], 0.0)
                wanted = (lower <= reach[:, None] * (1 + _SLACK) + _SLACK) & (sizes > 0)[None, :]
                yield frame.assign(cells=[np.nonzero(w)[0].astype("int32") for w in wanted])

    return asked.select("id", "vec").mapInPandas(visit, "id long, vec array<double>, cells array<int>")


def _nearest(x: np.ndarray, y: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(row of x, row of y, distance)` of the `need` nearest rows of `y` for each row of `x`, nearest first, ties by row.

    `|x|^2 + |y|^2 - 2xy` is off by at most the slack; a row of `y` further beyond the `need`-th best than twice that is no
    neighbour. Rows that cannot be compared (NaN) stay in.
    """
    need = min(need, len(y))
    yy = (y * y).sum(axis=1)
    rows = max(1, _CELLS // len(y))
    pairs = max(1, _CELLS // max(1, x.shape[1]))
    found = []
    for start in range(0, len(x), rows):
        part = x[start : start + rows]
        xx = (part * part).sum(axis=1)
        rough = xx[:, None] + yy[None, :] - 2.0 * (part @ y.T)
        limit = np.partition(rough, need - 1, axis=1)[:, need - 1]
        slack = 8.0 * (x.shape[1] + 4) * np.finfo(float).eps * (xx + yy.max())
        i, j = np.nonzero(~(rough > (limit + slack)[:, None]))
        d = np.empty(len(i))
        for at in range(0, len(i), pairs):
            delta = part[i[at : at + pairs]] - y[j[at : at + pairs]]
            d[at : at + pairs] = np.sqrt((delta * delta).sum(axis=1))
        order = np.lexsort((j, d, i))
        first = np.searchsorted(i, np.arange(len(part)))  # `i` ascends and sorting keeps its blocks
        keep = order[np.arange(len(i)) - first[i] < need]
        found.append((i[keep] + start, j[keep], d[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _best_of(need: int):
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "neighbor": [], "distance": []})
        right = right.sort_values("id")
        i, j, d = _nearest(np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy()), need)
        return pd.DataFrame({"id": left["id"].to_numpy()[i], "neighbor": right["id"].to_numpy()[j], "distance": d})

    return best


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """`(id, votes, prediction)` by majority of the k nearest train rows; `train` also holds `label` 0/1."""
    pairs = knn_join(test, train, k)
    labels = train.select(F.col("id").alias("neighbor"), "label")
    voted = pairs.join(labels, "neighbor").groupBy("id").agg(
        F.sum("label").cast("long").alias("votes"), F.count(F.lit(1)).alias("_n")
    )
    return voted.select("id", "votes", F.when(F.col("votes") * 2 > F.col("_n"), 1).otherwise(0).alias("prediction"))
