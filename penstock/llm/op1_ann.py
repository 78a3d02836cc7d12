"""Approximate nearest neighbours by cross-polytope hashing, largest cosine first.

Every table rotates the unit vectors with three rounds of random signs and a fast Hadamard transform, and hashes a vector to the
signed axis it is nearest to. With `functions` > 1 a table's bucket is a tuple of such axes, from rotations of their own; that is the setting for
tables of billions of rows. A query also probes the buckets of its next-best axes (`probes` buckets per table, ordered by
the loss of projection). What meets in a bucket is reranked by exact cosines of the original vectors, in double precision.

Buckets are cut into blocks of `ROWS` rows and `QUERIES` queries by counts per bucket, so neither a popular direction nor a vector with very many
copies lands in one task. Of equal vectors only the k + 1 smallest ids are indexed; a query can never need more. Inside a task, the queries of a
block meet its rows as matrix products, and only the k best ids of each query leave. A query that found fewer than k (a tiny table) is compared with
the rows of every bucket of the first table.

Results: rows whose id or vector is null, whose vector is zero or empty, holds null or non-finite components, or has another length than most
(ties: the longer), take no part. Ties in the score go to the smaller id. Rows that share a query's id are never its candidates; a candidate id
that occurs repeatedly counts once, with its best score. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penstock.llm.common import in_arrow, table, tasks_for
from penstock.operators.joins import small_side
from penstock.sources.staging import stage

K, TABLES, PROBES, FUNCTIONS, SEED = 5, 16, 6, 1, 11
ROWS, QUERIES = 20_000, 4_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast orthonormal Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotations(dim: int, tables: int, functions: int, seed: int) -> np.ndarray:
    width = 1 << max(0, dim - 1).bit_length()
    return np.random.Generator(np.random.PCG64(seed)).choice([-1.0, 1.0], (tables, functions, 3, width))


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(x), signs.shape[1]))
    wide[:, : x.shape[1]] = x
    for flip in signs:
        wide = hadamard(wide * flip)
    return wide


def buckets(x: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """Buckets of each row in one table, best first: (rows, probes). `signs` is (functions, 3, width)."""
    width = signs.shape[2]
    codes, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for own in signs:
        r = rotated(x, own)
        each = min(probes, 2 * width)
        both = np.concatenate([r, -r], axis=1)  # signed axes
        best = np.argsort(-both, axis=1, kind="stable")[:, :each]
        top = np.take_along_axis(both, best, axis=1)
        lost = (top[:, :1] - top) ** 2
        codes = (codes[:, :, None] * (2 * width) + best[:, None, :]).reshape(len(x), -1)
        loss = (loss[:, :, None] + lost[:, None, :]).reshape(len(x), -1)
        keep = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        codes, loss = np.take_along_axis(codes, keep, axis=1), np.take_along_axis(loss, keep, axis=1)
    return codes


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, ident: str, vector: str) -> tuple[DataFrame, int]:
    """`(id, v)` of rows that take part, with the doubles of the vector as bytes, and their common length."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    fit = vectors.select(F.col(ident).cast("long").alias("id"), values.alias("x")).filter("id is not null and x is not null and size(x) > 0")
    fit = fit.filter(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("x", lambda x: x != 0))
    common = fit.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = int(common["n"]) if common else 0
    rows = fit.filter(F.size("x") == dim)

    def work(batch: pa.RecordBatch):
        x = pc.list_flatten(batch.column("x")).to_numpy(zero_copy_only=False).reshape(-1, max(dim, 1))
        return {"id": batch.column("id"), "v": pa.array([r.tobytes() for r in x], pa.binary())}

    return in_arrow(rows, work, "id long, v binary"), dim


def _hashed(dim: int, signs: np.ndarray, probes: int):
    def work(batch: pa.RecordBatch):
        if not batch.num_rows:
            return None
        x = _matrix(batch.column("v"), dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        found = [buckets(x, own, probes) for own in signs]
        width = found[0].shape[1]
        table = np.repeat(np.arange(len(signs), dtype=np.int32), len(x) * width)
        row = np.tile(np.repeat(np.arange(len(x)), width), len(signs))
        take = pa.array(row)
        return {"t": table, "bucket": np.concatenate([f.ravel() for f in found]), "id": batch.column("id").take(take), "v": batch.column("v").take(take)}

    return work


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, summed in one order, so equal vectors get equal scores; powers of two keep tiny and huge rows in range."""
    q, x = (np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True, initial=0.0))[1]) for m in (q, x))
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def best_of(q_id: np.ndarray, q: np.ndarray, x_id: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, row of x, score) of the k best ids of each query, each with its best row, ties to smaller ids. Scores near the k-th are all
    computed exactly."""
    unit = lambda m: m / np.abs(m).max(axis=1, keepdims=True) / np.linalg.norm(m / np.abs(m).max(axis=1, keepdims=True), axis=1, keepdims=True)
    rough = unit(q) @ unit(x).T
    rough[q_id[:, None] == x_id[None, :]] = -np.inf
    ids, of = np.unique(x_id, return_inverse=True)
    best = top = rough  # of each id; of the id of each row
    if len(ids) < len(x_id):
        by_id = np.argsort(of, kind="stable")
        best = np.maximum.reduceat(rough[:, by_id], np.searchsorted(of[by_id], np.arange(len(ids))), axis=1)
        top = best[:, of]
    least = -np.partition(-best, k - 1, axis=1)[:, k - 1 : k] if best.shape[1] > k else -2.0
    near = rough >= np.maximum(np.maximum(least, top) - 1e-9, -2.0)
    a, b = np.nonzero(near)
    score = cosines(q[a], x[b])
    order = np.lexsort((x_id[b], -score, a))
    order = order[np.sort(np.unique(a[order] * len(ids) + of[b[order]], return_index=True)[1])]
    a, b, score = a[order], b[order], score[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = place < k
    return a[keep], b[keep], score[keep]


_FOUND = "query_id long, vec_id long, score double"


def _met(dim: int, k: int):
    """Rows sorted by (t, bucket, row block, query block, is row): a block's queries, then its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, q_id, q, x_id, x = None, [], [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if q_id and x_id:
                ids, others = np.array(q_id), np.array(x_id)
                rows = np.frombuffer(b"".join(x), np.float64).reshape(-1, dim)
                asked = np.frombuffer(b"".join(q), np.float64).reshape(-1, dim)
                for at in range(0, len(ids), 256):
                    a, b, score = best_of(ids[at : at + 256], asked[at : at + 256], others, rows, k)
                    yield pa.record_batch([pa.array(ids[at + a]), pa.array(others[b]), pa.array(score)], ["query_id", "vec_id", "score"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(7)]
            for t, bucket, i, j, is_row, ident, v in zip(*columns, strict=True):
                if (t, bucket, i, j) != key:
                    yield from close()
                    key, q_id, q, x_id, x = (t, bucket, i, j), [], [], [], []
                (x_id if is_row else q_id).append(ident)
                (x if is_row else q).append(v)
        yield from close()

    return run


def _search(rows: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """`(query_id, vec_id, score)` from hashed rows and queries `(t, bucket, id, v)`."""
    n = tasks_for(rows.sparkSession)
    sizes = rows.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("r"))
    asks = asked.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("s"))
    cut = small_side(sizes.join(asks, ["t", "bucket"]))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.join(cut, ["t", "bucket"]).withColumn("i", own("r")).withColumn("j", every("s")).withColumn("is_row", F.lit(True))
    right = asked.join(cut, ["t", "bucket"]).withColumn("j", own("s")).withColumn("i", every("r")).withColumn("is_row", F.lit(False))
    columns = ["t", "bucket", "i", "j", "is_row", "id", "v"]
    met = left.select(columns).unionAll(right.select(columns)).repartition(n, "t", "bucket", "i", "j").sortWithinPartitions(*columns[:5])
    return met.mapInArrow(_met(dim, k), _FOUND)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = K, ident: str = "vec_id", vector: str = "embedding",
    tables: int = TABLES, probes: int = PROBES, functions: int = FUNCTIONS, seed: int = SEED,
) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: up to `k` neighbours among `vectors` of each row of `queries`."""
    data, dim = usable(vectors, ident, vector)
    if not dim:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    data = stage(data, "vectors")
    few = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    index = stage(data.distinct().withColumn("rn", few).filter(F.col("rn") <= k + 1).drop("rn"), "index")
    asked, asked_dim = usable(queries, ident, vector)
    signs = rotations(dim, tables, functions, seed)
    hashed = "t int, bucket long, id long, v binary"
    asked = stage(asked.filter(F.octet_length("v") == 8 * dim), "asked")
    rows = in_arrow(index, _hashed(dim, signs, 1), hashed)
    found = stage(_search(rows, in_arrow(asked, _hashed(dim, signs, probes), hashed), dim, k), "found")
    some = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = stage(asked.join(some, "id", "left_anti"), "short")
    first = stage(in_arrow(index, _hashed(dim, signs[:1], 1), hashed), "first") if not short.isEmpty() else None
    if first is not None:
        every = sorted(r["bucket"] for r in first.select("bucket").distinct().collect())  # of one table, (2 * width) ** functions at most
        found = found.unionAll(_search(first, short.select(F.lit(0).alias("t"), F.explode(F.lit(every).cast("array<long>")).alias("bucket"), "id", "v"), dim, k))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))
