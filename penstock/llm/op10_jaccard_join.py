"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A document's set holds its distinct `size`-word shingles. Two sets with Jaccard similarity of at least t share at least l
shingles of their l-prefixes: the first n - ceil(t * n) + l of n shingles in one total order (rare before frequent). Each
document picks its own l: reading lists costs the sum of the frequencies in the prefix, verification costs that sum over l, and
the cheapest l is taken. A pair needs min(l, l') shared prefix shingles.

1. One pass takes the size and fingerprint of every set and adds all shingles to a frequency sketch of fixed size (16 MB).
   Equal sets become one node, represented by the smallest document.
2. A second pass emits each node's prefix; rows meet by shingle. Short lists (`LIST` nodes) give pairs. Longer lists only tell their
   nodes how many long lists they are in, h. A pair shares at most min(h, h') shingles in long lists, so it needs
   min(l, l') - min(h, h') of them in short lists, and is a candidate if it has them. Only if that number is not positive can a link hide in
   long lists alone. As every l is at least `FLOOR` (or what the set's size allows), only nodes with so large an h can have such a
   link; long lists connect those nodes to dense groups.
3. Candidate pairs are verified on the whole texts. Dense groups are cut into blocks of about `BLOCK` nodes or `BLOCK_SHINGLES` shingles, and each pair of
   blocks is verified inside a task, which returns a spanning forest of its links, never the pairs.
4. Components of all links give the class of each document.

A sketch that is inexact or full changes the order and the costs, never the result.

Results: null ids sort first and come back as null; null or empty texts and texts without words have an empty set and are
linked with nothing; rows that repeat id and text, or share an id, are rows of their own. Other columns are ignored. Sets are
compared by 64-bit fingerprints of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penstock.llm import textops as T
from penstock.llm.common import BATCH_ROWS, NO_ID, doc_id, in_arrow, keyed_documents, packed, small_batches, table, tasks_for, unpack
from penstock.llm.components import components
from penstock.sources.staging import stage

LIST = 24
BLOCK, BLOCK_SHINGLES = 256, 400_000
FLOOR, MOST_MATCHES = 24, 64
VERIFY_COST = 16.0
_CELL_BITS, _CHUNK_BITS = 22, 12
_SEED = np.uint64(0xD6E8FEB86659FD93)


def _set_print(owner: np.ndarray, gram: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, fingerprint) of each set: a sum of mixed elements does not depend on their order."""
    n = np.bincount(owner, minlength=rows)
    total = np.zeros(rows + 1, np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(gram ^ _SEED), dtype=np.uint64)])
    ends = np.concatenate([[0], np.cumsum(n)])
    total = sums[ends[1:]] - sums[ends[:-1]]
    return n, T.mix(total + n.astype(np.uint64)).view(np.int64)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << _CELL_BITS, np.uint32)
        names = ["_doc", "_alt", "n", "node", "chunk", "counts"]
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                data, bounds = T.text_bytes(part.column("text"))
                n, node = [], []
                for _, _, x, b in T.blocks(data, bounds):
                    owner, gram = T.shingle_sets(x, b, size)
                    np.add.at(cells, (gram >> np.uint64(64 - _CELL_BITS)).astype(np.int64), np.uint32(1))
                    got = _set_print(owner, gram, len(b) - 1)
                    n.append(got[0])
                    node.append(got[1])
                rows = part.num_rows
                yield pa.record_batch([part.column("_doc"), part.column("_alt"), pa.array(np.concatenate(n)), pa.array(np.concatenate(node)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        grid = cells.reshape(-1, 1 << _CHUNK_BITS)
        used = np.flatnonzero(grid.any(axis=1))
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for at in range(0, len(used), 64):
            part = used[at : at + 64]
            none = pa.nulls(len(part), pa.int64())
            yield pa.record_batch([none, none, none, none, pa.array(part.astype(np.int32)), pa.array([squeeze(grid[k].tobytes()) for k in part], pa.binary())], names)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(unpack(z), np.uint32).astype(np.uint64)
            sums[chunk] = sums[chunk] + counts if chunk in sums else counts
    if sums:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([squeeze(np.minimum(s, 0xFFFFFFFF).astype(np.uint32).tobytes()) for s in sums.values()], pa.binary())], ["chunk", "counts"])


def _sketch(rows: DataFrame) -> np.ndarray:
    """Counts of all shingles by cell. Its size is fixed: 2 ** 22 cells of 4 bytes."""
    chunks = rows.filter("chunk is not null").select("chunk", "counts")
    cells = np.zeros((1 << (_CELL_BITS - _CHUNK_BITS), 1 << _CHUNK_BITS), np.uint32)
    for chunk, z in chunks.repartition(tasks_for(rows.sparkSession), "chunk").mapInArrow(_add_up, "chunk int, counts binary").collect():
        cells[chunk] = np.frombuffer(unpack(bytes(z)), np.uint32)
    return cells.ravel()


def _excess(cells: np.ndarray) -> np.ndarray:
    """Estimated frequency of a shingle beyond its own, by cell: what a cell has above the noise of its neighbours."""
    typical = float(np.median(cells)) if len(cells) else 0.0
    above = cells.astype(np.float32) - np.float32(typical)
    above[above <= 6.0 * np.sqrt(typical) + 2.0] = 0.0
    return above


def need_of(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(t * n): shingles that a set of size n shares with any set it is linked to."""
    return (percent * n + 99) // 100


def floor_of(n: np.ndarray, percent: int) -> np.ndarray:
    """The least number of matches that a document with n shingles may choose."""
    return np.maximum(1, np.minimum(FLOOR, need_of(n, percent)))


def prefix_of(gram: np.ndarray, excess: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """A set's shingles in its adaptive prefix, and how many a partner must share."""
    n = len(gram)
    base = n - int(need_of(np.int64(n), percent))
    level = np.where(excess > 0, 1 + np.log2(np.maximum(excess, 1)).astype(np.int64), 0)
    order = np.lexsort((gram, level))
    least = int(floor_of(np.int64(n), percent))
    most = max(least, min(MOST_MATCHES, n - base))
    matches = np.arange(least, most + 1)
    cost = np.cumsum(excess[order[: base + most]])[base + least - 1 :]
    best = int(matches[np.argmin(cost + VERIFY_COST * cost / matches)]) if cost[0] > 0 else least
    return gram[order[: base + best]], best


def _prefixes(size: int, percent: int, shared):
    def work(batch: pa.RecordBatch):
        excess = shared.value
        data, bounds = T.text_bytes(batch.column("text"))
        token, node, n, match = [], [], [], []
        seen: set[int] = set()
        for _, _, x, b in T.blocks(data, bounds):
            owner, gram = T.shingle_sets(x, b, size)
            sizes, prints = _set_print(owner, gram, len(b) - 1)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            over = excess[(gram >> np.uint64(64 - _CELL_BITS)).astype(np.int64)]
            for k in np.flatnonzero(sizes):
                if int(prints[k]) in seen:
                    continue
                seen.add(int(prints[k]))
                chosen, least = prefix_of(gram[ends[k] : ends[k + 1]], over[ends[k] : ends[k + 1]], percent)
                token.append(chosen)
                node.append(np.full(len(chosen), prints[k]))
                n.append(np.full(len(chosen), sizes[k]))
                match.append(np.full(len(chosen), least))
        if not token:
            return None
        return {"token": np.concatenate(token).view(np.int64), "node": np.concatenate(node), "n": np.concatenate(n).astype(np.int32), "match": np.concatenate(match).astype(np.int32)}

    return work


_LISTS = "dense boolean, a long, b long, least int"


def _lists(percent: int):
    """Rows sorted by (token, node): pairs of short lists; of long ones (token, node, matches that could hide in long lists)."""
    names = ["dense", "a", "b", "least"]

    def pairs(token: np.ndarray, node: np.ndarray, n: np.ndarray, match: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All lists are whole here."""
        if len(token) < 2:
            return
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, n, match = token[keep], node[keep], n[keep], match[keep]
        head = np.ones(len(token), bool)
        head[1:] = token[1:] != token[:-1]
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(token)))
        of = np.repeat(size, size)
        spokes = np.flatnonzero(of > LIST)
        left, right = [], []
        for gap in range(1, LIST):
            k = np.flatnonzero((of[gap:] <= LIST) & (token[gap:] == token[:-gap])) if len(token) > gap else []
            if not len(k):
                break
            left.append(k)
            right.append(k + gap)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        fits = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        a, b = a[fits], b[fits]
        yield long(token[spokes], node[spokes], n[spokes])
        for k in range(0, len(a), 1 << 17):
            x, y = a[k : k + (1 << 17)], b[k : k + (1 << 17)]
            yield pa.record_batch([pa.array(np.zeros(len(x), bool)), pa.array(node[x]), pa.array(node[y]), pa.array(np.minimum(match[x], match[y]))], names)

    def long(token: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        hidden = floor_of(need_of(n.astype(np.int64), percent), percent)  # of the smallest set that n can be linked to
        return pa.record_batch([pa.array(np.ones(len(token), bool)), pa.array(token), pa.array(node), pa.array(hidden.astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(4)]
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            tail = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from pairs(*(r[:tail] for r in rows))
            held = [r[tail:] for r in rows]
            if len(held[1]) > 8 * LIST:
                some = np.unique(held[1], return_index=True)[1]
                held = [h[some] for h in held]
                if len(some) > 4 * LIST:  # a long list goes on with a few of its nodes: enough to know that it is long
                    yield long(*(h[LIST + 1 :] for h in held[:3]))
                    held = [h[: LIST + 1] for h in held]
        if held is not None:
            yield from pairs(*held)

    return run


def linked(common: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (n + m - common)


def _verify(size: int, percent: int):
    """Pairs with both texts: those that are linked."""

    def work(batch: pa.RecordBatch):
        left, right = ([unpack(z) for z in batch.column(c).to_pylist()] for c in ("_z", "_y"))
        if not left:
            return None
        keep = []
        step = max(1, len(left) * T.BLOCK_BYTES // (1 + sum(map(len, left)) + sum(map(len, right))))
        for at in range(0, len(left), step):
            sides = []
            for texts in (left[at : at + step], right[at : at + step]):
                data, bounds = T.text_bytes(pa.array(texts, pa.large_binary()))
                sides.append(T.shingle_sets(data, bounds, size))
            rows = min(step, len(left) - at)
            owner, gram = (np.concatenate([s[k] for s in sides]) for k in (0, 1))
            order = np.lexsort((gram, owner))
            owner, gram = owner[order], gram[order]
            same = (owner[1:] == owner[:-1]) & (gram[1:] == gram[:-1])
            common = np.bincount(owner[1:][same], minlength=rows)
            n, m = (np.bincount(s[0], minlength=rows) for s in sides)
            keep.append(linked(common, n, m, percent))
        mask = pa.array(np.concatenate(keep))
        return {c: batch.column(c).filter(mask) for c in ("a", "b")}

    return work


def forest(owner: np.ndarray, gram: np.ndarray, rows: int, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among the sets of one task: counts of shared elements by matrix products over slices of them."""
    n = np.bincount(owner, minlength=rows)
    _, column, uses = np.unique(gram, return_inverse=True, return_counts=True)
    shared = uses[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((rows, rows), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((rows, width), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    is_link = linked(common.astype(np.int64), n[:, None], n[None, :], percent)
    parent = list(range(rows))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    left = set(range(rows))
    while left:  # breadth first over rows of the link matrix
        start = left.pop()
        queue = [start]
        while queue:
            x = queue.pop()
            for y in np.flatnonzero(is_link[x]).tolist():
                if y in left:
                    left.discard(y)
                    edges.append((x, y))
                    queue.append(y)
    return edges


def _blocks(size: int, percent: int):
    """Rows sorted by (group, i, j), each with a node's text: links inside each pair of blocks, as a forest."""

    def close(rows: list[tuple[int, bytes]]) -> pa.RecordBatch | None:
        grams, owner = [], []
        for k, (_, z) in enumerate(rows):
            data, bounds = T.text_bytes(pa.array([unpack(z)], pa.large_binary()))
            g = T.shingle_sets(data, bounds, size)[1]
            grams.append(g)
            owner.append(np.full(len(g), k))
        edges = forest(np.concatenate(owner), np.concatenate(grams), len(rows), percent)
        if not edges:
            return None
        return pa.record_batch([pa.array([rows[x][0] for x, _ in edges], pa.int64()), pa.array([rows[y][0] for _, y in edges], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for group, i, j, node, z in zip(*columns, strict=True):
                if (group, i, j) != key:
                    if len(rows) > 1 and (got := close(rows)) is not None:
                        yield got
                    key, rows = (group, i, j), []
                rows.append((node, z))
        if len(rows) > 1 and (got := close(rows)) is not None:
            yield got

    return run


def links(texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """`(_doc, _alt, n, node)` for each row of `texts`, and a spanning set of links `(a, b)` between nodes."""
    spark = texts.sparkSession
    n_tasks = tasks_for(spark)
    small_batches(spark)
    found = stage(texts.select("_doc", "_alt", "text").mapInArrow(_sets(size), "_doc long, _alt long, n long, node long, chunk int, counts binary"), "sets")
    shared = spark.sparkContext.broadcast(_excess(_sketch(found)))
    rows = found.filter("chunk is null").select("_doc", "_alt", "n", "node")
    prefixes = in_arrow(texts.select("text"), _prefixes(size, percent, shared), "token long, node long, n int, match int")
    met = prefixes.repartition(n_tasks, "token").sortWithinPartitions("token", "node").mapInArrow(_lists(percent), _LISTS)
    met = stage(met, "lists")

    in_long = met.filter("dense").select(F.col("a").alias("token"), F.col("b").alias("node"), F.col("least").alias("hidden")).distinct()
    heavy = stage(in_long.groupBy("node").agg(F.count(F.lit(1)).alias("h"), F.min("hidden").alias("hidden")), "heavy")
    left = in_long.join(heavy.filter("h >= hidden").select("node"), "node", "left_semi").select("token", "node")
    hubs = left.groupBy("token").agg(F.min("node").alias("hub"))
    groups = components(left.join(hubs, "token").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    in_group = stage(groups.unionAll(groups.select(F.col("root").alias("node"), "root").distinct()), "groups")
    counted = met.filter("not dense").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.min("least").alias("least"))
    for side in ("a", "b"):
        known = heavy.join(in_group, "node", "left").select(F.col("node").alias(side), F.col("h").alias(f"h_{side}"), F.col("root").alias(f"g_{side}"))
        counted = counted.join(known, side, "left")
    hot = F.least(F.coalesce("h_a", F.lit(0)), F.coalesce("h_b", F.lit(0)))
    apart = F.col("g_a").isNull() | F.col("g_b").isNull() | (F.col("g_a") != F.col("g_b"))
    pairs = stage(counted.filter((F.col("shared") >= F.col("least") - hot) & apart).select("a", "b"), "pairs")

    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).unionAll(in_group.select("node")).distinct()
    chosen = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("_doc", "_alt", "n")).alias("k")).select("node", "k.*")
    z = stage(packed(texts.select("_doc", "_alt", "text")).join(chosen, ["_doc", "_alt"]).select("node", "n", "_z").dropDuplicates(["node"]), "texts")
    both = pairs.join(z.select(F.col("node").alias("a"), "_z"), "a").join(z.select(F.col("node").alias("b"), F.col("_z").alias("_y")), "b")
    by_pair = in_arrow(both.select("a", "b", "_z", "_y"), _verify(size, percent), "a long, b long")

    known = in_group.join(z.select("node", "n"), "node")
    sizes = known.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("k"))
    placed = known.join(sizes, "root").withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    spread = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).filter("k = 1 or i <> o").select("node", F.col("root").alias("grp"), F.least("i", "o").alias("i"), F.greatest("i", "o").alias("j"))
    dense = spread.join(z, "node").select("grp", "i", "j", "node", "_z").repartition(n_tasks, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    by_block = dense.mapInArrow(_blocks(size, percent), "a long, b long")
    return rows, stage(by_pair.unionAll(by_block), "links")


def jaccard_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`(_doc, _alt, doc_id, n_shingles, component_id)` for each row: the smallest id that is reachable by links of `percent` similarity."""
    texts = keyed_documents(docs)
    rows, edges = links(texts, size, percent)
    roots = components(edges)
    first = rows.filter("n > 0").groupBy("node").agg(F.min("_doc").alias("first"))
    first = stage(first.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first"), "classes")
    least = first.groupBy("root").agg(F.min("first").alias("least"))
    labels = first.join(least, "root").select("node", "least")
    joined = rows.join(labels, "node", "left")
    own = F.when((F.col("n") == 0) | F.col("least").isNull(), F.col("_doc")).otherwise(F.col("least"))
    return joined.select("_doc", "_alt", doc_id(), F.col("n").alias("n_shingles"), F.when(own != F.lit(NO_ID), own).alias("component_id"))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of `docs`, one of each group: of linked rows, and of rows that repeat id and text, the first. Rows without words stay.

    All columns stay, whatever their names.
    """
    texts = keyed_documents(docs)
    rows, edges = links(texts, size, percent)
    roots = components(edges)
    firsts = rows.filter("n > 0").groupBy("node").agg(F.min(F.struct("_doc", "_alt")).alias("k"))
    classes = firsts.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("k").alias("k"))
    kept = classes.select("k.*").unionAll(rows.filter("n = 0").select("_doc", "_alt").distinct())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    whole = keyed_documents(docs, row).join(stage(kept, "kept"), ["_doc", "_alt"])
    first = F.row_number().over(Window.partitionBy("_doc", "_alt").orderBy(F.xxhash64("row")))
    return whole.withColumn("_k", first).filter((F.col("_k") == 1) | ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select("row.*")
