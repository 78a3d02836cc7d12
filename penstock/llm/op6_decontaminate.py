"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

1. Words are compared in ASCII lower case without punctuation around them. The benchmark's `seed`-word grams set bits in a table
   of fixed size (2 MB), which every task gets. A pass over the documents keeps the words that lie in a gram whose bit is set; a
   match of `seed` words or more consists of such words, so nothing else can be in a tile.
2. The grams of those words are joined with the benchmark's grams: pairs of a document and an item that share a seed. Full
   or wrong bits only bring words that find no partner here.
3. Each pair is tiled: for falling lengths, hashes of all unmarked runs of that length in the document are looked up for the
   item's unmarked runs, matches are extended, and the longest are marked first and never overlap. A pair is a hit if the tiles
   cover at least `coverage` of the item's words, in whatever order the document has them.

Results: one row per hit. A null or empty text has no words and no hits; an item without words is never hit; items with fewer than `seed`
words are matched as a whole; null ids are ids of their own; rows that repeat id and text give one row per item; items that share an id are
items of their own (numbered by `item_alt`, a fingerprint of the text). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm import textops as T
from penstock.llm.common import BATCH_ROWS, doc_id, in_arrow, keyed_documents, table, tasks_for, unpack
from penstock.sources.staging import stage

SEED, COVERAGE = 4, 0.5
_BITS, _CHUNK_BITS = 24, 18
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def bare_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of each word that is left without the punctuation around it."""
    row, start, end = T.words(data, bounds)
    plain = np.append(~_EDGE[data], True)
    nearest = np.minimum.accumulate(np.where(plain, np.arange(len(plain)), len(plain))[::-1])[::-1]  # next byte that is no edge
    before = np.maximum.accumulate(np.where(plain, np.arange(len(plain)), -1))
    start, end = nearest[start], before[end - 1] + 1
    whole = start < end
    return row[whole], T.Rolling(T.LOWER[data]).of(start[whole], end[whole])



def _item_rows(seed: int):
    def work(batch: pa.RecordBatch):
        data, bounds = T.text_bytes(batch.column("text"))
        row, word = bare_words(data, bounds)
        at, gram = T.gram_hashes(row, word, seed)
        n = batch.num_rows
        out: dict[str, list] = {"words": [[] for _ in range(n)], "grams": [[] for _ in range(n)]}
        for k, w in zip(row.tolist(), word.view(np.int64).tolist(), strict=True):
            out["words"][k].append(w)
        for k, g in zip(row[at].tolist(), gram.view(np.int64).tolist(), strict=True):
            out["grams"][k].append(g)
        for k in range(n):
            if not out["grams"][k]:  # a short item: its words are its seeds
                out["grams"][k] = out["words"][k]
        kind = pa.list_(pa.int64())
        return {"item_id": batch.column("item_id"), "item_alt": batch.column("item_alt"), "words": pa.array(out["words"], kind), "grams": pa.array(out["grams"], kind)}

    return work


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << _BITS, bool)
    for batch in batches:
        gram = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        bits[(gram >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for k, part in enumerate(bits.reshape(-1, 1 << _CHUNK_BITS)):
        if part.any():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([squeeze(np.packbits(part).tobytes())], pa.binary())], ["chunk", "bits"])


def _joined_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(unpack(z), np.uint8)
            found[chunk] = found[chunk] | part if chunk in found else part
    if found:
        yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["chunk", "bits"])


def seed_bits(grams: DataFrame) -> np.ndarray:
    """Whether a gram's first bits occur in the benchmark; 2 ** 24 flags, whatever the benchmark's size."""
    chunks = grams.mapInArrow(_bits_of, "chunk int, bits binary").repartition(tasks_for(grams.sparkSession), "chunk")
    bits = np.zeros((1 << (_BITS - _CHUNK_BITS), 1 << (_CHUNK_BITS - 3)), np.uint8)
    for chunk, part in chunks.mapInArrow(_joined_bits, "chunk int, bits binary").collect():
        bits[chunk] = np.frombuffer(bytes(part), np.uint8)
    return bits.ravel()


_KIND = pa.list_(pa.int64())


def _parts(seed: int, shared):
    """For each document with a set bit: places and fingerprints of the words in such grams, and the grams."""

    def set_in(bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
        at = (gram >> np.uint64(64 - _BITS)).astype(np.int64)
        return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

    def work(batch: pa.RecordBatch):
        bits = shared.value
        data, bounds = T.text_bytes(batch.column("text"))
        keep, places, words, grams = [], [], [], []
        for first, _, x, b in T.blocks(data, bounds):
            row, word = bare_words(x, b)
            at, gram = T.gram_hashes(row, word, seed)
            hit = set_in(bits, gram)
            alone = set_in(bits, word)  # seeds of items shorter than a gram
            covered = alone.copy()
            for k in range(seed):
                covered[at[hit] + k] = True
            begin = np.searchsorted(row, np.arange(len(b) - 1))
            for k in np.unique(row[covered]).tolist():
                lo, hi = begin[k], begin[k + 1] if k + 1 < len(begin) else len(row)
                mine = np.flatnonzero(covered[lo:hi])
                own = slice(*np.searchsorted(at, [lo, hi]))
                keep.append(first + k)
                places.append(mine)
                words.append(word[lo:hi][mine].view(np.int64))
                grams.append(np.unique(np.concatenate([gram[own][hit[own]], word[lo:hi][alone[lo:hi]]])).view(np.int64))
        if not keep:
            return None
        take = pa.array(keep)
        return {
            "_doc": batch.column("_doc").take(take), "_alt": batch.column("_alt").take(take),
            "places": pa.array([p.tolist() for p in places], _KIND), "words": pa.array([w.tolist() for w in words], _KIND), "grams": pa.array([g.tolist() for g in grams], _KIND),
        }

    return work


_PRIME, _STEP = (1 << 61) - 1, 0x1F3D5B79A2C4E681 % ((1 << 61) - 1)


def _rolled(tokens: list[int], free: list[bool], joins: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of each run of `size` free, adjacent tokens."""
    top = pow(_STEP, size, _PRIME)
    h, length = 0, 0
    for i, token in enumerate(tokens):
        if not free[i]:
            h, length = 0, 0
            continue
        if length and not joins[i]:
            h, length = 0, 0
        h = (h * _STEP + token) % _PRIME
        length += 1
        if length > size:
            h = (h - tokens[i - size] * top) % _PRIME
        if length >= size:
            yield i - size + 1, h


def tiles(text: list[int], joins: list[bool], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of `item` by `text`: (place in text, place in item, length), longest first. `joins[i]`: i follows i - 1 in the document.

    Each round finds the greatest length at which unmarked runs still match, by bisection, and marks all matches of that length.
    """
    free_text, free_item, found = [True] * len(text), [True] * len(item), []
    inside = [False] + [True] * (len(item) - 1)

    def runs(size: int) -> dict[int, list[int]]:
        table: dict[int, list[int]] = {}
        for i, h in _rolled(text, free_text, joins, size):
            table.setdefault(h, []).append(i)
        return table

    def matches(size: int) -> bool:
        table = runs(size)
        return any(h in table and any(text[i : i + size] == item[j : j + size] for i in table[h]) for j, h in _rolled(item, free_item, inside, size))

    least = min(least, len(item))
    most = min(len(item), len(text))
    while least and most >= least and matches(least):
        low, high = least, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if matches(middle) else (low, middle - 1)
        table = runs(low)
        for j, h in list(_rolled(item, free_item, inside, low)):
            if all(free_item[j : j + low]):
                for i in table.get(h, ()):
                    if all(free_text[i : i + low]) and text[i : i + low] == item[j : j + low]:
                        free_text[i : i + low] = free_item[j : j + low] = [False] * low
                        found.append((i, j, low))
                        break
        most = low - 1
    return found


def _tiled(seed: int):
    def work(batch: pa.RecordBatch):
        columns = {c: batch.column(c).to_pylist() for c in ("places", "text", "item")}
        covered, count = [], []
        for places, text, item in zip(columns["places"], columns["text"], columns["item"], strict=True):
            wanted = set(item)
            kept = [k for k, w in enumerate(text) if w in wanted]
            at = [places[k] for k in kept]
            joins = [False] + [b == a + 1 for a, b in zip(at, at[1:], strict=False)]
            got = tiles([text[k] & _PRIME for k in kept], joins[: len(kept)], [w & _PRIME for w in item], seed)
            covered.append(sum(t[2] for t in got))
            count.append(len(got))
        keys = {c: batch.column(c) for c in ("_doc", "_alt", "item_id", "item_alt", "n_words")}
        return keys | {"covered": np.array(covered, np.int64), "n_tiles": np.array(count, np.int64)}

    return work


def leaks(texts: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """`(_doc, _alt, item_id, item_alt, n_words, covered, n_tiles)`: items whose words a document's tiles cover to `coverage`."""
    named = benchmark.select("item_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("item_alt"), "text").dropDuplicates(["item_id", "item_alt"])
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = stage(in_arrow(named, _item_rows(seed), f"item_id {kind}, item_alt long, words array<long>, grams array<long>"), "items")
    item_grams = items.select("item_id", "item_alt", F.explode(F.array_distinct("grams")).alias("gram"))
    shared = texts.sparkSession.sparkContext.broadcast(seed_bits(item_grams.select("gram")))
    keys = "_doc long, _alt long"
    parts = stage(in_arrow(texts.select("_doc", "_alt", "text"), _parts(seed, shared), f"{keys}, places array<long>, words array<long>, grams array<long>").dropDuplicates(["_doc", "_alt"]), "parts")
    met = parts.select("_doc", "_alt", F.explode("grams").alias("gram")).join(item_grams, "gram").select("_doc", "_alt", "item_id", "item_alt").distinct()
    texts_of = met.join(parts.select("_doc", "_alt", "places", F.col("words").alias("text")), ["_doc", "_alt"])
    known = items.select(F.col("item_id").alias("i"), F.col("item_alt").alias("a"), F.col("words").alias("item"), F.size("words").cast("long").alias("n_words"))
    pairs = texts_of.join(known, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_alt") == F.col("a"))).drop("i", "a")
    done = in_arrow(pairs, _tiled(seed), f"{keys}, item_id {kind}, item_alt long, n_words long, covered long, n_tiles long")
    return done.filter(F.col("covered") >= F.lit(float(coverage)) * F.col("n_words"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """`(doc_id, item_id, n_words, covered, n_tiles)`: hits only."""
    return leaks(keyed_documents(docs), benchmark, seed, coverage).select(doc_id(), "item_id", "n_words", "covered", "n_tiles")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """Rows of `docs` without any hit; all columns stay."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    hits = stage(leaks(keyed_documents(docs), benchmark, seed, coverage).select("_doc", "_alt").distinct(), "leaks")
    return keyed_documents(docs, row).join(hits, ["_doc", "_alt"], "left_anti").select("row.*")


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.withColumn("coverage", F.col("covered") / F.col("n_words"))
