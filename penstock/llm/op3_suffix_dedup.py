"""Suffix-array dedup: remove every byte of a `length`-byte string that also starts earlier in the corpus.

Prefix doubling, with three changes that keep it linear in the corpus:

* it starts at ranks of `length / 4` bytes instead of one (a rank is a 64-bit fingerprint, equal for equal strings);
* round 1 sorts sampled positions only. Each `length`-byte window elects the smallest fingerprint that starts in its first
  bytes (its anchor); equal windows elect equal anchors, so windows whose anchor's rank is unique are unique and drop out;
* the rank pair of round 2 is (rank of the anchor, rank of the whole stretch that its windows cover). Equal pairs are past
  the threshold. Where one anchor has different stretches, round 3 ranks the single windows of those stretches by the pair
  (first half, second half) and the doubling ends at `length`.

Spark sorts rows of (rank, rank, position); Python only walks the sorted rows. Equal stretches of one batch meet before the
shuffle, so a stretch that a third of all documents share reaches a task once per batch, and an anchor with more than
`GROUP_ROWS` different stretches is resolved by single windows in a shuffle of its own.

Results: null and empty texts have no bytes; documents shorter than `length` keep all; rows with a null id come first; rows
that share an id are ordered by a fingerprint of the text; rows that repeat id and text count as one document and get the
same result. Other columns are ignored. Equality is that of 64-bit fingerprints (128 bits for single windows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penstock.llm import textops as T
from penstock.llm.common import BATCH_ROWS, doc_id, in_arrow, keyed_documents, packed, tasks_for, unpack
from penstock.sources.staging import stage

GROUP_ROWS = 4096
_SEEN = "_doc long, _alt long, lo long, hi long"  # windows lo to hi of a document
_ANCHORS = f"rank long, stretch long, sure boolean, off int, {_SEEN}"
_LOW_BITS = np.uint64(20)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _anchors(length: int):
    gram = length // 4
    width = length - gram + 1

    def of_block(data: np.ndarray, bounds: np.ndarray):
        rolling = T.Rolling(data)
        grams = rolling.grams(gram)
        if len(grams) < width:
            return None
        bits = max(_LOW_BITS, np.uint64(int(len(grams)).bit_length()))
        keys = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        chosen = (T.sliding_min(keys, width) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        start = np.arange(len(chosen))
        row = np.searchsorted(bounds, start, "right") - 1
        whole = start + length <= bounds[row + 1]
        start, row, chosen = start[whole], row[whole], chosen[whole]
        if not len(start):
            return None
        first = np.ones(len(start), bool)
        first[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(first)
        lo, hi, anchor, row = start[at], start[np.append(at[1:], len(start)) - 1], chosen[at], row[at]
        stretch = rolling.of(lo, hi + length) ^ T.mix((anchor - lo).astype(np.uint64))
        return row, grams[anchor], stretch, anchor - lo, lo - bounds[row], hi - bounds[row]

    def work(batch: pa.RecordBatch):
        data, bounds = T.text_bytes(batch.column("text"))
        doc, alt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_doc", "_alt"))
        found = []
        for a, _, x, b in T.blocks(data, bounds):
            got = of_block(x, b)
            if got is not None:
                found.append((got[0] + a, *got[1:]))
        if not found:
            return None
        row, rank, stretch, off, lo, hi = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((lo, alt[row], doc[row], stretch))
        row, rank, stretch, off, lo, hi = (c[order] for c in (row, rank, stretch, off, lo, hi))
        sure = np.zeros(len(row), bool)  # an equal stretch starts earlier in this batch
        sure[1:] = stretch[1:] == stretch[:-1]
        spread = T.mix(lo.astype(np.uint64) ^ T.mix(_unsigned(doc[row])))
        return {
            "rank": _signed(np.where(sure, spread, rank)), "stretch": _signed(np.where(sure, np.uint64(0), stretch)), "sure": sure,
            "off": off.astype(np.int32), "_doc": doc[row], "_alt": alt[row], "lo": lo, "hi": hi,
        }

    return work


def _unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64)


def _rows(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {name: batch.column(k).to_numpy(zero_copy_only=False) for k, name in enumerate(batch.schema.names)}


_MEET = f"open boolean, rank long, off int, {_SEEN}"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (rank, stretch, document, lo): later rows of an equal pair are repeats; a rank with several stretches stays open."""
    names = [p.strip().split(" ")[0] for p in _MEET.split(",")]
    held: dict[str, np.ndarray] | None = None  # the last first row of a pair, with whether it is open
    last = None
    for batch in batches:
        rows = _rows(batch)
        n = len(rows["rank"])
        if not n:
            continue
        sure = rows["sure"]
        new = np.ones(n, bool)
        new[1:] = (rows["rank"][1:] != rows["rank"][:-1]) | (rows["stretch"][1:] != rows["stretch"][:-1])
        if last is not None:
            new[0] = (rows["rank"][0], rows["stretch"][0]) != last
        last = (rows["rank"][-1], rows["stretch"][-1])
        repeat = sure | ~new
        heads = {k: v[new & ~sure] for k, v in rows.items() if k in names} | {"open": np.zeros(int((new & ~sure).sum()), bool)}
        if held is not None:
            heads = {k: np.concatenate([held[k], heads[k]]) for k in heads}
        same = heads["rank"][1:] == heads["rank"][:-1]
        heads["open"][1:] |= same
        heads["open"][:-1] |= same
        held = {k: v[-1:] for k, v in heads.items()} if len(heads["open"]) else None
        keep = heads["open"].copy()
        keep[-1:] = False
        out = {k: np.concatenate([heads[k][keep], rows[k][repeat] if k != "open" else np.zeros(int(repeat.sum()), bool)]) for k in names}
        if len(out["rank"]):
            yield pa.record_batch([pa.array(out[k]) for k in names], names)
    if held is not None and held["open"][0]:
        yield pa.record_batch([pa.array(held[k]) for k in names], names)


def _cut(length: int):
    """Bytes of each open stretch of a document."""

    def work(batch: pa.RecordBatch):
        rank, lo, hi, doc, alt, piece = [], [], [], [], [], []
        for d, a, z, found in zip(*(batch.column(c).to_pylist() for c in ("_doc", "_alt", "_z", "found")), strict=True):
            text = unpack(z)
            for f in found:
                rank.append(f["rank"])
                lo.append(f["lo"])
                hi.append(f["hi"])
                piece.append(text[f["lo"] : f["hi"] + length])
            doc += [d] * len(found)
            alt += [a] * len(found)
        return {"rank": pa.array(rank, pa.int64()), "_doc": pa.array(doc, pa.int64()), "_alt": pa.array(alt, pa.int64()),
                "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64()), "piece": pa.array(piece, pa.binary())}

    return work


_WINDOWS = f"half long, rest long, {_SEEN}"  # half is null for repeats that are known


def _windows(length: int):
    """Rows sorted by (rank, document, lo), each with a stretch of bytes: windows that an earlier row of the rank has are repeats."""
    names = [p.strip().split(" ")[0] for p in _WINDOWS.split(",")]

    def resolve(rows: dict[str, np.ndarray], pieces: pa.Array, settled: bool) -> pa.RecordBatch | None:
        data, bounds = T.text_bytes(pieces)
        count = np.diff(bounds) - length + 1
        owner = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = bounds[owner] + inside
        rolling = T.Rolling(data)
        half, rest = rolling.of(start, start + length // 2), rolling.of(start + length // 2, start + length)
        at = rows["lo"][owner] + inside
        whole = T.mix(half) ^ rest
        _, first = np.unique(whole, return_index=True)
        again = np.ones(len(whole), bool)
        again[first] = False
        run = np.flatnonzero(again)
        cut = np.ones(len(run), bool)
        cut[1:] = (run[1:] != run[:-1] + 1) | (owner[run[1:]] != owner[run[:-1]])
        begin = run[cut]
        end = run[np.append(np.flatnonzero(cut)[1:], len(run)) - 1] if len(run) else run
        out = {"half": [None] * len(begin), "rest": [None] * len(begin), "_doc": rows["_doc"][owner[begin]], "_alt": rows["_alt"][owner[begin]], "lo": at[begin], "hi": at[end]}
        if not settled:
            first = np.sort(first)
            fresh = {"half": _signed(half[first]).tolist(), "rest": _signed(rest[first]).tolist(), "_doc": rows["_doc"][owner[first]], "_alt": rows["_alt"][owner[first]], "lo": at[first], "hi": at[first]}
            out = {k: np.concatenate([out[k], fresh[k]]) if k[0] == "_" or k in ("lo", "hi") else [*out[k], *fresh[k]] for k in names}
        return pa.record_batch([pa.array(out[k], pa.int64()) for k in names], names) if len(out["lo"]) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        open_rank = None  # a rank with too many rows, whose windows are sent on
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                part = pa.Table.from_batches([batch.slice(k, BATCH_ROWS)])
                part = pa.concat_tables([rest, part]).combine_chunks() if rest is not None else part
                rank = part["rank"].to_numpy()
                tail = int(np.searchsorted(rank, rank[-1])) if np.all(rank[1:] >= rank[:-1]) else 0
                yield from pieces_of(part.slice(0, tail), open_rank)
                rest = part.slice(tail)
                if rest.num_rows > GROUP_ROWS:
                    open_rank = rank[-1]
                    yield from pieces_of(rest, open_rank)
                    rest = None
        if rest is not None:
            yield from pieces_of(rest, open_rank)

    def pieces_of(part: pa.Table, open_rank) -> Iterator[pa.RecordBatch]:
        if not part.num_rows:
            return
        large = part["rank"].to_numpy() == open_rank if open_rank is not None else np.zeros(part.num_rows, bool)
        for mask, settled in ((~large, True), (large, False)):
            if mask.any():
                chosen = part.filter(pa.array(mask))
                rows = {k: chosen[k].to_numpy() for k in ("_doc", "_alt", "lo", "hi")}
                got = resolve(rows, chosen["piece"], settled)
                if got is not None:
                    yield got

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by (half, rest, document, lo): all but the first of each pair."""
    last = None
    for batch in batches:
        rows = _rows(batch)
        if not len(rows["half"]):
            continue
        again = np.zeros(len(rows["half"]), bool)
        again[1:] = (rows["half"][1:] == rows["half"][:-1]) & (rows["rest"][1:] == rows["rest"][:-1])
        again[0] = (rows["half"][0], rows["rest"][0]) == last
        last = (rows["half"][-1], rows["rest"][-1])
        names = ["_doc", "_alt", "lo", "hi"]
        yield pa.record_batch([pa.array(rows[k][again]) for k in names], names)


def repeated_windows(texts: DataFrame, length: int) -> DataFrame:
    """`(_doc, _alt, lo, hi)`: windows `lo` to `hi` of a document also start earlier. `texts` comes from `keyed_documents`."""
    spark = texts.sparkSession
    n = tasks_for(spark)
    anchors = in_arrow(texts.select("_doc", "_alt", "text"), _anchors(length), _ANCHORS)
    sorted_pairs = anchors.repartition(n, "rank").sortWithinPartitions("rank", "stretch", "_doc", "_alt", "lo")
    met = stage(sorted_pairs.mapInArrow(_meet, _MEET), "ranks")
    open_of = met.filter("open").groupBy("_doc", "_alt").agg(F.collect_list(F.struct("rank", "lo", "hi")).alias("found"))
    pieces = in_arrow(packed(texts).join(open_of, ["_doc", "_alt"]), _cut(length), f"rank long, {_SEEN}, piece binary")
    by_rank = pieces.repartition(n, "rank").sortWithinPartitions("rank", "_doc", "_alt", "lo")
    single = stage(by_rank.mapInArrow(_windows(length), _WINDOWS), "windows")
    seen = ["_doc", "_alt", "lo", "hi"]
    by_pair = single.filter("half is not null").repartition(n, "half", "rest").sortWithinPartitions("half", "rest", "_doc", "_alt", "lo")
    return (
        met.filter("not open").select(seen)
        .unionAll(single.filter("half is null").select(seen))
        .unionAll(by_pair.select("half", "rest", *seen).mapInArrow(_later, _SEEN))
    )


def _keep(length: int):
    def work(batch: pa.RecordBatch):
        kept, spans, sizes = [], [], []
        for z, found in zip(batch.column("_z").to_pylist(), batch.column("found").to_pylist(), strict=True):
            text = unpack(z)
            sizes.append(len(text))
            if not found:
                kept.append(text)
                spans.append([])
                continue
            lo = np.array([f["lo"] for f in found])
            hi = np.array([f["hi"] for f in found]) + length
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            fresh = np.ones(len(lo), bool)
            fresh[1:] = lo[1:] > hi[:-1]
            begin, end = lo[fresh], hi[np.append(np.flatnonzero(fresh)[1:], len(hi)) - 1]
            edges = np.concatenate([[0], np.column_stack([begin, end]).ravel(), [len(text)]])
            kept.append(b"".join(text[a:b] for a, b in edges.reshape(-1, 2)))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(begin, end, strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return {"_doc": batch.column("_doc"), "_alt": batch.column("_alt"), "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())}

    return work


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """`(doc_id, n_bytes, spans, kept)`: maximal removed byte spans, end exclusive, and the bytes left, for each row of `docs`."""
    if length < 8 or length % 4:
        raise ValueError("length must be a multiple of 4, 8 at least")
    texts = keyed_documents(docs)
    found = repeated_windows(texts, length).groupBy("_doc", "_alt").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    whole = packed(texts).join(found, ["_doc", "_alt"], "left")
    schema = "_doc long, _alt long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    return in_arrow(whole, _keep(length), schema).select(doc_id(), "n_bytes", "spans", "kept")


def digest(spark, sf_dir: str) -> DataFrame:
    from penstock.llm.common import table

    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
