"""Language identification: averaged hashed subword embeddings under a linear softmax, fitted by stochastic gradient descent in numpy.

A text is lower-cased and cut into words at `[\\x20\\x09-\\x0D]`; its subwords are the character n-grams (n = 1 to `GRAMS`) of each word
framed by boundary marks, hashed into `2**BITS` buckets. Every bucket has an embedding of `DIM` numbers; a text's vector is the mean of
the embeddings of all its subwords, and a linear softmax over the learned languages gives the probabilities. Hashing is done on
whole Arrow batches with numpy (rolling polynomial hashes over the code points), never per subword in Python.

Fit: at most `FIT_DOCS` documents (and `FIT_NNZ` distinct subwords summed over them) of the learning fold (crc32 of the decimal id mod 3 is not 1) with a language and a letter, chosen
by hash, their subword counts summed on the executors; `FIT_DOCS` is the documented bound of the fit. A tenth of them (by hash) is
kept apart for calibration: a temperature is fitted there by least log loss, and the rejection threshold is the least probability at
which the kept-apart documents above it are right at least `TARGET` of the time. Plain SGD with a linearly falling step, `EPOCHS`
passes (more on a small sample, up to some `STEPS` steps). Language, source and id are never inputs of a prediction.

Results, one row per input row: `lang_pred` is a learned language, or `und` when the text is null or has no letter (score 0.0);
`score` is the calibrated probability of `lang_pred`; `rejected` is true where it is below the threshold. A null id is never held
out and never learned from. Without any learnable row every text gets `und`. Rows that repeat get equal results. Empty table: no
rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm.common import small_batches, table

BITS, DIM, GRAMS, EPOCHS, STEPS, RATE, SEED = 16, 16, 4, 5, 100_000, 0.3, 13
FIT_DOCS, FIT_NNZ, CALIBRATE, TARGET = 20_000, 4_000_000, 10, 0.99
CHARS = 1 << 21
MEAN_CHARS = 1 << 17  # characters whose subwords, as numbers, stay in the processor's cache
FOLDS, HELD_OUT = 3, 1
_P, _MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))


def subwords(texts: list[str | None], bits: int = BITS, grams: int = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """`(row, bucket)` of every subword of every text of a batch, as two arrays."""
    joined = "".join("\0" + (t or "").lower() for t in texts) + "\0"
    cps = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    cps[(cps == 0x20) | ((cps >= 9) & (cps <= 13))] = 0
    sizes = np.fromiter((len(t or "") + 1 for t in texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    rows, found = [], []
    h = np.zeros(len(cps), dtype=np.uint64)
    inner_ok = np.ones(len(cps), dtype=bool)
    for n in range(1, grams + 1):
        span = len(cps) - n + 1
        if span <= 0 or not len(owner):
            break
        with np.errstate(over="ignore"):
            h = h[:span] * _P + cps[n - 1: n - 1 + span] + np.uint64(1)
        if n >= 3:
            inner_ok = inner_ok[:span] & (cps[n - 2: n - 2 + span] != 0)
        else:
            inner_ok = inner_ok[:span]
        any_letter = np.zeros(span, dtype=bool)
        for j in range(n):
            any_letter |= cps[j: j + span] != 0
        ok = inner_ok & any_letter & (np.arange(span) < len(owner))
        at = np.nonzero(ok)[0]
        with np.errstate(over="ignore"):
            b = ((h[at] + np.uint64(n)) * _MIX) >> np.uint64(64 - bits)
        rows.append(owner[at])
        found.append(b.astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(found)


def pieces(texts: list[str | None], chars: int = CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `chars` characters (or one row), so that a batch of long texts stays bounded in memory."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if i > at and size + n > chars:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def mean_vectors(texts: list[str | None], emb: np.ndarray) -> np.ndarray:
    """Mean subword embedding of each text (zeros for a text without subwords)."""
    out = np.zeros((len(texts), emb.shape[1]))
    columns = np.ascontiguousarray(emb.T, dtype=np.float64)  # one small table a number: gathers stay in the cache
    for a, z in pieces(texts, MEAN_CHARS):
        row, bucket = subwords(texts[a:z])
        count = np.bincount(row, minlength=z - a).astype(np.float64)
        for d in range(emb.shape[1]):
            out[a:z, d] = np.bincount(row, weights=columns[d].take(bucket), minlength=z - a) / np.maximum(count, 1)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(-1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(-1, keepdims=True)


def sgd(bag: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, classes: int, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED):
    """Embeddings, weights and biases from bags `(start, buckets, weights)` (row i: start[i]:start[i+1]); one document a step, the
    step falling linearly to 0.

    At least `epochs` passes, and more on a small sample until some `STEPS` steps are made."""
    start, buckets, weights = bag
    n = len(start) - 1
    epochs = max(epochs, min(200, -(-STEPS // max(1, n))))
    rng = np.random.default_rng(seed)
    emb = (rng.uniform(-1, 1, size=(1 << BITS, DIM)) / DIM).astype(np.float64)
    w, b = np.zeros((DIM, classes)), np.zeros(classes)
    steps, t = max(1, epochs * n), 0
    for _ in range(epochs):
        for i in rng.permutation(n):
            lr = rate * (1 - t / steps)
            t += 1
            idx, wt = buckets[start[i]: start[i + 1]], weights[start[i]: start[i + 1]]
            if not len(idx):
                continue
            h = wt @ emb[idx]
            g = softmax(h @ w + b)
            g[y[i]] -= 1
            gh = w @ g
            w -= lr * np.outer(h, g)
            b -= lr * g
            emb[idx] -= lr * wt[:, None] * gh[None, :]
    return emb.astype(np.float32), w, b


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Temperature of least log loss, and the least probability above which at least `TARGET` of predictions are right."""
    if not len(y):
        return 1.0, 0.0
    temps = np.exp(np.linspace(-3, 3, 121))
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-300)).mean() for t in temps]
    temp = float(temps[int(np.argmin(loss))])
    p = softmax(z / temp)
    top, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-top, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    ok = np.nonzero(share >= TARGET)[0]
    return temp, float(top[order][ok[-1]]) if len(ok) else 1.0


def bags(sample: DataFrame) -> DataFrame:
    """`(lang, part, buckets, weights)`: summed subwords of each sampled text, on the executors; rows stop at `FIT_NNZ` buckets in all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, z in pieces(texts):
                if total >= FIT_NNZ:
                    return
                row, bucket = subwords(texts[a:z])
                uniq, counts = np.unique(row * (1 << BITS) + bucket, return_counts=True)
                r, bk = uniq >> BITS, uniq & ((1 << BITS) - 1)
                cuts = np.searchsorted(r, np.arange(z - a + 1))
                idx = [bk[cuts[i]: cuts[i + 1]].astype(np.int32) for i in range(z - a)]
                wts = [(counts[cuts[i]: cuts[i + 1]] / max(1, counts[cuts[i]: cuts[i + 1]].sum())).astype(np.float32) for i in range(z - a)]
                total += len(uniq)
                yield pa.record_batch({
                    "lang": batch.column("lang").slice(a, z - a), "part": batch.column("part").slice(a, z - a),
                    "buckets": pa.array(idx, pa.list_(pa.int32())), "weights": pa.array(wts, pa.list_(pa.float32())),
                })

    return sample.select("lang", "part", "text").mapInArrow(run, "lang string, part boolean, buckets array<int>, weights array<float>")


def fit(docs: DataFrame):
    """(languages, embeddings, weights, biases, temperature, threshold), or None without a learnable row."""
    learn = docs.filter(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & has_letter())
    n = learn.count()
    if not n:
        return None
    share = min(1.0, 1.5 * FIT_DOCS / n)
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    sample = learn.filter(key < F.lit(int(share * (1 << 30)) + 1)).limit(FIT_DOCS).withColumn(
        "part", F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id", "text"), F.lit(CALIBRATE)) == 0
    )
    small_batches(docs.sparkSession)
    got = bags(sample).toArrow()  # FIT_DOCS rows and FIT_NNZ buckets at most, as flat arrays
    if not got.num_rows:
        return None
    lang = got.column("lang").to_pylist()
    part = np.asarray(got.column("part").to_numpy(zero_copy_only=False), bool)
    sizes = np.asarray(pa.compute.list_value_length(got.column("buckets")).to_numpy(zero_copy_only=False), np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    buckets = np.asarray(pa.compute.list_flatten(got.column("buckets")).to_numpy(zero_copy_only=False), np.int64)
    weights = np.asarray(pa.compute.list_flatten(got.column("weights")).to_numpy(zero_copy_only=False), np.float64)
    langs = sorted(set(lang))
    code = {x: i for i, x in enumerate(langs)}
    y = np.array([code[x] for x in lang], np.int64)
    train = np.nonzero(~part)[0] if (~part).any() else np.arange(len(part))
    apart = np.nonzero(part)[0]

    def rows_of(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pieces = [np.arange(start[i], start[i + 1]) for i in which]
        at = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
        return np.concatenate([[0], np.cumsum(sizes[which])]), buckets[at], weights[at]

    emb, w, b = sgd(rows_of(train), y[train], len(langs))
    z = np.array([weights[start[i]: start[i + 1]] @ emb[buckets[start[i]: start[i + 1]]] @ w + b for i in apart]).reshape(len(apart), len(langs))
    temp, cut = calibrate(z, y[apart])
    return langs, emb, w, b, temp, cut


def predict(docs: DataFrame, model) -> DataFrame:
    """`(doc_id, held_out, lang_pred, score, rejected)` for every row of `docs`."""
    base = docs.select("doc_id", "text", has_letter().alias("_letter"))
    if model is None:
        return base.select("doc_id", held_out().alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # fixed size: 2**BITS x DIM numbers and the softmax, whatever the input
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, emb, w, b, temp, cut = shared.value
        for batch in batches:
            p = softmax((mean_vectors(batch.column("text").to_pylist(), emb) @ w + b) / temp)
            letter = batch.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
            best = p.argmax(1)
            score = np.where(letter, p.max(1), 0.0)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "lang_pred": pa.array([langs[i] if ok else "und" for i, ok in zip(best, letter, strict=True)], pa.string()),
                "score": pa.array(score, pa.float64()), "rejected": pa.array(letter & (score < cut)),
            })

    out = base.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def accuracy(result: DataFrame, docs: DataFrame) -> float:
    """Share of held-out rows with a language and a letter whose prediction is right."""
    truth = docs.filter(F.col("lang").isNotNull() & has_letter()).select("doc_id", "lang").distinct()
    r = result.filter("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    return float(r) if r is not None and not math.isnan(r) else 0.0
