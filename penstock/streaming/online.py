"""Structured Streaming: online scoring, recent-row buffers and monitors.

Streams read files as they arrive, at most about `max_bytes` or `max_files` per micro-batch; a file is never split. Sources without zone in their timestamps are cast under a UTC session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from penstock.operators.scale import Params, apply_params, min_max
from penstock.session import scratch_path

WATERMARK = "10 minutes"
BATCH_BYTES = 256 * 1024 * 1024

# Fixed value: rows in the recent-row buffer.
BUFFER_ROWS = 4


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_bytes: int = BATCH_BYTES, max_files: int | None = None) -> DataFrame:
    """Parquet files as a stream; `path` is a folder or a glob."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)


def run_available(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over all files present now and return its output table."""
    spark = stream.sparkSession
    out = scratch_path(spark, tag)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out)
        .option("checkpointLocation", scratch_path(spark, f"{tag}-progress"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def score_online(stream: DataFrame, params: Params, score: Callable[[DataFrame], DataFrame], keep: Sequence[str]) -> DataFrame:
    """Select the stored features, scale them with the stored parameters, score. Stateless.

    `score` adds the decision columns; it may apply a fitted model or expressions.
    """
    return score(apply_params(stream.select(*keep, *params), params, min_max))


def _rolling(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the finite values and number of the non-null values among each value and the `width - 1` before it."""
    finite = np.isfinite(values)
    clean, seen = np.where(finite, values, 0.0), ~np.isnan(values)
    total, parts, n = np.zeros(len(values)), np.zeros(len(values)), np.zeros(len(values), dtype="int64")
    for back in range(min(width, len(values))):
        upto = len(values) - back
        total[back:] += clean[:upto]
        parts[back:] += finite[:upto]
        n[back:] += seen[:upto]
    return np.divide(total, parts, out=np.full(len(values), np.nan), where=parts > 0), n


def recent_rows(
    stream: DataFrame, entity: str, order: str, value: str, width: int = BUFFER_ROWS, watermark: str = WATERMARK, idle_ms: int | None = None
) -> DataFrame:
    """`(entity, order, mean, n)` of the last `width` values per entity in event-time order.

    A row waits in its entity's state until the watermark has passed it; waiting rows are then emitted in time order, ties by
    value, so the result does not depend on files or micro-batches. Rows older than the watermark are late and dropped. The state holds the
    rows of the watermark's delay and the last `width` values. It is kept for entities that fall silent, unless `idle_ms`
    tells after how long (in event time) it may go; an entity that comes back later then starts anew.
    """
    entity_type = stream.schema[entity].dataType.simpleString()

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times, values, last = (list(x) for x in state.get) if state.exists else ([], [], [])
        silent = state.hasTimedOut and not times
        for frame in frames:
            times += frame["_at"].astype("int64").tolist()
            values += frame["_value"].astype(float).tolist()
        if silent and not times:
            state.remove()
            return
        passed = state.getCurrentWatermarkMs()
        rows = sorted(zip(times, values, strict=True))
        ready = [r for r in rows if r[0] < passed * 1000]
        waiting = rows[len(ready) :]
        mean, n = _rolling(np.array([*last, *(v for _, v in ready)], dtype=float), width)
        at = np.array([t for t, _ in ready], dtype="int64")
        out = pd.DataFrame({"entity": key[0], "at": at, "mean": mean[len(last) :], "n": n[len(last) :]})
        last = [*last, *(v for _, v in ready)][-width:]
        state.update(([t for t, _ in waiting], [v for _, v in waiting], last))
        if waiting:
            state.setTimeoutTimestamp(max(passed, waiting[0][0] // 1000) + 1)
        elif idle_ms is not None:
            state.setTimeoutTimestamp(passed + idle_ms)
        if ready:
            yield out

    timed = stream.withColumn("_ts", F.col(order).cast("timestamp")).withWatermark("_ts", watermark)
    return (
        timed.select(F.col(entity).alias("entity"), F.unix_micros("_ts").alias("_at"), F.col(value).alias("_value"), "_ts")
        .groupBy("entity")
        .applyInPandasWithState(
            step,
            f"entity {entity_type}, at long, mean double, n long",
            "times array<long>, values array<double>, last array<double>",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def escalation_monitor(
    stream: DataFrame, ts: str, escalated: str, window: str = "1 hour", watermark: str = WATERMARK
) -> DataFrame:
    """`(window_start, n_rows, escalated)` per tumbling window; a window is final once the watermark passes it."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    counted = timed.groupBy(F.window("_ts", window)).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(escalated)).alias("escalated")
    )
    return counted.select(F.unix_seconds("window.start").alias("window_start"), "n_rows", "escalated")
