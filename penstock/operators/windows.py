"""Ordered features over blocks of rows.

`row_id` is the dense position by (partition keys, time), see `sequence`. Windows run inside bounded blocks
that carry the needed rows of the block before, so neither a whole table nor a hot entity meets one task.
Partition keys (entity, split) are part of the window, so no window crosses them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstock.operators.ordering import in_blocks, with_row_id


def sequence(df: DataFrame, order: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Add the dense `row_id` by (partition…, order…) that the window functions need."""
    return with_row_id(df, [*partition, *order])


def over_blocks(
    df: DataFrame, exprs, context: int, row_id: str = "row_id", partition: Sequence[str] = (), block_rows: int | None = None
) -> DataFrame:
    """Evaluate `exprs(window)` over bounded blocks; `window` is ordered by row id, without a frame."""
    window = Window.partitionBy("_block", *partition).orderBy(row_id)
    blocked = in_blocks(df, row_id, context, block_rows).select("*", *exprs(window))
    return blocked.filter(~F.col("_context")).drop("_block", "_context")


def lags(df, cols: Sequence[str], steps: Sequence[int] = (1, 2), row_id="row_id", partition=(), block_rows=None) -> DataFrame:
    """Add `<col>_lag<n>`."""
    return over_blocks(
        df,
        lambda w: [F.lag(c, n).over(w).alias(f"{c}_lag{n}") for c in cols for n in steps],
        max(steps), row_id, partition, block_rows,
    )


_STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def rolling(
    df, cols: Sequence[str], width: int, stats: Sequence[str] = ("mean", "std"), complete: bool = False,
    row_id="row_id", partition=(), block_rows=None,
) -> DataFrame:
    """Add `<col>_<stat><width>` over the last `width` rows; with `complete` drop rows with shorter windows."""

    def exprs(window):
        frame = window.rowsBetween(-(width - 1), 0)
        out = [_STATS[s](c).over(frame).alias(f"{c}_{s}{width}") for c in cols for s in stats]
        return [*out, F.count(F.lit(1)).over(frame).alias("_width")] if complete else out

    done = over_blocks(df, exprs, width - 1, row_id, partition, block_rows)
    return done.filter(F.col("_width") == width).drop("_width") if complete else done


def transitions(df, cols: Sequence[str], width: int | None = None, row_id="row_id", partition=(), block_rows=None) -> DataFrame:
    """Add `<col>_changed` (0/1, first row 0) and, with `width`, `<col>_changes<width>` over the last rows."""
    changed = over_blocks(
        df,
        lambda w: [
            F.coalesce((F.col(c) != F.lag(c, 1).over(w)).cast("int"), F.lit(0)).alias(f"{c}_changed") for c in cols
        ],
        1, row_id, partition, block_rows,
    )
    if width is None:
        return changed
    return over_blocks(
        changed,
        lambda w: [F.sum(f"{c}_changed").over(w.rowsBetween(-(width - 1), 0)).alias(f"{c}_changes{width}") for c in cols],
        width - 1, row_id, partition, block_rows,
    )


def trend(df, col: str, at: str, width: int, row_id="row_id", partition=(), block_rows=None) -> DataFrame:
    """Add `<col>_slope<width>`: least-squares slope over `at` within the last `width` rows."""
    return over_blocks(
        df,
        lambda w: [F.regr_slope(col, at).over(w.rowsBetween(-(width - 1), 0)).alias(f"{col}_slope{width}")],
        width - 1, row_id, partition, block_rows,
    )


def level_state(level: Column, low: float, high: float) -> Column:
    """low / normal / high by two cuts; NULL stays NULL."""
    return F.when(level < low, "low").when(level > high, "high").when(level.isNotNull(), "normal")


def gradient(upstream: Column, downstream: Column) -> Column:
    """Difference of two readings of the same row."""
    return upstream - downstream


def boundary_windows(df, split: str, width: int, order: Sequence[str], block_rows=None) -> DataFrame:
    """Rows whose window of `width` rows, taken over the whole table, uses more than one split."""
    ordered = sequence(df, order)
    seen = over_blocks(
        ordered,
        lambda w: [
            F.min(split).over(w.rowsBetween(-(width - 1), 0)).alias("_low"),
            F.max(split).over(w.rowsBetween(-(width - 1), 0)).alias("_high"),
        ],
        width - 1, block_rows=block_rows,
    )
    return seen.filter(F.col("_low") != F.col("_high")).drop("_low", "_high")


# Window of the smoothed log spectrum, and the score above which a point is an outlier.
SPECTRUM_WINDOW, OUTLIER_SCORE = 3, 3.0


def clean_outliers(
    long: DataFrame, row_id: str = "row_id", block_rows: int = 4096,
    spectrum_window: int = SPECTRUM_WINDOW, threshold: float = OUTLIER_SCORE, overlap: int | None = None,
) -> DataFrame:
    """Spectral-residual cleaning of `(sensor, row_id, value)`: outliers are replaced by the mode of their block.

    Blocks are numbered inside each sensor from its first row (`row_id` dense within a sensor, as `with_row_id` ordered by
    sensor gives): blocks of `block_rows` rows, the last one also taking the remainder, so no block is a fragment and other
    sensors never change a sensor's blocks. Each block is read with `overlap` rows of context on both sides (overlap-save)
    and reports its own rows only. Gaps (null or NaN values) are interpolated linearly before the transform, are never
    outliers and stay as they are. A point is an outlier when its saliency exceeds the window mean by more than `threshold`
    times the mean; the mode is that of the window's values (the smallest of ties).
    """
    overlap = block_rows // 4 if overlap is None else overlap
    spans = long.groupBy("sensor").agg(F.min(row_id).alias("_first"), F.count(F.lit(1)).alias("_n"))
    pos = F.col(row_id) - F.col("_first")
    last = F.greatest(F.floor(F.col("_n") / block_rows) - 1, F.lit(0)).cast("long")
    core = F.least(F.floor(pos / block_rows).cast("long"), last)
    end = F.when(core == last, F.col("_n")).otherwise((core + 1) * block_rows)
    homes = F.array(
        F.struct(core.alias("_block"), F.lit(True).alias("_core")),
        F.when((core > 0) & (pos - core * block_rows < overlap), F.struct((core - 1).alias("_block"), F.lit(False).alias("_core"))),
        F.when((core < last) & (end - pos <= overlap), F.struct((core + 1).alias("_block"), F.lit(False).alias("_core"))),
    )
    placed = long.join(spans, "sensor").select(
        "sensor", row_id, "value", F.explode(F.filter(homes, lambda h: h.isNotNull())).alias("_home")
    ).select("sensor", row_id, "value", "_home._block", "_home._core")

    def clean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row_id)
        x = pdf["value"].to_numpy(dtype=float)
        gap = ~np.isfinite(x)
        filled = x.copy()
        if gap.all():
            filled[:] = 0.0
        elif gap.any():
            at = np.arange(len(x))
            filled[gap] = np.interp(at[gap], at[~gap], x[~gap])
        spectrum = np.fft.fft(filled)
        log_amplitude = np.log(np.abs(spectrum) + 1e-12)
        kernel = np.ones(spectrum_window) / spectrum_window
        padded = np.pad(log_amplitude, (spectrum_window // 2, spectrum_window - 1 - spectrum_window // 2), mode="edge")
        residual = log_amplitude - np.convolve(padded, kernel, mode="valid")
        saliency = np.abs(np.fft.ifft(np.exp(residual + 1j * np.angle(spectrum))))
        mean = saliency.mean()
        outlier = ((saliency - mean) > threshold * mean) & ~gap
        mode = pd.Series(x[~gap]).mode()
        cleaned = np.where(outlier & (len(mode) > 0), mode.iloc[0] if len(mode) else np.nan, x)
        out = pdf.assign(cleaned=cleaned, outlier=outlier.astype("int32"))
        return out[out["_core"]][["sensor", row_id, "value", "cleaned", "outlier"]]

    return placed.groupBy("sensor", "_block").applyInPandas(clean, f"sensor string, {row_id} long, value double, cleaned double, outlier int")
