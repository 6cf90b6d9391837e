"""Stacking: a group-by over pixel position with a robust aggregate over frames.

One shuffle, on the position.  Median, mean and weighted mean are built-in aggregates with
map-side combining where they have any; the iterative modes gather the values of a position (as
many as there are frames in the stack) and run a vectorised kernel over many positions.
"""

from __future__ import annotations

from enum import IntEnum

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import robust


class StackMode(IntEnum):
    MEDIAN = 0
    MEAN = 1
    SIGMA = 2
    WINSOR_SIGMA = 3
    MAD_SIGMA = 4
    LINEAR_FIT = 5
    AUTO = 6


class Weighting(IntEnum):
    NONE = 0
    EXPOSURE = 1
    INVERSE_NOISE = 2
    INVERSE_HFR = 3


def auto_mode(frames: int) -> StackMode:
    """The mode for a number of frames."""
    if frames >= 25:
        return StackMode.LINEAR_FIT
    if frames >= 15:
        return StackMode.WINSOR_SIGMA
    return StackMode.SIGMA if frames >= 6 else StackMode.MEAN


def weights(frames: DataFrame, how: Weighting, by: tuple[str, ...] = ()) -> DataFrame:
    """frame_id, weight: exposure, or 1 / (1 + 4 q) with q the noise or HFR scaled to [0, 1] over the stack.

    Equal values all weigh 1.  A missing or zero exposure, noise or HFR weighs NULL, which fails
    stack() rather than spoiling it.
    """
    if how == Weighting.EXPOSURE:
        return frames.select("frame_id", F.when(F.col("exposure") > 0, F.col("exposure").cast("double")).alias("weight"))
    q = "noise" if how == Weighting.INVERSE_NOISE else "hfr"
    span = frames.groupBy(*by).agg(F.min(q).alias("lo"), F.max(q).alias("hi"))
    joined = frames.join(span, list(by)) if by else frames.crossJoin(F.broadcast(span))  # span is one row
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col(q) - F.col("lo")) / (F.col("hi") - F.col("lo"))).when(F.col(q).isNotNull(), 0.0)
    return joined.select("frame_id", (1 / (1 + 4 * scaled)).cast("double").alias("weight"))


def mad_sigma(pixels: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """Mode 4 in built-in aggregates: position, v, n_low, n_high."""
    centre = pixels.groupBy(*by).agg(F.sort_array(F.collect_list("v")).alias("vs")).withColumn("med", _middle("vs"))
    dev = centre.withColumn("ds", F.sort_array(F.transform("vs", lambda v: F.abs(v - F.col("med"))))).withColumn("mad", robust.MAD_TO_SIGMA * _middle("ds"))
    lo, hi = F.col("med") - low * F.col("mad"), F.col("med") + high * F.col("mad")
    inside = F.filter("vs", lambda v: (v >= lo) & (v <= hi))
    mean = F.when(F.size("inside") > 0, F.aggregate("inside", F.lit(0.0), lambda a, v: a + v) / F.size("inside"))
    return dev.withColumn("inside", inside).select(*by, mean.alias("v"), F.size(F.filter("vs", lambda v: v < lo)).alias("n_low"), F.size(F.filter("vs", lambda v: v > hi)).alias("n_high"))


def _middle(values: str) -> Column:
    """Median of a sorted array column without NULLs, in place of a second shuffle."""
    n = F.size(values)
    at = lambda i: F.element_at(values, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def stack(pixels: DataFrame, mode: StackMode | int = StackMode.AUTO, by: tuple[str, ...] = ("ch", "y", "x"), sigma_low: float = 2.75, sigma_high: float = 2.75, weight: str | None = None) -> DataFrame:
    """One row per position: `by`, v, n_low, n_high (clipped values); v is NULL where no frame has a value.

    `weight` names a column of pixels.  Median and linear fit have no weighted form and raise, as do
    sigmas that aren't positive.  Mode AUTO must be resolved with auto_mode() first.
    """
    mode = StackMode(mode)
    by = list(by)
    none = [F.lit(0).alias("n_low"), F.lit(0).alias("n_high")]
    if weight and mode in (StackMode.MEDIAN, StackMode.LINEAR_FIT, StackMode.MAD_SIGMA):
        raise ValueError(f"{mode.name} has no weighted form")
    if mode not in (StackMode.MEDIAN, StackMode.MEAN) and min(sigma_low, sigma_high) <= 0:
        raise ValueError("sigmas must be positive")
    if mode == StackMode.AUTO:
        raise ValueError("resolve AUTO with auto_mode(number of frames)")
    if mode == StackMode.MEDIAN:
        return pixels.groupBy(*by).agg(F.median("v").alias("v")).select("*", *none)
    if mode == StackMode.MEAN:
        w = F.when(F.col("v").isNotNull(), F.col(weight)) if weight else None
        v = F.sum(F.col("v") * F.col(weight)) / F.sum(w) if weight else F.avg("v")
        return pixels.groupBy(*by).agg(v.alias("v")).select("*", *none)
    if mode == StackMode.MAD_SIGMA:
        return mad_sigma(pixels, by, sigma_low, sigma_high)
    value = F.struct("v", weight) if weight else F.col("v")
    gathered = pixels.groupBy(*by).agg(F.collect_list(F.when(F.col("v").isNotNull(), value)).alias("vs"))
    vs = F.transform("vs", lambda s: s["v"].cast("double")) if weight else F.col("vs").cast("array<double>")
    ws = F.transform("vs", lambda s: s[weight].cast("double")) if weight else F.lit(None).cast("array<double>")

    @F.pandas_udf("v double, n_low int, n_high int")
    def clip(values: pd.Series, given: pd.Series) -> pd.DataFrame:
        m = robust.as_matrix(values)
        if not m.shape[1]:
            return pd.DataFrame({"v": [None] * len(m), "n_low": 0, "n_high": 0})
        w = np.nan_to_num(robust.as_matrix(given)) if weight else None
        if mode == StackMode.LINEAR_FIT:
            v, lo, hi = robust.linear_fit(m, sigma_low, sigma_high)
        else:
            v, lo, hi = robust.sigma_clip(m, sigma_low, sigma_high, w, winsor=mode == StackMode.WINSOR_SIGMA)
        return pd.DataFrame({"v": pd.Series(v).astype(object).where(~np.isnan(v), None).astype("Float64"), "n_low": lo, "n_high": hi})

    return gathered.withColumn("r", clip(vs, ws)).select(*by, "r.*")


def stack_batches(pixels: DataFrame, batches: int, by: tuple[str, ...] = ("ch", "y", "x"), mode: StackMode | int = StackMode.MEAN, seed: int = 0, sigma_low: float = 2.75, sigma_high: float = 2.75, batch: Column | None = None) -> DataFrame:
    """Two-level stack: each batch of frames by itself, then the mean of the batches, weighted by their frames.

    Frames are dealt into batches by a seeded hash, or by `batch`.
    """
    dealt = pixels.withColumn("batch", F.pmod(F.xxhash64("frame_id", F.lit(seed)), F.lit(batches)) if batch is None else batch)
    sizes = dealt.groupBy(*by, "batch").agg(F.count("v").alias("frames"))
    each = stack(dealt, mode, (*by, "batch"), sigma_low, sigma_high).join(sizes, [*by, "batch"])
    return each.groupBy(*by).agg((F.sum(F.col("v") * F.col("frames")) / F.sum(F.when(F.col("v").isNotNull(), F.col("frames")))).alias("v"), F.sum("n_low").cast("int").alias("n_low"), F.sum("n_high").cast("int").alias("n_high"))


def clip_report(stacked: DataFrame, frames: int) -> DataFrame:
    """Totals of clipped values and their share of all values."""
    total = F.count("*") * frames
    return stacked.agg(F.sum("n_low").alias("clipped_low"), F.sum("n_high").alias("clipped_high"), (F.sum("n_low") * 100.0 / total).alias("low_percent"), (F.sum("n_high") * 100.0 / total).alias("high_percent"))


def goal_seek_sigma(pixels: DataFrame, clipped_low: float, clipped_high: float, mode: StackMode | int = StackMode.SIGMA, by: tuple[str, ...] = ("ch", "y", "x"), rounds: int = 8) -> tuple[float, float]:
    """Sigmas in [1, 11] that clip about the given percentages of values, by bisection of both at once."""
    lo, hi = [1.0, 1.0], [11.0, 11.0]
    n = pixels.where(F.col("v").isNotNull()).count()
    for _ in range(rounds):
        s = [(a + b) / 2 for a, b in zip(lo, hi)]
        got = stack(pixels, mode, by, *s).agg(F.sum("n_low"), F.sum("n_high")).first()
        for i, want in enumerate((clipped_low, clipped_high)):
            if 100.0 * (got[i] or 0) / max(1, n) > want:
                lo[i] = s[i]
            else:
                hi[i] = s[i]
    return tuple((a + b) / 2 for a, b in zip(lo, hi))
