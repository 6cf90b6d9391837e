"""Incremental stacking of arriving frames.

The state of a position is (sum of v * w, sum of w, frames), which merges in any order, so a plain
streaming aggregation keeps it; its size is that of one frame, however many arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def incremental_stack(pixels: DataFrame, by: tuple[str, ...] = ("ch", "y", "x"), weight: str | None = None) -> DataFrame:
    """Weighted mean of all frames so far; for a stream, write it in update or complete mode."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = F.col("v").isNotNull()
    sums = pixels.groupBy(*by).agg(F.sum(F.col("v") * w).alias("vw"), F.sum(F.when(known, w)).alias("w"), F.count("v").alias("frames"))
    return sums.select(*by, (F.col("vw") / F.col("w")).alias("v"), "frames")


def windowed_levels(samples: DataFrame, time: str = "ts", value: str = "value", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean level of each key and time window; samples later than `late` are dropped by the watermark."""
    return samples.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.avg(value).alias("v"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "v", "n")
