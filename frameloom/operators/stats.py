"""Per-frame statistics and location/scale estimators.

Each function takes pixels and grouping columns.  Sums, moments, order statistics and
histograms are built-in aggregates; estimators that iterate run per group in one Arrow
task a group (a frame and channel), which bounds memory by a frame.
"""

from __future__ import annotations

from enum import IntEnum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import robust


class Estimator(IntEnum):
    MEAN_STDDEV = 0
    MEDIAN_MAD = 1
    IKSS = 2
    CLIPPED_MEDIAN_QN = 3
    HISTOGRAM = 4


def basic(pixels: DataFrame, by: list[str]) -> DataFrame:
    """min, max, mean, std_dev (population) in one aggregation."""
    return pixels.groupBy(*by).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std_dev"))


def median_mad(pixels: DataFrame, by: list[str]) -> DataFrame:
    """location = median, scale = 1.4826 * MAD, both exact."""
    med = pixels.groupBy(*by).agg(F.median("v").alias("location"))
    dev = pixels.join(med, by).withColumn("d", F.abs(F.col("v") - F.col("location")))
    return dev.groupBy(*by).agg(F.first("location").alias("location"), (robust.MAD_TO_SIGMA * F.median("d")).alias("scale"))


def kth_smallest(pixels: DataFrame, by: list[str], k: int | None = None) -> DataFrame:
    """The k-th smallest value (from 1); k=None takes the first quartile, element n // 4 + 1."""
    order = Window.partitionBy(*by).orderBy("v")
    ranked = pixels.where("v IS NOT NULL").withColumn("r", F.row_number().over(order)).withColumn("n", F.count("v").over(Window.partitionBy(*by)))
    at = F.lit(k) if k is not None else (F.floor(F.col("n") / 4) + 1)
    return ranked.where(F.col("r") == at).select(*by, "v")


def histogram(pixels: DataFrame, by: list[str], bins: int = 4096, shift: float = 0.5) -> DataFrame:
    """by, lo, hi, bin, n: counts of floor((v - min) * (bins - 1) / (max - min) + shift); with shift 0 a bin begins at its value."""
    span = pixels.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) * (bins - 1) / (F.col("hi") - F.col("lo")) + shift)).otherwise(0).cast("int")
    return pixels.where("v IS NOT NULL").join(span, by).groupBy(*by, "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("n"))


def histogram_location_scale(pixels: DataFrame, by: list[str], bins: int = 4096) -> DataFrame:
    """location = value of the fullest inner bin; scale = half width about it that holds 68.27 percent."""
    h = histogram(pixels, by, bins)
    inner = h.where((F.col("bin") > 0) & (F.col("bin") < bins - 1))
    peak = inner.groupBy(*by).agg(F.max(F.struct("n", (-F.col("bin")).alias("m"))).alias("p")).select(*by, (-F.col("p.m")).alias("peak"))
    away = h.join(peak, by).withColumn("d", F.abs(F.col("bin") - F.col("peak")))
    mass = away.groupBy(*by, "lo", "hi", "peak", "d").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*by).orderBy("d")
    run = mass.withColumn("c", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    width = F.col("hi") - F.col("lo")
    return (
        run.where(F.col("c") >= 0.6827 * F.col("total"))
        .groupBy(*by, "lo", "hi", "peak")
        .agg(F.min("d").alias("d"))
        .select(*by, (F.col("lo") + F.col("peak") * width / (bins - 1)).alias("location"), ((F.col("d") + 0.5) * width / (bins - 1)).alias("scale"))
    )


def perceptual_histogram(pixels: DataFrame, by: list[str], bins: int = 4096) -> DataFrame:
    """by, lo, hi, bin, n: counts of floor(((v - min) / (max - min)) ** (1 / 2.4) * (bins - 1))."""
    span = pixels.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    u = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.floor(F.pow(u, 1 / 2.4) * (bins - 1))).otherwise(0).cast("int")
    return pixels.where("v IS NOT NULL").join(span, by).groupBy(*by, "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("n"))


def _bin_centre(lo, hi, bin_, bins: int, perceptual: bool):
    share = (bin_ + 0.5) / (bins - 1)
    return lo + (share**2.4 if perceptual else share) * (hi - lo)


def histogram_peak(counts: DataFrame, by: list[str], bins: int = 4096, perceptual: bool = False) -> DataFrame:
    """by, x, y: centre of the fullest bin (the first of equal ones), and the mean of its count and the next bin's."""
    best = counts.groupBy(*by, "lo", "hi").agg(F.max(F.struct("n", (-F.col("bin")).alias("m"))).alias("p")).select(*by, "lo", "hi", F.col("p.n").alias("n"), (-F.col("p.m")).alias("bin"))
    after = counts.select(*by, (F.col("bin") - 1).alias("bin"), F.col("n").alias("next"))
    return best.join(after, [*by, "bin"], "left").select(*by, _bin_centre(F.col("lo"), F.col("hi"), F.col("bin"), bins, perceptual).alias("x"), ((F.col("n") + F.coalesce("next", F.lit(0))) / 2).alias("y"))


def gaussian_mode(counts: DataFrame, by: list[str], bins: int = 4096, perceptual: bool = False) -> DataFrame:
    """by, mode, std_dev of the normal curve that fits a histogram's counts best (least squares, all bins)."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        lo, hi = float(part["lo"].iloc[0]), float(part["hi"].iloc[0])
        n = np.zeros(bins)
        n[part["bin"].to_numpy()] = part["n"].to_numpy()
        return pd.DataFrame([(*key, *robust.fitted_normal(_bin_centre(lo, hi, np.arange(bins), bins, perceptual), n))], columns=[*by, "mode", "std_dev"])

    return counts.groupBy(*by).applyInPandas(run, _schema(counts, by) + ", mode double, std_dev double")  # bins of a frame, not pixels


def bounded(pixels: DataFrame, by: list[str], location: DataFrame, low: float, high: float) -> DataFrame:
    """by, std_dev, mad about a given location (by..., location), of the values in [low, high]; all of them, not a sample."""
    d = F.col("v") - F.col("location")
    inside = pixels.where(F.col("v").between(low, high)).join(location.select(*by, "location"), by)
    return inside.groupBy(*by).agg(F.sqrt(F.avg(d * d)).alias("std_dev"), (robust.MAD_TO_SIGMA * F.median(F.abs(d))).alias("mad"))


def noise(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Immerkaer's estimate (CVIU 1996) over complete 3x3 neighbourhoods; NULL where there is none.

    The 3x3 kernel is separable (1 -2 1 along rows, then along columns), so two windows
    along sorted rows and columns do it; no join.
    """
    return _laplacian(pixels, by).groupBy(*by).agg((F.sum(F.abs("lap")) * float(np.sqrt(np.pi / 2)) / (6.0 * F.count("lap"))).alias("noise"))


def _laplacian(pixels: DataFrame, by: list[str]) -> DataFrame:
    def second(df: DataFrame, along: str, across: str, value: str, out: str) -> DataFrame:
        w = Window.partitionBy(*by, across).orderBy(along)
        near = (F.lag(along).over(w) == F.col(along) - 1) & (F.lead(along).over(w) == F.col(along) + 1)
        return df.withColumn(out, F.when(near, F.lag(value).over(w) - 2 * F.col(value) + F.lead(value).over(w)))

    return second(second(pixels, "x", "y", "v", "dx"), "y", "x", "dx", "lap")


def rank_regression(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Line through sorted values against their rank from 0: slope (covariance over n + 1), intercept, n."""
    ranked = pixels.where("v IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("v")) - 1)
    n = F.count("v")
    slope = F.regr_slope("v", "r") * n / (n + 1)
    return ranked.groupBy(*by).agg(slope.alias("slope"), (F.avg("v") - slope * F.avg("r")).alias("intercept"), n.alias("n"))


def sigma_clipped_median_mad(pixels: DataFrame, by: list[str], sigma: float = 2.0) -> DataFrame:
    """Median and MAD of the values within `sigma` scaled MADs of the median."""
    first = median_mad(pixels, by)
    inside = pixels.join(first, by).where(F.abs(F.col("v") - F.col("location")) <= sigma * F.col("scale")).drop("location", "scale")
    return median_mad(inside, by)


def half_sample_mode(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Mode by repeatedly keeping the half of the sorted values with the least range (Bickel 2002)."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(part["v"].dropna().to_numpy(float))
        while len(v) > 2:
            k = (len(v) + 1) // 2
            i = int(np.argmin(v[k - 1 :] - v[: len(v) - k + 1]))
            v = v[i : i + k] if k < len(v) else v[:2]
        return pd.DataFrame([(*key, float(v.mean()) if len(v) else None)], columns=[*by, "mode"])

    return pixels.groupBy(*by).applyInPandas(run, _schema(pixels, by) + ", mode double")


def location_scale(pixels: DataFrame, by: list[str], how: Estimator | int = Estimator.CLIPPED_MEDIAN_QN, seed: int = 1) -> DataFrame:
    """by, location, scale by one of the five estimators.  Sampled pairs are drawn with a fixed seed."""
    how = Estimator(how)
    if how == Estimator.MEAN_STDDEV:
        return pixels.groupBy(*by).agg(F.avg("v").alias("location"), F.stddev_pop("v").alias("scale"))
    if how == Estimator.MEDIAN_MAD:
        return median_mad(pixels, by)
    if how == Estimator.HISTOGRAM:
        return histogram_location_scale(pixels, by)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        v = part["v"].to_numpy(float)
        location, scale = robust.ikss(v) if how == Estimator.IKSS else robust.clipped_median_qn(v, seed)
        return pd.DataFrame([(*key, location, scale)], columns=[*by, "location", "scale"])

    return pixels.select(*by, F.col("v").cast("double")).groupBy(*by).applyInPandas(run, _schema(pixels, by) + ", location double, scale double")


def _schema(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
