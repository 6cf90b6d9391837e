"""Background model: a coarse grid of trimmed medians, smoothed and subtracted.

One aggregation gathers the pixels of each cell, and a kernel takes its medians; from there on a frame has only a
few hundred cells.  The model is one row a frame, with its finished cells as an array; the subtraction joins
pixels with it on the frame and is a projection.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.robust import MAD_TO_SIGMA


def cell_of(c: str, n: str, grid: int):
    """(cell number, cells along the axis, spacing): cells [round(i s), round((i + 1) s)) with s = n / cells."""
    count = F.greatest(F.floor((F.col(n) + grid // 2) / grid), F.lit(1))
    spacing = F.col(n) / count
    guess = F.floor((F.col(c) + 0.5) / spacing)
    low = F.floor(guess * spacing + 0.5)
    high = F.floor((guess + 1) * spacing + 0.5)
    cell = F.when(F.col(c) < low, guess - 1).when(F.col(c) >= high, guess + 1).otherwise(guess)
    return F.least(F.greatest(cell, F.lit(0)), count - 1).cast("int"), count.cast("int"), spacing


def without_stars(pixels: DataFrame, stars: DataFrame, hfr_factor: float) -> DataFrame:
    """Pixels, v NULL inside the discs of radius hfr * hfr_factor.

    Discs are spelled out as pixels, so the exclusion is an equi-join.
    """
    r = F.col("hfr") * hfr_factor
    span = lambda c: F.sequence(F.ceil(F.col(c) - r).cast("int"), F.floor(F.col(c) + r).cast("int"))
    covered = (
        stars.where(r > 0)
        .select("frame_id", F.col("x").alias("sx"), F.col("y").alias("sy"), r.alias("r"), F.explode(span("y")).alias("y"), span("x").alias("xs"))
        .select("frame_id", "sx", "sy", "r", "y", F.explode("xs").alias("x"))
        .where(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2) <= F.col("r") * F.col("r"))
        .select("frame_id", "y", "x", F.lit(True).alias("__covered"))
        .distinct()
    )
    return pixels.join(covered, ["frame_id", "y", "x"], "left").withColumn("v", F.when(F.col("__covered").isNull(), F.col("v"))).drop("__covered")


def cells(pixels: DataFrame, grid: int, sigma: float = 1.5, stars: DataFrame | None = None, hfr_factor: float = 4.0, by: tuple[str, ...] = ("frame_id", "ch")) -> DataFrame:
    """by, cy, cx, ny, nx, h, w, v: the trimmed median of each cell; NULL for a cell without a free pixel.

    Values up to median + sigma * 1.4826 * MAD (strict) are kept, and their median is taken.
    """
    by = list(by)
    sizes = pixels.groupBy(*by).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    placed = pixels.join(sizes, by)
    (cy, ny, _), (cx, nx, _) = cell_of("y", "h", grid), cell_of("x", "w", grid)
    placed = placed.withColumn("cy", cy).withColumn("cx", cx).withColumn("ny", ny).withColumn("nx", nx)
    key = [*by, "h", "w", "ny", "nx", "cy", "cx"]
    if stars is not None:
        placed = without_stars(placed, stars, hfr_factor)

    @F.pandas_udf("double")
    def trimmed(values: pd.Series) -> pd.Series:
        return pd.Series([trimmed_median(np.asarray(v, float), sigma) for v in values])

    held = placed.groupBy(*key).agg(F.collect_list(F.col("v").cast("double")).alias("__v"))  # pixels of one cell, missing ones left out
    return held.select(*key, F.when(F.size("__v") > 0, trimmed("__v")).alias("v"))


def trimmed_median(v: np.ndarray, sigma: float) -> float:
    if not len(v):
        return np.nan
    m = np.median(v)
    low = v[v < m + sigma * MAD_TO_SIGMA * np.median(np.abs(v - m))]
    return float(np.median(low)) if len(low) else float(m)


def finished(grid_cells: DataFrame, clip: int = 0, by: tuple[str, ...] = ("frame_id", "ch")) -> DataFrame:
    """by, h, w, ny, nx, model: cells of a frame as one array, row by row.

    The `clip` brightest cells go, missing cells are filled from neighbours, and a 3x3 Gaussian (sigma 0.5) smooths them.
    """
    by = list(by)
    side = _cell_weight()

    @F.pandas_udf("array<double>")
    def model(ny: pd.Series, nx: pd.Series, cells: pd.DataFrame) -> pd.Series:
        out = []
        for rows, columns, cy, cx, v in zip(ny, nx, cells["cy"], cells["cx"], cells["v"]):
            a = np.full((rows, columns), np.nan)
            a[np.asarray(cy, int), np.asarray(cx, int)] = np.asarray(v, float)
            known = np.sort(a[~np.isnan(a)])[::-1]
            if 0 < clip < len(known):
                a[a >= known[clip - 1]] = np.nan
            out.append(weighted(filled(a), side).ravel())
        return pd.Series(out)

    frames = grid_cells.groupBy(*by, "h", "w", "ny", "nx").agg(F.collect_list(F.struct("cy", "cx", F.coalesce("v", F.lit(float("nan"))).alias("v"))).alias("c"))
    return frames.select(*by, "h", "w", "ny", "nx", model("ny", "nx", F.struct(F.col("c.cy").alias("cy"), F.col("c.cx").alias("cx"), F.col("c.v").alias("v"))).alias("model"))


def filled(a: np.ndarray) -> np.ndarray:
    """Missing cells become the median of their known neighbours, those with most known neighbours first."""
    a = a.copy()
    need = 8
    while need > 0 and np.isnan(a).any():
        padded = np.pad(a, 1, constant_values=np.nan)
        near = np.stack([padded[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
        ready = np.isnan(a) & ((~np.isnan(near)).sum(axis=0) >= need)
        if ready.any():
            a[ready] = np.nanmedian(near[:, ready], axis=0)
            need = 8
        else:
            need -= 1
    return np.nan_to_num(a) if np.isnan(a).all() else a


def _cell_weight() -> tuple[float, float]:
    edge = lambda x: 0.5 * (1 + math.erf(x / (0.5 * math.sqrt(2))))
    return edge(0.5) - edge(-0.5), edge(1.5) - edge(0.5)


def weighted(a: np.ndarray, side: tuple[float, float]) -> np.ndarray:
    """3x3 Gaussian smoothing; at edges the weights inside the grid are normalised."""
    total, weight = np.zeros(a.shape), np.zeros(a.shape)
    padded, there = np.pad(a, 1), np.pad(np.ones(a.shape), 1)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            k = side[abs(dy)] * side[abs(dx)]
            at = (slice(1 + dy, 1 + dy + a.shape[0]), slice(1 + dx, 1 + dx + a.shape[1]))
            total += k * padded[at]
            weight += k * there[at]
    return total / weight


def subtract(pixels: DataFrame, model: DataFrame, by: tuple[str, ...] = ("frame_id", "ch"), keep_background: bool = False) -> DataFrame:
    """v less the model, interpolated between cell centres and continued linearly beyond the outer ones.

    An axis with one cell is constant along it.
    """
    renamed = model.select(*by, *[F.col(c).alias(f"__{c}") for c in ("h", "w", "ny", "nx", "model")])
    placed = pixels.join(renamed, list(by))
    for c, n, size in (("y", "__ny", "__h"), ("x", "__nx", "__w")):
        at = (F.col(c) + 0.5) / (F.col(size) / F.col(n)) - 0.5
        low = F.greatest(F.least(F.floor(at), F.col(n) - 2), F.lit(0)).cast("int")
        placed = placed.withColumn(f"__{c}0", low).withColumn(f"__{c}f", F.when(F.col(n) > 1, at - low).otherwise(0.0))
    corner = lambda dy, dx: F.get("__model", F.least(F.col("__y0") + dy, F.col("__ny") - 1) * F.col("__nx") + F.least(F.col("__x0") + dx, F.col("__nx") - 1))
    for dy, dx in ((0, 0), (0, 1), (1, 0), (1, 1)):
        placed = placed.withColumn(f"__m{dy}{dx}", corner(dy, dx))
    top = F.col("__m00") + (F.col("__m01") - F.col("__m00")) * F.col("__xf")
    bottom = F.col("__m10") + (F.col("__m11") - F.col("__m10")) * F.col("__xf")
    out = placed.withColumn("background", top + (bottom - top) * F.col("__yf"))
    if not keep_background:
        return out.withColumn("v", F.col("v") - F.col("background")).select(*pixels.columns)
    return out.withColumn("v", F.col("v") - F.col("background")).select(*pixels.columns, "background")
