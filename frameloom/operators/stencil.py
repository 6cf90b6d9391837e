"""Neighbourhood operators: bad pixels, debayer, bin, deband, blur, unsharp mask, warp, star mask."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiles import TILE, shifted, tiled

#: Offset (x, y) of the red sample in the four colour filter arrays.
CFA = {"RGGB": (0, 0), "GRBG": (1, 0), "GBRG": (0, 1), "BGGR": (1, 1)}
NINE = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
#: Green quincunx: the sample, its four diagonal neighbours, and the four two steps away.
GREEN_NINE = [(0, 0), (-1, -1), (-1, 1), (1, -1), (1, 1), (-2, 0), (2, 0), (0, -2), (0, 2)]


def _nanmedian(stack: list[np.ndarray]) -> np.ndarray:
    """Median over a short list of arrays, NaN left out."""
    a = np.sort(np.stack(stack), axis=0)  # NaN sort last
    n = (~np.isnan(a)).sum(axis=0)[None]
    at = lambda k: np.take_along_axis(a, np.maximum(k, 0), axis=0)[0]
    return (at((n - 1) // 2) + at(n // 2).copy()) / 2 if len(stack) > 1 else a[0]


def _median3x3(a, y0, x0, h, w):
    return np.where(_inner(a, y0, x0, h, w, 1), _nanmedian([shifted(a, dy, dx) for dy, dx in NINE]), a)


def median3x3(pixels: DataFrame, by: tuple[str, ...] = ("frame_id", "ch")) -> DataFrame:
    """3x3 median; border pixels keep their value."""
    return tiled(pixels, _median3x3, 1, by)


def _inner(a: np.ndarray, y0: int, x0: int, h: int, w: int, margin: int) -> np.ndarray:
    y, x = np.arange(a.shape[-2])[:, None] + y0, np.arange(a.shape[-1])[None, :] + x0
    return (y >= margin) & (y < h - margin) & (x >= margin) & (x < w - margin)


def _replace_outliers(pixels: DataFrame, kernel, halo: int, by: tuple[str, ...], low: float, high: float, on_lattice: Column | None = None) -> DataFrame:
    """Replace samples whose difference to the kernel's median is beyond -low / +high population standard deviations, all at once.

    Returns the pixel columns and `bad`.  One pass over the tiles gives samples and medians side by side.
    """
    both = tiled(pixels, lambda a, *at: (a, kernel(a, *at)), halo, by, names=("v", "__m"))
    d = F.col("v") - F.col("__m")
    counted = both if on_lattice is None else both.where(on_lattice)
    sigma = counted.groupBy(*by).agg(F.stddev_pop(d).alias("__s"))
    bad = (d < -low * F.col("__s")) | (d > high * F.col("__s"))
    bad = F.coalesce(bad if on_lattice is None else bad & on_lattice, F.lit(False))
    return both.join(sigma, list(by)).withColumn("bad", bad).withColumn("v", F.when(F.col("bad"), F.col("__m")).otherwise(F.col("v"))).select(*pixels.columns, "bad")


def bad_pixels(pixels: DataFrame, low: float = 3.0, high: float = 5.0, by: tuple[str, ...] = ("frame_id", "ch")) -> DataFrame:
    """Cosmetic correction of mono frames against the 3x3 median; border samples are never bad."""
    if low == 0 or high == 0:
        return pixels.withColumn("bad", F.lit(False))
    return _replace_outliers(pixels, _median3x3, 1, by, low, high)


def lattice(channel: str, cfa: str) -> Column:
    """Whether (y, x) holds a sample of the colour."""
    xo, yo = CFA[cfa]
    red = (F.pmod(F.col("x") - xo, F.lit(2)) == 0) & (F.pmod(F.col("y") - yo, F.lit(2)) == 0)
    blue = (F.pmod(F.col("x") - xo, F.lit(2)) == 1) & (F.pmod(F.col("y") - yo, F.lit(2)) == 1)
    return {"R": red, "G": ~red & ~blue, "B": blue}[channel.upper()]


def bad_pixels_bayer(pixels: DataFrame, channel: str, cfa: str = "RGGB", low: float = 3.0, high: float = 5.0, by: tuple[str, ...] = ("frame_id", "ch")) -> DataFrame:
    """Cosmetic correction of one colour of a mosaic against the median of its own lattice.

    Neighbours outside the frame are left out of the median.
    """
    if low == 0 or high == 0:
        return pixels.withColumn("bad", F.lit(False))
    offsets = GREEN_NINE if channel.upper() == "G" else [(2 * dy, 2 * dx) for dy, dx in NINE]

    def kernel(a, y0, x0, h, w):
        return _nanmedian([shifted(a, dy, dx) for dy, dx in offsets])

    return _replace_outliers(pixels, kernel, 2, by, low, high, lattice(channel, cfa))


def debayer(pixels: DataFrame, channel: str, cfa: str = "RGGB", by: tuple[str, ...] = ("frame_id", "ch")) -> DataFrame:
    """Bilinear interpolation of one colour of a mosaic.

    The result begins at the colour filter array's offset, as (0, 0), and is cut to even sizes; samples outside the cut
    still count as neighbours.  Native samples are copied, others are the mean of two (on their row or
    column) or four neighbours.  A red or blue neighbour outside the frame is replaced by the sample of the pixel's
    own 2 x 2 cell, a green one by a mean of the cell's two greens that weighs the nearer by 2 and the other by sqrt 2.
    """
    if not channel or not cfa:
        return pixels
    xo, yo = CFA[cfa]
    c = channel.upper()
    near, far = 2 / (2 + math.sqrt(2)), math.sqrt(2) / (2 + math.sqrt(2))

    def kernel(a, y0, x0, h, w):
        y, x = np.arange(a.shape[-2])[:, None] + y0, np.arange(a.shape[-1])[None, :] + x0
        px, py = (x - xo) & 1, (y - yo) & 1
        own = {"R": (px == 0) & (py == 0), "B": (px == 1) & (py == 1), "G": px != py}[c]
        s = np.where(own, a, np.nan)
        at = lambda dy, dx: shifted(s, dy, dx)
        other = lambda v, instead: np.where(np.isnan(v), instead, v)
        if c == "G":
            left, right, up, down = at(0, -1), at(0, 1), at(-1, 0), at(1, 0)
            red = right + down + other(left, near * right + far * down) + other(up, far * right + near * down)
            blue = up + left + other(right, near * up + far * left) + other(down, far * up + near * left)
            return np.where(own, s, np.where(py == 0, red, blue) / 4)
        one = 1 if c == "B" else -1  # where the cell's own sample lies
        along = lambda dy, dx: (at(one * dy, one * dx) + other(at(-one * dy, -one * dx), at(one * dy, one * dx))) / 2
        cell = at(one, one)
        corners = (cell + sum(other(at(one * dy, one * dx), cell) for dy, dx in ((-1, 1), (1, -1), (-1, -1)))) / 4
        same_row, same_col = py == (c == "B"), px == (c == "B")
        return np.where(own, s, np.where(same_row, along(0, 1), np.where(same_col, along(1, 0), corners)))

    even = lambda n, o: F.col(n) - o - F.pmod(F.col(n) - o, F.lit(2))
    sizes = pixels.groupBy(*by).agg((F.max("y") + 1).alias("__h"), (F.max("x") + 1).alias("__w"))
    moved = tiled(pixels, kernel, 2, by).join(sizes, list(by)).withColumn("y", (F.col("y") - yo).cast("int")).withColumn("x", (F.col("x") - xo).cast("int"))
    return moved.where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < even("__h", yo)) & (F.col("x") < even("__w", xo))).select(*pixels.columns)


def bin_pixels(pixels: DataFrame, n: int = 1, by: tuple[str, ...] = ("frame_id", "ch")) -> DataFrame:
    """n x n means; what doesn't fill a block at the right and bottom is dropped."""
    if n <= 1:
        return pixels
    by = list(by)
    sizes = pixels.groupBy(*by).agg((F.floor((F.max("y") + 1) / n) * n).alias("__h"), (F.floor((F.max("x") + 1) / n) * n).alias("__w"))
    inside = pixels.join(sizes, by).where("y < __h AND x < __w")
    return inside.groupBy(*by, F.floor(F.col("y") / n).cast("int").alias("y"), F.floor(F.col("x") / n).cast("int").alias("x")).agg(F.avg("v").alias("v"))


def deband(pixels: DataFrame, location_scale: DataFrame, percentile: float = 50.0, window: int = 128, sigma: float = 3.0, vertical: bool = False, by: tuple[str, ...] = ("frame_id", "ch")) -> DataFrame:
    """Multiply each row (column if vertical) by the windowed median of row levels over its own.

    A row's level is the k-th smallest, k = int(n * percentile / 100), of its values up to
    location + sigma * scale.  The window of `window` rows is moved inside the frame at its
    edges; the entries it gained that way are replaced by a line through the medians of its halves, continued outside.
    location_scale: by..., location, scale.
    """
    if not 0 < percentile < 100 or window <= 0:
        return pixels
    by = list(by)
    line = "x" if vertical else "y"
    low = pixels.join(location_scale.select(*by, "location", "scale"), by).where(F.col("v") <= F.col("location") + sigma * F.col("scale"))
    ordered = low.groupBy(*by, line).agg(F.sort_array(F.collect_list("v")).alias("a"))  # values of one line of a frame
    k = F.greatest(F.floor(F.size("a") * percentile / 100), F.lit(1)).cast("int")
    levels = ordered.select(*by, F.struct(line, F.element_at("a", k).alias("level")).alias("l"))

    @F.pandas_udf("array<double>")
    def factors(lines: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([_line_factors(np.asarray(i), np.asarray(a, float), window) for i, a in zip(lines, values)])

    # one row a frame: its levels, as many as it has lines
    frames = levels.groupBy(*by).agg(F.sort_array(F.collect_list("l")).alias("l")).select(*by, factors(F.col(f"l.{line}"), F.col("l.level")).alias("__factors"))
    factor = F.get("__factors", F.col(line))
    return pixels.join(frames, by, "left").withColumn("v", F.col("v") * F.coalesce(factor, F.lit(1.0))).select(*pixels.columns)


def _line_factors(lines: np.ndarray, a: np.ndarray, window: int) -> np.ndarray:
    """Factor of every line up to the last one that has a level; 1 for the others."""
    n = len(a)
    w = min(window, n)
    half = w // 2
    start = np.arange(n) - half
    lo = np.clip(start, 0, n - w)
    missing = start - lo  # < 0 at the low edge, > 0 at the high edge
    part = a[lo[:, None] + np.arange(w)]
    left = np.median(part[:, : max(half, 1)], axis=1)
    right = np.median(part[:, half:], axis=1)
    centre, slope = (left + right) / 2, (right - left) / max(half, 1)
    smooth = np.median(part, axis=1)
    for i in np.flatnonzero(missing):
        m = abs(missing[i])
        rest = part[i, : w - m] if missing[i] < 0 else part[i, m:]
        smooth[i] = np.median(np.concatenate([rest, centre[i] + np.sign(missing[i]) * slope[i] * (half + np.arange(1, m + 1))]))
    out = np.ones(int(lines.max()) + 1)
    out[lines] = np.where(a != 0, smooth / np.where(a != 0, a, 1), 1.0)
    return out


def gaussian_kernel(sigma: float) -> list[float]:
    """Taps integrated over pixels, out to where the left tail is under one percent, normalised."""
    edge = lambda x: 0.5 * (1 + math.erf(x / (sigma * math.sqrt(2))))
    radius = 0
    while edge(-radius - 0.5) >= 0.01:
        radius += 1
    radius -= 1
    taps = [edge(i + 0.5) - edge(i - 0.5) for i in range(-radius, radius + 1)]
    return [t / sum(taps) for t in taps]


def reflected(i: np.ndarray, n: int) -> np.ndarray:
    """Indices mirrored once at both ends, the end sample repeated."""
    i = np.where(i < 0, -i - 1, i)
    i = np.where(i >= n, 2 * n - 1 - i, i)
    return np.clip(i, 0, n - 1)


def blurred(a: np.ndarray, y0: int, x0: int, h: int, w: int, taps: list[float]) -> np.ndarray:
    r = len(taps) // 2
    for axis, (start, n) in ((1, (x0, w)), (0, (y0, h))):
        axis -= 2
        size = a.shape[axis]
        total = np.zeros(a.shape)
        for k, t in enumerate(taps):
            at = reflected(np.arange(size) + start + k - r, n) - start
            total += t * np.take(a, np.clip(at, 0, size - 1), axis=axis)
        a = total
    return a


def gaussian_blur(pixels: DataFrame, sigma: float = 2.0, by: tuple[str, ...] = ("frame_id", "ch")) -> DataFrame:
    if sigma == 0:
        return pixels
    taps = gaussian_kernel(sigma)
    return tiled(pixels, lambda a, y0, x0, h, w: blurred(a, y0, x0, h, w, taps), len(taps) // 2, by)


def unsharp_mask(pixels: DataFrame, limits: DataFrame, sigma: float = 1.5, gain: float = 0.0, threshold: float = 1.0, by: tuple[str, ...] = ("frame_id", "ch"), where: Column | None = None) -> DataFrame:
    """v + (v - blurred) * gain, clamped to the frame's range, where v >= location + threshold * scale.

    limits: by..., location, scale, min, max.
    """
    if sigma == 0 or gain == 0:
        return pixels
    by = list(by)
    soft = gaussian_blur(pixels, sigma, tuple(by)).select(*by, "y", "x", F.col("v").alias("__b"))
    v = F.col("v")
    new = F.when(v < F.col("location") + threshold * F.col("scale"), v).otherwise(F.least(F.greatest(v + (v - F.col("__b")) * gain, F.col("min")), F.col("max")))
    if where is not None:
        new = F.when(where, new).otherwise(v)
    return pixels.join(soft, [*by, "y", "x"]).join(limits.select(*by, "location", "scale", "min", "max"), by).withColumn("v", new).select(*pixels.columns)


def project(pixels: DataFrame, transforms: DataFrame, fill: Column | None = None, by: tuple[str, ...] = ("frame_id", "ch"), tile: int = TILE) -> DataFrame:
    """Warp each frame by its affine transform (frame -> reference) with bilinear interpolation.

    transforms: frame_id, a..f (x' = a x + b y + c, y' = d x + e y + f), and width, height of the result.
    Each sample goes to the result tiles that it can touch (mostly one), so pixels are shuffled once;
    a tile without samples gets a row of its own and is filled.  A result pixel takes four source samples; it is
    filled where one of them is outside and NULL where one is missing.  A singular transform gives no rows.
    """
    by = list(by)
    t = transforms.where(F.abs(F.col("a") * F.col("e") - F.col("b") * F.col("d")) >= 1e-8).select("frame_id", "width", "height", *[F.col(k).cast("double").alias(f"__{k}") for k in "abcdef"])
    sizes = pixels.groupBy(*by).agg((F.max("x") + 1).alias("__sw"), (F.max("y") + 1).alias("__sh")).join(t, "frame_id")
    last = lambda n: F.floor((F.col(n) - 1) / tile)
    span = lambda v, r, n: F.sequence(F.greatest(F.floor((v - r) / tile), F.lit(0)), F.least(F.floor((v + r) / tile), last(n)))
    at_x = F.col("__a") * F.col("x") + F.col("__b") * F.col("y") + F.col("__c")
    at_y = F.col("__d") * F.col("x") + F.col("__e") * F.col("y") + F.col("__f")
    reach_x, reach_y = F.abs("__a") + F.abs("__b"), F.abs("__d") + F.abs("__e")
    touches = (at_x + reach_x >= 0) & (at_y + reach_y >= 0) & (at_x - reach_x < F.col("width")) & (at_y - reach_y < F.col("height"))
    samples = pixels.select(*by, "y", "x", F.col("v").cast("double").alias("v")).join(sizes, by).where(touches).withColumn("__tx", F.explode(span(at_x, reach_x, "width"))).withColumn("__ty", F.explode(span(at_y, reach_y, "height")))
    every = sizes.withColumn("__tx", F.explode(F.sequence(F.lit(0).cast("long"), last("width")))).withColumn("__ty", F.explode(F.sequence(F.lit(0).cast("long"), last("height"))))
    every = every.select(*by, F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("x"), F.lit(None).cast("double").alias("v"), *[c for c in samples.columns if c not in (*by, "y", "x", "v")])
    schema = ", ".join(f"`{c}` {pixels.schema[c].dataType.simpleString()}" for c in by) + ", y int, x int, v double, inside boolean"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        one = part.iloc[0]
        a, b, c, d, e, f = (float(one[f"__{k}"]) for k in "abcdef")
        tx, ty = int(key[-2]) * tile, int(key[-1]) * tile
        y, x = (g.ravel() for g in np.mgrid[ty : min(int(one["height"]), ty + tile), tx : min(int(one["width"]), tx + tile)])
        det = a * e - b * d
        sx, sy = (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det
        ix, iy = np.floor(sx + 1e-12).astype(np.int64), np.floor(sy + 1e-12).astype(np.int64)
        inside = (ix >= 0) & (ix + 1 < int(one["__sw"])) & (iy >= 0) & (iy + 1 < int(one["__sh"]))
        v = np.full(len(x), np.nan)
        have = part[part["x"].notna()]
        if len(have):
            hy, hx = have["y"].to_numpy(np.int64), have["x"].to_numpy(np.int64)
            y0, x0 = hy.min(), hx.min()
            block = np.full((hy.max() - y0 + 2, hx.max() - x0 + 2), np.nan)
            block[hy - y0, hx - x0] = have["v"].to_numpy(float)
            py, px = np.clip(iy - y0, 0, block.shape[0] - 2), np.clip(ix - x0, 0, block.shape[1] - 2)
            fy, fx = sy - iy, sx - ix
            v = (1 - fy) * ((1 - fx) * block[py, px] + fx * block[py, px + 1]) + fy * ((1 - fx) * block[py + 1, px] + fx * block[py + 1, px + 1])
        v = np.where(inside, v, np.nan)
        out = pd.DataFrame({"y": y.astype(np.int32), "x": x.astype(np.int32), "v": pd.array(np.nan_to_num(v), dtype="Float64"), "inside": inside})
        out.loc[np.isnan(v), "v"] = pd.NA
        for name, k in zip(by, key):
            out[name] = k
        return out[[*by, "y", "x", "v", "inside"]]

    warped = samples.unionByName(every).groupBy(*by, "__tx", "__ty").applyInPandas(run, schema)
    fill = F.lit(None).cast("double") if fill is None else fill
    return warped.select(*by, "y", "x", F.when(F.col("inside"), F.col("v")).otherwise(fill).alias("v"))


def star_mask(stars: DataFrame, sizes: DataFrame, factor: float = 1.0) -> DataFrame:
    """Discs of radius hfr * factor with value mass / (pi r^2), summed: frame_id, y, x, v (only covered pixels)."""
    r = F.col("hfr") * factor
    span = lambda c, n: F.sequence(F.greatest(F.ceil(F.col(c) - r), F.lit(0)).cast("int"), F.least(F.floor(F.col(c) + r), F.col(n) - 1).cast("int"))
    near = stars.join(sizes.select("frame_id", "width", "height"), "frame_id").where((F.col("x") + r >= 0) & (F.col("y") + r >= 0) & (F.col("x") - r <= F.col("width") - 1) & (F.col("y") - r <= F.col("height") - 1))
    cells = near.withColumn("py", F.explode(span("y", "height"))).withColumn("px", F.explode(span("x", "width")))
    inside = cells.where(F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2) <= r * r)
    return inside.groupBy("frame_id", F.col("py").alias("y"), F.col("px").alias("x")).agg(F.sum(F.col("mass") / (math.pi * r * r)).alias("v"))
