"""Colour operators.

A colour frame is "wide": one row a position with columns c0, c1, c2 (R, G, B, or H, S, L), made once
by a pivot; all colour operators are then projections without a shuffle.  ``wide`` and
``planar`` convert.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colors as C
from . import pixelmath as P

CHANNELS = ("c0", "c1", "c2")


def wide(pixels: DataFrame, by: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """(by, y, x, c0, c1, c2) from planar pixels with ch 0, 1, 2: one aggregation."""
    return pixels.groupBy(*by, "y", "x").agg(*[F.max(F.when(F.col("ch") == i, F.col("v"))).alias(c) for i, c in enumerate(CHANNELS)])


def planar(colour: DataFrame) -> DataFrame:
    keep = [c for c in colour.columns if c not in CHANNELS]
    return colour.select(*keep, F.explode(F.array(*[F.struct(F.lit(i).alias("ch"), F.col(c).alias("v")) for i, c in enumerate(CHANNELS)])).alias("p")).select(*keep, "p.ch", "p.v")


def rgb_combine(pixels: DataFrame, by: tuple[str, ...] = ("session",)) -> DataFrame:
    """Channels (ch 0..2) of each `by` group to one colour frame in [0, 1], scaled by their common minimum and maximum."""
    by = list(by)
    span = pixels.where(F.col("ch") < 3).groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = lambda c: F.when(F.col("hi") > F.col("lo"), (F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    joined = wide(pixels.where(F.col("ch") < 3), tuple(by)).join(span, by)
    return joined.select(*by, "y", "x", *[F.when(F.col(c).isNotNull(), scaled(c)).alias(c) for c in CHANNELS])


def darkest_block(colour: DataFrame, block: int = 16, border: float = 0.1, by: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Mean colour (m0, m1, m2) of the aligned block inside the border with the least mean; the first of equal ones."""
    by = list(by)
    sizes = colour.groupBy(*by).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    placed = colour.join(sizes, by).withColumn("by", F.floor(F.col("y") / block)).withColumn("bx", F.floor(F.col("x") / block))
    inside = (F.col("by") * block >= F.col("h") * border) & ((F.col("by") + 1) * block <= F.col("h") * (1 - border)) & (F.col("bx") * block >= F.col("w") * border) & ((F.col("bx") + 1) * block <= F.col("w") * (1 - border))
    means = placed.where(inside).groupBy(*by, "by", "bx").agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(CHANNELS)])
    best = means.groupBy(*by).agg(F.min(F.struct(((F.col("m0") + F.col("m1") + F.col("m2")) / 3).alias("score"), "by", "bx", "m0", "m1", "m2")).alias("b"))
    return best.select(*by, "b.by", "b.bx", "b.m0", "b.m1", "b.m2")


def star_colour(colour: DataFrame, stars: DataFrame, skip_bright: float = 0.0, skip_dim: float = 0.75, by: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Mean colour (s0, s1, s2) in discs of 0.75 HFR about stars, the brightest and dimmest shares left out.

    A pixel counts if all its channels are under 0.9 of their channel's maximum.
    """
    from pyspark.sql import Window

    by = list(by)
    w = Window.partitionBy(*by).orderBy(F.col("mass").desc(), "x", "y")
    n = F.count("*").over(Window.partitionBy(*by))
    chosen = stars.withColumn("__r", F.row_number().over(w) - 1).withColumn("__n", n).where((F.col("__r") >= F.floor(F.col("__n") * skip_bright)) & (F.col("__r") < F.col("__n") - F.floor(F.col("__n") * skip_dim)))
    r = F.col("hfr") * 0.75
    iy, ix = F.floor(F.col("y") + 0.5), F.floor(F.col("x") + 0.5)
    reach = F.floor(r)
    cells = chosen.select(*by, "__r", iy.alias("iy"), ix.alias("ix"), r.alias("r"), F.explode(F.sequence(-reach, reach)).alias("dy"), F.sequence(-reach, reach).alias("dxs")).withColumn("dx", F.explode("dxs"))
    discs = cells.where(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx") <= F.col("r") * F.col("r")).select(*by, (F.col("iy") + F.col("dy")).cast("int").alias("y"), (F.col("ix") + F.col("dx")).cast("int").alias("x"))
    top = colour.groupBy(*by).agg(*[F.max(c).alias(f"t{i}") for i, c in enumerate(CHANNELS)])
    joined = discs.join(colour, [*by, "y", "x"]).join(top, by)
    free = (F.col("c0") < 0.9 * F.col("t0")) & (F.col("c1") < 0.9 * F.col("t1")) & (F.col("c2") < 0.9 * F.col("t2"))
    return joined.where(free).groupBy(*by).agg(*[F.avg(c).alias(f"s{i}") for i, c in enumerate(CHANNELS)])


def balance(colour: DataFrame, shadows: DataFrame, highlights: DataFrame, tint_low: tuple[float, float, float] = (1, 1, 1), tint_high: tuple[float, float, float] = (1, 1, 1), by: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Affine map of each channel that takes shadows (m0..m2) and highlights (s0..s2) to tints of their means; clamped to [0, 1]."""
    by = list(by)
    joined = colour.join(shadows.select(*by, "m0", "m1", "m2"), by).join(highlights.select(*by, "s0", "s1", "s2"), by)
    lo_mean, hi_mean = (F.col("m0") + F.col("m1") + F.col("m2")) / 3, (F.col("s0") + F.col("s1") + F.col("s2")) / 3
    out = []
    for i, c in enumerate(CHANNELS):
        lo, hi, want_lo, want_hi = F.col(f"m{i}"), F.col(f"s{i}"), lo_mean * tint_low[i], hi_mean * tint_high[i]
        alpha = F.when(hi != lo, (want_hi - want_lo) / (hi - lo)).otherwise(1.0)
        out.append(F.least(F.greatest(alpha * F.col(c) + (want_lo - alpha * lo), F.lit(0.0)), F.lit(1.0)).alias(c))
    return joined.select(*[F.col(c) for c in colour.columns if c not in CHANNELS], *out)


def rgb_balance(colour: DataFrame, location_scale: DataFrame, stars: DataFrame, block: int = 16, border: float = 0.1, skip_bright: float = 0.0, skip_dim: float = 0.75, shadows: tuple[float, float, float] = (1, 1, 1), highlights: tuple[float, float, float] = (1, 1, 1), by: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Two passes: equal location and location + 3 scale of the channels; then darkest block and mean star colour.

    location_scale: by..., ch, location, scale.
    """
    by_ = list(by)
    stat = location_scale.groupBy(*by_).agg(*[F.max(F.when(F.col("ch") == i, F.col("location"))).alias(f"m{i}") for i in range(3)], *[F.max(F.when(F.col("ch") == i, F.col("location") + 3 * F.col("scale"))).alias(f"s{i}") for i in range(3)])
    first = balance(colour, stat, stat, by=by)
    return balance(first, darkest_block(first, block, border, by), star_colour(first, stars, skip_bright, skip_dim, by), shadows, highlights, by)


def _dot(m: np.ndarray, *columns: Column) -> list[Column]:
    return [sum((float(k) * c for k, c in zip(row[1:], columns[1:])), float(row[0]) * columns[0]) for row in m]


def _staged(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    """One projection after another, so that each expression is evaluated once."""
    for stage in stages:
        df = df.withColumns(stage)
    return df


def _most_chroma(l: Column, h: Column, sub: Column) -> Column:
    """Largest chroma inside the sRGB gamut, the nearest of six straight bounds; NULL if there is none."""
    t, bounds = F.radians(h), []
    for m1, m2, m3 in C.XYZ_TO_RGB.tolist():
        for edge in (0, 1):
            top1 = (284517 * m1 - 94839 * m3) * sub
            top2 = (838422 * m3 + 769860 * m2 + 731718 * m1) * 100 * l * sub - 769860.0 * edge * 100 * l
            bottom = (632260 * m3 - 126452 * m2) * sub + 126452.0 * edge
            length = F.try_divide(F.try_divide(top2, bottom), F.sin(t) - F.try_divide(top1, bottom) * F.cos(t))
            bounds.append(F.when(length >= 0, length))
    return F.least(*bounds) / 100


def _sub(l: Column) -> Column:
    cube = F.pow(100 * l + 16, F.lit(3.0)) / 1560896
    return F.when(cube > C.EPSILON, cube).otherwise(100 * l / C.KAPPA)


def _extreme(l: Column) -> Column:
    return (l > 0.9999999) | (l < 1e-8)


def rgb_to_hsluv(colour: DataFrame) -> DataFrame:
    """Hue in degrees, saturation and lightness in [0, 1], by closed formulas."""
    g = lambda k: F.col(f"__hsl_{k}")
    x, y, z = _dot(C.RGB_TO_XYZ, *[F.col(c).cast("double") for c in CHANNELS])
    out = _staged(
        colour,
        {"__hsl_x": x, "__hsl_y": y, "__hsl_z": z},
        {"__hsl_l": lightness(g("y")), "__hsl_d": g("x") + 15 * g("y") + 3 * g("z")},
        {"__hsl_u": F.when(g("d") > 0, 13 * g("l") * (4 * g("x") / g("d") - float(C._UN))).otherwise(0.0), "__hsl_v": F.when(g("d") > 0, 13 * g("l") * (9 * g("y") / g("d") - float(C._VN))).otherwise(0.0)},
        {"__hsl_c": F.hypot(g("u"), g("v")), "__hsl_h": F.pmod(F.degrees(F.atan2(g("v"), g("u"))), F.lit(360.0)), "__hsl_s": _sub(g("l"))},
        {"__hsl_m": _most_chroma(g("l"), g("h"), g("s"))},
    )
    rest = [c for c in colour.columns if c not in CHANNELS]
    known = g("l").isNotNull()
    saturation = F.when(_extreme(g("l")), 0.0).otherwise(F.coalesce(F.try_divide(g("c"), g("m")), F.lit(0.0)))
    return out.select(*rest, F.when(known, g("h")).alias("c0"), F.when(known, saturation).alias("c1"), g("l").alias("c2"))


def hsluv_to_rgb(colour: DataFrame) -> DataFrame:
    """Inverse; a colour with a component over 1 is divided by it, which keeps its hue."""
    g = lambda k: F.col(f"__hsl_{k}")
    h, s, l = (F.col(c).cast("double") for c in CHANNELS)
    red, green, blue = _dot(C.XYZ_TO_RGB, g("x"), g("y"), g("z"))
    ratio = lambda v, white: F.when(l > 0, v / F.when(l > 0, 13 * l)).otherwise(0.0) + float(white)
    out = _staged(
        colour,
        {"__hsl_s": _sub(l)},
        {"__hsl_c": F.when(_extreme(l), 0.0).otherwise(_most_chroma(l, h, g("s")) * s), "__hsl_y": F.when(l > 0.08, F.pow((l + 0.16) / 1.16, F.lit(3.0))).otherwise(l * 100 / C.KAPPA)},
        {"__hsl_p": ratio(g("c") * F.cos(F.radians(h)), C._UN), "__hsl_q": ratio(g("c") * F.sin(F.radians(h)), C._VN)},
        {"__hsl_x": F.try_divide(g("y") * 9 * g("p"), 4 * g("q")), "__hsl_z": F.try_divide(g("y") * (12 - 3 * g("p") - 20 * g("q")), 4 * g("q"))},
        {f"__hsl_r{i}": F.when(l <= 0, 0.0).otherwise(c) for i, c in enumerate((red, green, blue))},
        {"__hsl_t": F.greatest(g("r0"), g("r1"), g("r2"), F.lit(1.0))},
    )
    rest = [c for c in colour.columns if c not in CHANNELS]
    return out.select(*rest, *[(g(f"r{i}") / g("t")).alias(c) for i, c in enumerate(CHANNELS)])


def scnr(hsl: DataFrame, factor: float = 0.0) -> DataFrame:
    """Green reduction in RGB: factor * min(g, (r + b) / 2) + (1 - factor) * g; lightness is kept."""
    if factor == 0:
        return hsl
    rgb = hsluv_to_rgb(hsl.withColumn("__scnr_l", F.col("c2")))
    less = factor * F.least(F.col("c1"), (F.col("c0") + F.col("c2")) / 2) + (1 - factor) * F.col("c1")
    return rgb_to_hsluv(rgb.withColumn("c1", less)).withColumn("c2", F.col("__scnr_l")).select(*hsl.columns)


def apply_luminance(hsl: DataFrame, luminance: DataFrame | None, on: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Overwrite L by the HSLuv lightness of a luminance frame (on..., v), normalised to [0, 1]."""
    if luminance is None:
        return hsl
    keys = [c for c in on if c not in ("y", "x")]
    span = luminance.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    known = luminance.join(span, keys) if keys else luminance.crossJoin(F.broadcast(span))  # span is one row
    y = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("v"))
    return hsl.join(known.select(*on, lightness(y).alias("__l")), list(on), "left").withColumn("c2", F.coalesce("__l", "c2")).select(*hsl.columns)


def lightness(y: Column) -> Column:
    """HSLuv lightness of a linear grey value."""
    return F.when(y > C.EPSILON, 1.16 * F.cbrt(y) - 0.16).otherwise(y * C.KAPPA / 100)


def scale_offset_channel(hsl: DataFrame, ch: int = 2, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    if scale == 1 and offset == 0:
        return hsl
    return hsl.withColumn(CHANNELS[ch], F.col(CHANNELS[ch]) * scale + offset)


def offset_rgb(colour: DataFrame, r: float = 0.0, g: float = 0.0, b: float = 0.0) -> DataFrame:
    return colour.withColumns({c: F.col(c) + o for c, o in zip(CHANNELS, (r, g, b))})


def scale_rgb(colour: DataFrame, r: float = 1.0, g: float = 1.0, b: float = 1.0) -> DataFrame:
    """Channels times factors, at most 1."""
    return colour.withColumns({c: F.least(F.col(c) * k, F.lit(1.0)) for c, k in zip(CHANNELS, (r, g, b))})


def _threshold(hsl: DataFrame, location_scale: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return hsl.join(location_scale.select(*by, F.col("location").alias("__loc"), F.col("scale").alias("__sc")), list(by))


def neutralize_background(hsl: DataFrame, low_sigma: float, high_sigma: float, location_scale: DataFrame, by: tuple[str, ...] = ("frame_id",), strict_compat: bool = False) -> DataFrame:
    """S is 0 where L is below location + low * scale and whole above location + high * scale, with a ramp between.

    strict_compat makes it a hard step at the low threshold.
    """
    if low_sigma <= 0 and high_sigma <= 0:
        return hsl
    lo, hi = F.col("__loc") + low_sigma * F.col("__sc"), F.col("__loc") + (low_sigma if strict_compat else high_sigma) * F.col("__sc")
    l = F.col("c2")
    s = F.when(l < lo, 0.0).when(l >= hi, F.col("c1")).otherwise(F.col("c1") * (l - lo) / (hi - lo))
    return _threshold(hsl, location_scale, by).withColumn("c1", s).select(*hsl.columns)


def saturation_gamma(hsl: DataFrame, gamma: float, sigma: float, location_scale: DataFrame, by: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    if gamma == 1:
        return hsl
    s = F.when(F.col("c2") >= F.col("__loc") + sigma * F.col("__sc"), P.power(F.col("c1"), gamma)).otherwise(F.col("c1"))
    return _threshold(hsl, location_scale, by).withColumn("c1", s).select(*hsl.columns)


def _hue_in(start: float, end: float) -> Column:
    h = F.col("c0")
    return (h > start) & (h < end) if start <= end else (h > start) | (h < end)


def selective_saturation(hsl: DataFrame, start: float = 295.0, end: float = 40.0, factor: float = 1.0) -> DataFrame:
    """S times factor, clamped to [0, 1], for hues in the open range (past 360 if start > end)."""
    if factor == 1:
        return hsl
    return hsl.withColumn("c1", F.when(_hue_in(start, end), F.least(F.greatest(F.col("c1") * factor, F.lit(0.0)), F.lit(1.0))).otherwise(F.col("c1")))


def rotate_hue(hsl: DataFrame, start: float, end: float, offset: float, sigma: float, location_scale: DataFrame, by: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Hue plus offset (not reduced modulo 360) for hues in the open range where L >= location + sigma * scale."""
    if offset == 0:
        return hsl
    h = F.when(_hue_in(start, end) & (F.col("c2") >= F.col("__loc") + sigma * F.col("__sc")), F.col("c0") + offset).otherwise(F.col("c0"))
    return _threshold(hsl, location_scale, by).withColumn("c0", h).select(*hsl.columns)


def on_lightness(hsl: DataFrame, op, *args, **kwargs) -> DataFrame:
    """Apply a pixel operator (stretch, midtones, gamma, gamma_pp, scale_black, ...) to L alone."""
    return op(hsl.withColumnRenamed("c2", "v"), *args, **kwargs).withColumnRenamed("v", "c2").select(*hsl.columns)


def hsl_scale_black(hsl: DataFrame, target: float, location_scale: DataFrame, by: list[str] | None = None) -> DataFrame:
    """scale_black on L; the target is a linear value."""
    return hsl if target == 0 else on_lightness(hsl, P.scale_black, float(C.lightness(np.array(target))), location_scale, by)
