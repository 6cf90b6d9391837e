"""Element-wise pixel operators: projections, and joins with one row of statistics a frame.

`by` names what a frame's statistics are taken over, ["frame_id"] or ["frame_id", "ch"].  A
statistics table has one row a frame, so joining it back is small against the pixels; it isn't
hinted, Spark broadcasts it if its size allows.  Neutral parameters return the input itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats as S

V = "v"


def calibrate(pixels: DataFrame, dark: DataFrame | None = None, flat: DataFrame | None = None, on: tuple[str, ...] = ("ch", "y", "x")) -> DataFrame:
    """(v - dark) * max(flat) / flat; where flat is missing or not positive, or dark missing, that step is left out.

    dark and flat hold one frame each (or one for each value of further columns in `on`): on..., v.
    """
    out = pixels
    group = [c for c in on if c not in ("ch", "y", "x")]
    if dark is not None:
        out = out.join(dark.select(*on, F.col(V).alias("__d")), list(on), "left").withColumn(V, F.col(V) - F.coalesce("__d", F.lit(0.0))).drop("__d")
    if flat is not None:
        most = flat.groupBy(*group).agg(F.max(V).alias("__m")) if group else flat.agg(F.max(V).alias("__m"))
        known = flat.select(*on, F.col(V).alias("__f"))
        known = known.join(most, group) if group else known.crossJoin(F.broadcast(most))  # most is one row
        out = out.join(known, list(on), "left").withColumn(V, F.when(F.col("__f") > 0, F.col(V) * F.col("__m") / F.col("__f")).otherwise(F.col(V))).drop("__f", "__m")
    return out.select(*pixels.columns)


def scale_offset(pixels: DataFrame, scale: float = 1.0, offset: float = 0.0, where: Column | None = None) -> DataFrame:
    if scale == 1 and offset == 0:
        return pixels
    new = F.col(V) * scale + offset
    return pixels.withColumn(V, new if where is None else F.when(where, new).otherwise(F.col(V)))


def _with(pixels: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    return pixels.join(table, by)


def norm_range(pixels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each frame to [0, 1] by its own minimum and maximum; a uniform frame stays as it is."""
    by = by or ["frame_id"]
    span = pixels.groupBy(*by).agg(F.min(V).alias("__lo"), F.max(V).alias("__hi"))
    wide = F.col("__hi") - F.col("__lo") >= 1e-8
    return _with(pixels, span, by).withColumn(V, F.when(wide, (F.col(V) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.col(V))).select(*pixels.columns)


def power(v: Column, gamma: float) -> Column:
    """v ** (1 / gamma); not positive values become 0."""
    return F.when(v > 0, F.pow(v, F.lit(1.0 / gamma))).when(v.isNotNull(), 0.0)


def gamma(pixels: DataFrame, g: float = 1.0, where: Column | None = None) -> DataFrame:
    if g == 1:
        return pixels
    new = power(F.col(V), g)
    return pixels.withColumn(V, new if where is None else F.when(where, new).otherwise(F.col(V)))


def gamma_pp(pixels: DataFrame, g: float, sigma: float, location_scale: DataFrame, by: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Gamma only between location + sigma * scale and 1, that range mapped to [0, 1] and back."""
    if g == 1:
        return pixels
    by = by or ["frame_id"]
    start = F.col("location") + sigma * F.col("scale")
    v = F.col(V)
    new = F.when((v > start) & (v < 1), start + power((v - start) / (1 - start), g) * (1 - start)).otherwise(v)
    return _with(pixels, location_scale.select(*by, "location", "scale"), by).withColumn(V, new if where is None else F.when(where, new).otherwise(v)).select(*pixels.columns)


def midtones_curve(v: Column, mid: float, black: Column, strict_compat: bool = False) -> Column:
    """Midtones transfer function after the black point: 0 below it, 1 above 1.

    strict_compat: a value under the black point is set to 0 before the black point is taken off, so that it may end below 0.
    """
    if strict_compat:
        u = (F.when(v < black, 0.0).when(v.isNotNull(), v) - black) / (1 - black)
        return (mid - 1) * u / ((2 * mid - 1) * u - mid)
    u = F.greatest((v - black) / (1 - black), F.lit(0.0))
    return F.when(u > 1, 1.0).when(u <= 0, 0.0).when(v.isNotNull(), (mid - 1) * u / ((2 * mid - 1) * u - mid))


def midtones(pixels: DataFrame, mid: float, black_sigma: float, location_scale: DataFrame, by: list[str] | None = None, where: Column | None = None, strict_compat: bool = False) -> DataFrame:
    """Midtones stretch with the black point at location - black_sigma * scale."""
    if mid == 0:
        return pixels
    by = by or ["frame_id"]
    new = midtones_curve(F.col(V), mid, F.col("location") - black_sigma * F.col("scale"), strict_compat)
    return _with(pixels, location_scale.select(*by, "location", "scale"), by).withColumn(V, new if where is None else F.when(where, new).otherwise(F.col(V))).select(*pixels.columns)


def scale_black(pixels: DataFrame, target: float, location_scale: DataFrame, by: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Move the black point so that the location becomes `target`; frames at or below it stay."""
    if target == 0:
        return pixels
    by = by or ["frame_id"]
    black = (F.lit(target) - F.col("location")) / (F.lit(target) - 1)
    new = F.when(F.col("location") > target, F.greatest((F.col(V) - black) / (1 - black), F.lit(0.0))).otherwise(F.col(V))
    new = F.when(F.col(V).isNotNull(), new)
    return _with(pixels, location_scale.select(*by, "location"), by).withColumn(V, new if where is None else F.when(where, new).otherwise(F.col(V))).select(*pixels.columns)


def black_white(pixels: DataFrame, black: float, white: float, by: list[str] | None = None, bins: int = 65536) -> DataFrame:
    """Linear stretch to [0, 1] that clips at most `black` percent of a frame's values at 0 and `white` percent at 1.

    The two points are centres of histogram bins: the first one, from below and from above, with more values up to it.
    """
    by = by or ["frame_id"]
    h = S.histogram(pixels, by, bins, 0.0)
    width = (F.col("hi") - F.col("lo")) / (bins - 1)
    total = F.sum("n").over(Window.partitionBy(*by))  # bins of a frame, not pixels
    upto, down = (F.sum("n").over(Window.partitionBy(*by).orderBy(o)) for o in (F.col("bin"), F.col("bin").desc()))
    run = h.withColumn("low", upto > F.floor(black * 0.01 * total)).withColumn("high", down > F.floor(white * 0.01 * total))
    points = run.groupBy(*by, "lo", "hi").agg(F.min(F.when(F.col("low"), F.col("bin"))).alias("b"), F.max(F.when(F.col("high"), F.col("bin"))).alias("w"))
    at = lambda c: F.col("lo") + (F.col(c) + 0.5) * width
    scaled = F.when(F.col("__w") != F.col("__b"), F.least(F.greatest((F.col(V) - F.col("__b")) / (F.col("__w") - F.col("__b")), F.lit(0.0)), F.lit(1.0))).otherwise((F.col(V) > F.col("__b")).cast("double"))
    return _with(pixels, points.select(*by, at("b").alias("__b"), at("w").alias("__w")), by).withColumn(V, F.when(F.col(V).isNotNull(), scaled)).select(*pixels.columns)


def stretch(pixels: DataFrame, location: float = 0.1, scale: float = 0.004, by: list[str] | None = None, estimator: int = S.Estimator.MEDIAN_MAD, most_rounds: int = 50, where: Column | None = None) -> DataFrame:
    """Iterative stretch of every frame until location and scale reach the targets.

    Each round looks at one row of statistics a frame.  A frame at or below 1.01 times the
    location target but below the scale target takes the gamma in [1, 5] (steps of 0.01) that
    brings its scale nearest after the black shift; one above 0.99 times the location and below the scale has its
    black point moved; others are finished.  The steps found are kept as a list a frame and
    applied in one projection, so the plan doesn't grow with the rounds, and pixels are read once a round.
    """
    if location == 0 and scale == 0:
        return pixels
    by = by or ["frame_id"]
    spark = pixels.sparkSession
    base = pixels if where is None else pixels.where(where)
    schema = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in by) + ", steps array<struct<g:double,black:double>>"
    steps: dict[tuple, list[tuple[float, float]]] = {}
    todo = None
    for _ in range(most_rounds):
        now = base if not steps else _stepped(base, spark.createDataFrame([(*k, s) for k, s in steps.items()], schema), by)
        if todo is not None:
            now = now.join(spark.createDataFrame([k for k in todo], schema.rsplit(", ", 1)[0]), by, "left_semi")
        found = S.location_scale(now, by, estimator).collect()  # one row a frame that isn't finished
        todo = []
        for r in found:
            key = tuple(r[c] for c in by)
            loc, sc = r["location"], r["scale"]
            if loc is None or sc is None or not 0 < loc < 1:
                continue
            if loc <= 1.01 * location and sc < scale:
                g = min((1 + i / 100 for i in range(401)), key=lambda g: abs(_scale_after(loc, sc, g, location) - scale))
                if g <= 1.01:
                    continue
                after = loc ** (1 / g)
                steps.setdefault(key, []).append((g, _black(after, location)))
            elif loc > 0.99 * location and sc < scale and abs(loc - location) > 0.001 * location:
                steps.setdefault(key, []).append((1.0, _black(loc, location)))
            else:
                continue
            todo.append(key)
        if not todo:
            break
    if not steps:
        return pixels
    return _stepped(pixels, spark.createDataFrame([(*k, s) for k, s in steps.items()], schema), by, where)


def _black(before: float, after: float) -> float:
    return (after - before) / (after - 1) if before > after else 0.0


def _scale_after(loc: float, sc: float, g: float, target: float) -> float:
    """First-order scale after gamma and black shift."""
    return sc * (1 / g) * loc ** (1 / g - 1) / (1 - _black(loc ** (1 / g), target))


def _stepped(pixels: DataFrame, steps: DataFrame, by: list[str], where: Column | None = None) -> DataFrame:
    one = lambda v, s: F.when(v > 0, F.greatest((F.pow(v, 1 / s["g"]) - s["black"]) / (1 - s["black"]), F.lit(0.0))).otherwise(F.greatest(-s["black"] / (1 - s["black"]), F.lit(0.0)))
    new = F.when(F.col("steps").isNull() | F.col(V).isNull(), F.col(V).cast("double")).otherwise(F.aggregate("steps", F.col(V).cast("double"), one))
    return pixels.join(steps, by, "left").withColumn(V, new if where is None else F.when(where, new).otherwise(F.col(V))).select(*pixels.columns)


def match_histogram(pixels: DataFrame, mode: int, location_scale: DataFrame, reference: DataFrame, by: list[str] | None = None, on: list[str] | None = None) -> DataFrame:
    """Match each frame to the reference (one row, or one for each value of `on`: ref_location, ref_scale).

    Modes: 0 none; 1 multiply by the ratio of locations; 2 scale and offset to equal location and
    scale; 3 shift the black point to equal location.
    """
    if mode == 0:
        return pixels
    by, on = by or ["frame_id"], on or []
    known = location_scale.join(reference, on) if on else location_scale.crossJoin(F.broadcast(reference))  # reference is one row
    joined = _with(pixels, known.select(*by, "location", "scale", "ref_location", "ref_scale"), by)
    v = F.col(V)
    if mode == 1:
        new = F.when(F.col("location") != 0, v * F.col("ref_location") / F.col("location")).otherwise(v)
    elif mode == 2:
        k = F.when(F.col("scale") != 0, F.col("ref_scale") / F.col("scale")).otherwise(1.0)
        new = (v - F.col("location")) * k + F.col("ref_location")
    elif mode == 3:
        black = (F.col("ref_location") - F.col("location")) / (F.col("ref_location") - 1)
        new = F.greatest((v - black) / (1 - black), F.lit(0.0))
    else:
        raise ValueError("mode is 0 to 3")
    return joined.withColumn(V, F.when(v.isNotNull(), new)).select(*pixels.columns)


def filter_frames(frames: DataFrame, pixels: DataFrame, min_stars: int) -> tuple[DataFrame, DataFrame]:
    """Frames with at least min_stars stars, and their pixels."""
    if min_stars <= 0:
        return frames, pixels
    kept = frames.where(F.col("n_stars") >= min_stars)
    return kept, pixels.join(kept.select("frame_id"), "frame_id", "left_semi")
