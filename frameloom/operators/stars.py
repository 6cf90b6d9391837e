"""Star catalogue: detection, overlap filter, half-flux radius, and the pickings alignment needs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STAR_COLUMNS = "frame_id int, rank int, idx int, value double, x double, y double, mass double, hfr double"


def bright_runs(pixels: DataFrame, location_scale: DataFrame, sigma: float, radius: int, by: tuple[str, ...] = ("frame_id", "ch")) -> DataFrame:
    """Bright pixels, v > location + sigma * scale, one for each run in a row.

    A run is a chain of bright pixels of which each is within `radius` of the one before it
    (gaps and islands); its brightest pixel stands for it, the leftmost of equal ones.
    """
    by = list(by)
    bright = pixels.join(location_scale.select(*by, "location", "scale"), by).where(F.col("v") > F.col("location") + sigma * F.col("scale")).select(*by, "y", "x", "v")
    along = Window.partitionBy(*by, "y").orderBy("x")
    run = bright.withColumn("__new", F.coalesce((F.col("x") - F.lag("x").over(along) > radius).cast("int"), F.lit(1))).withColumn("run", F.sum("__new").over(along))
    best = run.groupBy(*by, "y", "run").agg(F.max(F.struct("v", (-F.col("x")).alias("m"))).alias("b"))
    return best.select(*by, "y", (-F.col("b.m")).cast("int").alias("x"), F.col("b.v").alias("v"))


def overlap_filter(stars: DataFrame, radius: float) -> DataFrame:
    """Greedy by descending mass: a star stays if no kept star of its frame is within radius."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["mass", "y", "x"], ascending=[False, True, True], kind="stable")
        return part[kept_apart(part["x"].to_numpy(float), part["y"].to_numpy(float), radius)]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stars.schema)
    return stars.groupBy("frame_id").applyInPandas(run, schema)


def kept_apart(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """Mask of the points, in order of preference, that aren't within radius of an earlier kept one."""
    cell = max(float(radius), 1.0)
    grid: dict[tuple[int, int], list[int]] = {}
    keep = np.zeros(len(x), bool)
    for i in range(len(x)):
        cx, cy = int(x[i] // cell), int(y[i] // cell)
        near = (j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in grid.get((cx + a, cy + b), ()))
        if all(int((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 + 0.5) > radius * radius for j in near):
            keep[i] = True
            grid.setdefault((cx, cy), []).append(i)
    return keep


def _detect(image: np.ndarray, location: float, scale: float, radius: int, sigma: float, in_out: float, bad_sigma: float) -> list[tuple]:
    h, w = image.shape
    clean = np.where(np.isnan(image), location, image)
    threshold = location + sigma * scale
    candidates: list[tuple[float, int, int]] = []
    for y in np.flatnonzero((clean > threshold).any(axis=1)):
        last = None
        for x in np.flatnonzero(clean[y] > threshold):
            if last is not None and x - last[2] <= radius:
                if clean[y, x] > last[0]:
                    last = candidates[-1] = (clean[y, x], y, x)
            else:
                last = (clean[y, x], y, x)
                candidates.append(last)
    if bad_sigma > 0 and candidates:
        padded = np.pad(image, 1, constant_values=np.nan)
        near = np.stack([padded[1 + a : 1 + a + h, 1 + b : 1 + b + w] for a in (-1, 0, 1) for b in (-1, 0, 1)])
        d = image - np.nanmedian(near, axis=0)
        limit = bad_sigma * np.nanstd(d)
        candidates = [c for c in candidates if abs(d[c[1], c[2]]) < limit]

    def apart(stars: list[tuple]) -> list[tuple]:
        stars = sorted(stars, key=lambda s: (-s[0], s[1], s[2]))
        keep = kept_apart(np.array([s[2] for s in stars], float), np.array([s[1] for s in stars], float), radius)
        return [s for s, k in zip(stars, keep) if k]

    found = []
    floor = location + scale * sigma / 2
    for _, y, x in apart(candidates):
        cx, cy, mass = float(x), float(y), 0.0
        for _ in range(10):
            iy, ix = int(cy + 0.5), int(cx + 0.5)
            ys, xs = slice(max(0, iy - radius), min(h, iy + radius + 1)), slice(max(0, ix - radius), min(w, ix + radius + 1))
            box = np.maximum(clean[ys, xs] - floor, 0)
            mass = float(box.sum())
            if mass <= 0:
                break
            ny, nx = np.arange(ys.start, ys.stop) @ box.sum(axis=1) / mass, box.sum(axis=0) @ np.arange(xs.start, xs.stop) / mass
            moved = (ny - cy) ** 2 + (nx - cx) ** 2
            cy, cx = float(ny), float(nx)
            if moved <= 1e-4:
                break
        if mass > 0:
            found.append((mass, cy, cx))
    out = []
    for _, cy, cx in apart(found):
        iy, ix = min(h - 1, int(cy + 0.5)), min(w - 1, int(cx + 0.5))
        hfr, mass, inner, outer = half_flux(clean, iy, ix, radius, location)
        if hfr is None or hfr > radius:
            continue
        if inner is not None and not inner[0] * outer[1] > in_out * outer[0] * inner[1]:
            continue
        out.append((iy * w + ix, float(clean[iy, ix]), cx, cy, mass, hfr))
    return out


def half_flux(a: np.ndarray, iy: int, ix: int, radius: int, location: float):
    """(half-flux radius, flux, (inner flux, pixels), (outer flux, pixels)) in a disc about a pixel, values above location."""
    h, w = a.shape
    ys, xs = np.arange(max(0, iy - radius), min(h, iy + radius + 1)), np.arange(max(0, ix - radius), min(w, ix + radius + 1))
    d2 = (ys[:, None] - iy) ** 2 + (xs[None, :] - ix) ** 2
    disc = d2 <= math.ceil(radius * radius)
    v = np.where(disc, np.maximum(a[np.ix_(ys, xs)] - location, 0), 0)
    mass = float(v.sum())
    if mass <= 0:
        return None, 0.0, None, None
    d = np.sqrt(d2)
    hfr = float((d * v).sum() / mass)
    inside = disc & (d <= hfr)
    outside = disc & ~inside
    return hfr, mass, (float(v[inside].sum()), int(inside.sum())), (float(v[outside].sum()), int(outside.sum()))


def detect(pixels: DataFrame, location_scale: DataFrame, radius: int = 16, sigma: float = 10.0, in_out: float = 10.0, bad_sigma: float = 0.0, ch: int = 0) -> DataFrame:
    """Stars of each frame (STAR_COLUMNS), brightest first.  One task a frame, for one channel.

    location_scale: frame_id, location, scale.
    """
    one = pixels.where(F.col("ch") == ch).select(F.col("frame_id").cast("int"), "y", "x", F.coalesce(F.col("v").cast("double"), F.lit(float("nan"))).alias("v"))
    lines = one.groupBy("frame_id", "y").agg(F.collect_list("x").alias("xs"), F.collect_list("v").alias("vs"))  # a row a line: a task holds little more than the image
    known = lines.join(location_scale.select(F.col("frame_id").cast("int"), "location", "scale"), "frame_id")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        image = np.full((int(part["y"].max()) + 1, max(int(np.max(x)) for x in part["xs"]) + 1), np.nan)
        for y, xs, vs in zip(part["y"], part["xs"], part["vs"]):
            image[y, xs] = vs
        found = _detect(image, float(part["location"].iloc[0]), float(part["scale"].iloc[0]), radius, sigma, in_out, bad_sigma)
        found.sort(key=lambda s: (-s[4], s[0]))
        return pd.DataFrame([(key[0], i + 1, *s) for i, s in enumerate(found)], columns=[c.split()[0] for c in STAR_COLUMNS.split(", ")])

    return known.groupBy("frame_id").applyInPandas(run, STAR_COLUMNS)


def summary(stars: DataFrame) -> DataFrame:
    """frame_id, n_stars, hfr (mean)."""
    return stars.groupBy("frame_id").agg(F.count("*").cast("int").alias("n_stars"), F.avg("hfr").alias("hfr"))


def half_flux_radius(pixels: DataFrame, centres: DataFrame, location: DataFrame, radius: int, by: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """by, star, hfr, mass of given centres (by..., star, y, x) as one offset join and sums."""
    by = list(by)
    offsets = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    table = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(math.sqrt(dy * dy + dx * dx)).alias("d")) for dy, dx in offsets])
    asks = centres.select(*by, "star", "y", "x", F.explode(table).alias("o")).select(*by, "star", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("o.d").alias("d"))
    v = F.greatest(F.col("v") - F.col("location"), F.lit(0.0))
    found = asks.join(pixels.select(*by, "y", "x", "v"), [*by, "y", "x"]).join(location.select(*by, "location"), by)
    return found.groupBy(*by, "star").agg((F.sum(F.col("d") * v) / F.nullif(F.sum(v), F.lit(0.0))).alias("hfr"), F.sum(v).alias("mass"))


def brightest(stars: DataFrame, k: int | None, by: tuple[str, ...] = ("frame_id",), order: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """The k stars of most mass in each frame (all for None), rank from 1; ties go by the `order` columns."""
    w = Window.partitionBy(*by).orderBy(F.col("mass").desc(), *order)
    ranked = stars.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def brightest_distant(stars: DataFrame, k: int, least_distance: float, schema: str | None = None) -> DataFrame:
    """Up to k brightest stars of each frame that are at least least_distance apart."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["mass", "y", "x"], ascending=[False, True, True], kind="stable")
        return part[kept_apart(part["x"].to_numpy(float), part["y"].to_numpy(float), least_distance)].head(k)

    return stars.groupBy("frame_id").applyInPandas(run, schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stars.schema))


def csv_lines(found: DataFrame) -> DataFrame:
    """frame_id, line_no, line: each frame's stars as CSV, a header line (number 0) first."""
    head = found.select("frame_id").distinct().select("frame_id", F.lit(0).alias("line_no"), F.lit("Index,Value,X,Y,Mass,HFR").alias("line"))
    rows = found.select("frame_id", F.col("rank").cast("int").alias("line_no"), F.concat_ws(",", *[F.col(c).cast("string") for c in ("idx", "value", "x", "y", "mass", "hfr")]).alias("line"))
    return head.unionByName(rows)


def cell_binning(stars: DataFrame, sizes: DataFrame, grid: int, hfr_factor: float = 4.0) -> DataFrame:
    """frame_id, cy, cx, n_stars: stars whose 3x3 footprint at hfr * hfr_factor touches a cell."""
    r = F.col("hfr") * hfr_factor
    points = F.array(*[F.struct((F.col("x") + r * dx).alias("px"), (F.col("y") + r * dy).alias("py")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    near = stars.join(sizes.select("frame_id", "width", "height"), "frame_id").withColumn("star", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.col("mass").desc(), "x", "y")))
    cell = lambda p, n: F.floor(F.least(F.greatest(p, F.lit(0.0)), F.col(n) - 1.0) / (F.col(n) / F.greatest(F.floor((F.col(n) + grid // 2) / grid), F.lit(1)))).cast("int")
    spread = near.select("frame_id", "star", "width", "height", F.explode(points).alias("p"))
    touched = spread.select("frame_id", "star", cell(F.col("p.py"), "height").alias("cy"), cell(F.col("p.px"), "width").alias("cx")).distinct()
    return touched.groupBy("frame_id", "cy", "cx").agg(F.count("*").alias("n_stars"))
