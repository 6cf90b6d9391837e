"""Alignment: triangles of bright stars, nearest neighbours, an affine fit.

Catalogues are small beside pixels: at most K stars a frame make triangles.  The nearest star is an
equi-join on grid cells (a star can only match within `radius`), the nearest triangle a search among those of
one reference frame; neither is a product of two catalogues.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stars as ST

TRIANGLES = "frame_id int, a int, b int, c int, ab double, ac double, bc double"


def triangles(stars: DataFrame, by: tuple[str, ...] = ("frame_id",), star: str = "rank") -> DataFrame:
    """Triples with |AB| < |AC| < |BC|: by, a, b, c (star numbers), ab, ac, bc.

    An inequality self-join within each frame's few chosen stars; equal sides give no triangle.
    """
    by = list(by)
    side = lambda s: stars.select(*by, F.col(star).alias(s), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    d = lambda p, q: F.sqrt(F.pow(F.col(f"{p}x") - F.col(f"{q}x"), 2) + F.pow(F.col(f"{p}y") - F.col(f"{q}y"), 2))
    pairs = side("a").join(side("b"), by).where("a <> b").withColumn("ab", d("a", "b"))
    triples = pairs.join(side("c"), by).where("c <> a AND c <> b").withColumn("ac", d("a", "c")).withColumn("bc", d("b", "c"))
    return triples.where("ab < ac AND ac < bc").select(*by, "a", "b", "c", "ab", "ac", "bc")


def nearest_triangle(mine: DataFrame, reference: DataFrame, by: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """For each triangle the nearest reference triangle by side lengths, however far: by, a, b, c, ra, rb, rc, d2.

    Ties go to the least (ra, rb, rc).  The reference is one frame's triangles, at most those of K chosen stars, so every
    task gets them all; mine is read once, without a shuffle.
    """
    by = list(by)
    ref = reference.select("a", "b", "c", "ab", "ac", "bc").toPandas().sort_values(["ab", "a", "b", "c"], kind="stable")  # of K stars of one frame
    numbers, sides = ref[["a", "b", "c"]].to_numpy(np.int64), ref[["ab", "ac", "bc"]].to_numpy(float)
    schema = ", ".join(f"`{c}` {mine.schema[c].dataType.simpleString()}" for c in by) + ", a int, b int, c int, ra int, rb int, rc int, d2 double"

    def run(parts):
        for part in parts:
            if not len(part) or not len(sides):
                continue
            j, d2 = nearest_rows(part[["ab", "ac", "bc"]].to_numpy(float), sides, numbers)
            yield part[[*by, "a", "b", "c"]].assign(ra=numbers[j, 0], rb=numbers[j, 1], rc=numbers[j, 2], d2=d2)

    return mine.mapInPandas(run, schema)


def nearest_rows(points: np.ndarray, among: np.ndarray, ties: np.ndarray, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest row of `among` (sorted by its first column) and its squared distance; ties by the rows of `ties`.

    Points are taken in order of their first coordinate; a few rows beside a point bound its distance, and only
    rows whose first coordinate is within that bound are compared.
    """
    order = np.argsort(points[:, 0], kind="stable")
    best, far = np.zeros(len(points), np.int64), np.zeros(len(points))
    rank = np.empty(len(ties), np.int64)
    rank[np.lexsort(ties.T[::-1])] = np.arange(len(ties))
    first = among[:, 0]
    for lo in range(0, len(order), step):
        at = order[lo : lo + step]
        p = points[at]
        beside = np.clip(np.searchsorted(first, p[:, 0])[:, None] + np.arange(-4, 4), 0, len(first) - 1)
        bound = np.sqrt(((among[beside] - p[:, None]) ** 2).sum(axis=2).min(axis=1)) * (1 + 1e-12) + 1e-300
        a, b = np.searchsorted(first, (p[:, 0] - bound).min()), np.searchsorted(first, (p[:, 0] + bound).max(), "right")
        for c in range(a, max(b, a + 1), 8192):
            d2 = ((among[None, c : min(b, c + 8192)] - p[:, None]) ** 2).sum(axis=2)
            least = d2.min(axis=1)
            j = c + np.where(d2 == least[:, None], rank[c : min(b, c + 8192)], len(rank)).argmin(axis=1)
            if c == a:
                best[at], far[at] = j, least
            else:
                closer = (least < far[at]) | ((least == far[at]) & (rank[j] < rank[best[at]]))
                best[at[closer]], far[at[closer]] = j[closer], least[closer]
    return best, far


def nearest_star(points: DataFrame, reference: DataFrame, radius: float = 8.0, by: tuple[str, ...] = (), on: tuple[str, ...] = ()) -> DataFrame:
    """For each point (by..., star, x, y) the nearest reference star (on..., ref, x, y) with d2 < radius^2: by..., star, ref, d2."""
    by, on = list(by), list(on)
    cell = lambda c: F.floor(F.col(c) / radius)
    around = lambda c: F.sequence(cell(c) - 1, cell(c) + 1)
    asks = points.select(*by, "star", F.col("x").alias("px"), F.col("y").alias("py"), F.explode(around("x")).alias("cx"), around("y").alias("ys")).withColumn("cy", F.explode("ys")).drop("ys")
    ref = reference.select(*on, "ref", F.col("x").alias("rx"), F.col("y").alias("ry"), cell("x").alias("cx"), cell("y").alias("cy"))
    d2 = F.pow(F.col("px") - F.col("rx"), 2) + F.pow(F.col("py") - F.col("ry"), 2)
    near = asks.join(ref, [*on, "cx", "cy"]).withColumn("d2", d2).where(F.col("d2") < radius * radius)
    return near.groupBy(*by, "star").agg(F.min(F.struct("d2", "ref")).alias("m")).select(*by, "star", "m.ref", "m.d2")


def affine_least_squares(matches: DataFrame, by: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """by, a..f, n, rms from matched pairs (x, y) -> (u, v), by the normal equations of centred sums.

    One aggregation; a frame whose points are in line (or fewer than three) gives NULLs.
    """
    by = list(by)
    g = matches.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m{c}") for c in "xyuv"],
        *[F.covar_pop(p, q).alias(f"s{p}{q}") for p, q in ("xx", "yy", "xy", "xu", "yu", "xv", "yv", "uu", "vv")],
    )
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    ok = F.abs(det) > 1e-12 * F.greatest(F.col("sxx") * F.col("syy"), F.lit(1e-300))
    solve = lambda t: (F.when(ok, (F.col(f"sx{t}") * F.col("syy") - F.col(f"sy{t}") * F.col("sxy")) / det), F.when(ok, (F.col(f"sy{t}") * F.col("sxx") - F.col(f"sx{t}") * F.col("sxy")) / det))
    (a, b), (d, e) = solve("u"), solve("v")
    out = g.withColumn("a", a).withColumn("b", b).withColumn("d", d).withColumn("e", e)
    out = out.withColumn("c", F.col("mu") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).withColumn("f", F.col("mv") - F.col("d") * F.col("mx") - F.col("e") * F.col("my"))
    left = F.col("suu") - F.col("a") * F.col("sxu") - F.col("b") * F.col("syu") + F.col("svv") - F.col("d") * F.col("sxv") - F.col("e") * F.col("syv")
    return out.select(*by, *"abcdef", "n", F.sqrt(F.greatest(left, F.lit(0.0))).alias("rms"))


def apply_affine(t: str, x: Column, y: Column) -> tuple[Column, Column]:
    g = lambda k: F.col(f"{t}.{k}" if t else k)
    return g("a") * x + g("b") * y + g("c"), g("d") * x + g("e") * y + g("f")


def invert(t: tuple[float, ...]) -> tuple[float, ...] | None:
    """Inverse of (a, b, c, d, e, f); None if singular."""
    a, b, c, d, e, f = t
    det = a * e - b * d
    if abs(det) < 1e-8:
        return None
    return e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det


def from_three(p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """Affine coefficients (2 x 3) that take three points p to q."""
    m = np.column_stack([p, np.ones(3)])
    if abs(np.linalg.det(m)) < 1e-8:
        return None
    return np.linalg.solve(m, q).T


def _triples(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b, c) and |AB|, |AC|, |BC| of all triangles with |AB| < |AC| < |BC|: a vertex's place follows from the rank of the side across."""
    i, j, k = np.array(list(itertools.combinations(range(len(xy)), 3)), int).reshape(-1, 3).T
    across = np.stack([i, j, k], 1)
    sides = np.stack([np.hypot(*(xy[p] - xy[q]).T) for p, q in ((j, k), (i, k), (i, j))], 1)
    order = np.argsort(sides, axis=1, kind="stable")
    sides, across = np.take_along_axis(sides, order, 1), np.take_along_axis(across, order[:, ::-1], 1)
    apart = (sides[:, 0] < sides[:, 1]) & (sides[:, 1] < sides[:, 2])
    return across[apart], sides[apart]


class _Grid:
    """Points dealt into cells as wide as a radius, for nearest neighbours within it."""

    def __init__(self, points: np.ndarray, radius: float):
        self.radius = radius
        cell = np.floor(points / radius).astype(np.int64)
        self.order = np.lexsort((np.arange(len(points)), cell[:, 0], cell[:, 1]))
        self.points, self.keys = points[self.order], self._key(cell[self.order, 0], cell[self.order, 1])

    @staticmethod
    def _key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return y * (1 << 31) + x

    def nearest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the places with a point nearer than the radius: place, point, squared distance; ties to the lower point."""
        cell = np.floor(at / self.radius).astype(np.int64)
        best, far = np.full(len(at), -1), np.full(len(at), self.radius**2)
        for dy in (-1, 0, 1):  # three cells of a row are neighbours in the order
            lo = np.searchsorted(self.keys, self._key(cell[:, 0] - 1, cell[:, 1] + dy))
            hi = np.searchsorted(self.keys, self._key(cell[:, 0] + 1, cell[:, 1] + dy), "right")
            for k in range(int((hi - lo).max(initial=0))):
                who = np.flatnonzero(lo + k < hi)
                j = lo[who] + k
                d2 = ((at[who] - self.points[j]) ** 2).sum(axis=1)
                closer = (d2 < far[who]) | ((d2 == far[who]) & (best[who] >= 0) & (self.order[j] < best[who]))
                best[who[closer]], far[who[closer]] = self.order[j[closer]], d2[closer]
        found = np.flatnonzero(best >= 0)
        return found, best[found], far[found]


def fit_to_reference(mine: np.ndarray, mine_mass: np.ndarray, ref: np.ndarray, ref_mass: np.ndarray, k: int, width: float, ref_width: float, ref_height: float, radius: float = 8.0) -> tuple[np.ndarray | None, float]:
    """Best affine (2 x 3, frame -> reference) and its residual sqrt(sum d2) / n; (None, inf) if nothing fits.

    Hypotheses come from the K triangles nearest to reference triangles (sides scaled by the widths);
    one stands if at least a third of the stars come within radius, and is refined by least squares.
    """
    far = ref_height / 20
    pick = lambda xy, m: (o := np.lexsort((xy[:, 0], xy[:, 1], -m)))[ST.kept_apart(xy[o, 0], xy[o, 1], far)][:k]
    p, q = mine[pick(mine, mine_mass)], ref[pick(ref, ref_mass)]
    (ti, ts), (ri, rs) = _triples(p * (ref_width / width)), _triples(q)
    if not len(ti) or not len(ri):
        return None, math.inf
    by_side = np.argsort(rs[:, 0], kind="stable")
    j, d2 = nearest_rows(ts, rs[by_side], ri[by_side])
    best = sorted(zip(d2.tolist(), range(len(ti)), by_side[j].tolist()))
    near_ref = _Grid(ref, radius)

    def matched(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return near_ref.nearest(mine @ t[:, :2].T + t[:, 2])

    answer, residual = None, math.inf
    for _, i, j in best[:k]:
        t = from_three(p[ti[i]], q[ri[j]])
        if t is None:
            continue
        a, b, d2 = matched(t)
        if len(a) < max(3, len(mine) // 3):
            continue
        m = np.column_stack([mine[a], np.ones(len(a))])
        t = np.linalg.lstsq(m, ref[b], rcond=None)[0].T
        a, b, d2 = matched(t)
        r = math.sqrt(float(d2.sum())) / max(1, len(a))
        if len(a) >= max(3, len(mine) // 3) and r < residual:
            answer, residual = t, r
        if residual < 0.01:
            break
    return answer, residual


def align(stars: DataFrame, sizes: DataFrame, ref_stars: DataFrame, ref_width: int, ref_height: int, ref_id: int | None = None, k: int = 50, threshold: float = 1.0) -> DataFrame:
    """frame_id, a..f, residual of the frames that align (residual up to threshold); others have no row.

    The reference's stars (a catalogue of one frame) go to all tasks; the reference itself is the identity.
    """
    rows = ref_stars.select("x", "y", "mass").toPandas()  # one frame's catalogue
    ref, ref_mass = rows[["x", "y"]].to_numpy(float), rows["mass"].to_numpy(float)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        columns = ["frame_id", *"abcdef", "residual"]
        if ref_id is not None and int(key[0]) == ref_id:
            return pd.DataFrame([(key[0], 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)], columns=columns)
        t, r = fit_to_reference(part[["x", "y"]].to_numpy(float), part["mass"].to_numpy(float), ref, ref_mass, k, float(part["width"].iloc[0]), ref_width, ref_height)
        return pd.DataFrame([(key[0], *t.ravel(), r)] if t is not None and r <= threshold else [], columns=columns)

    return stars.join(sizes.select("frame_id", "width"), "frame_id").groupBy("frame_id").applyInPandas(run, "frame_id int, a double, b double, c double, d double, e double, f double, residual double")
