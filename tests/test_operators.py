import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameloom.functions import colors
from frameloom.operators import align, background, color, pixelmath, reference, stack, stars, stats, stencil
from frameloom.streaming import incremental


def frame(spark, a, frame_id=0, ch=0):
    a = np.asarray(a, float)
    y, x = np.indices(a.shape)
    pdf = pd.DataFrame({"frame_id": frame_id, "ch": ch, "y": y.ravel(), "x": x.ravel(), "v": a.ravel()}).astype({"frame_id": "int32", "ch": "int32", "y": "int32", "x": "int32"})
    df = spark.createDataFrame(pdf)
    return df.withColumn("v", F.nanvl("v", F.lit(None).cast("double")))


def image(df):
    p = df.toPandas()
    out = np.full((p.y.max() + 1, p.x.max() + 1), np.nan)
    out[p.y, p.x] = p.v.astype(float)
    return out


def test_median_of_shuffled_range_is_its_middle(spark):
    rows = [(n, float(v)) for n in (1, 2, 3, 10, 99, 100, 999) for v in random.Random(n).sample(range(1, n + 1), n)]
    got = spark.createDataFrame(rows, "frame_id int, v double").groupBy("frame_id").agg(F.median("v").alias("m")).collect()
    assert {r.frame_id: r.m for r in got} == {n: (n + 1) / 2 for n in (1, 2, 3, 10, 99, 100, 999)}
    k = stats.kth_smallest(spark.createDataFrame(rows, "frame_id int, v double"), ["frame_id"])
    assert {r.frame_id: r.v for r in k.collect()} == {n: n // 4 + 1 for n in (1, 2, 3, 10, 99, 100, 999)}


@pytest.mark.parametrize("channel,at,off", [("R", [(2, 2), (4, 4)], (2, 3)), ("G", [(3, 2), (2, 3)], (2, 2))])
def test_bayer_bad_pixels(spark, channel, at, off):
    base = 100.0 + (np.arange(13 * 11).reshape(11, 13) & 3)
    for (x, y), v in itertools.product(at, (500.0, 0.0)):
        a = base.copy()
        a[y, x] = v
        out = stencil.bad_pixels_bayer(frame(spark, a), channel)
        bad = out.where("bad").collect()
        assert [(r.x, r.y) for r in bad] == [(x, y)] and bad[0].v != v
    a = base.copy()
    a[off[1], off[0]] = 500.0
    out = stencil.bad_pixels_bayer(frame(spark, a), channel)
    assert out.where("bad").count() == 0


@pytest.mark.parametrize("channel,w,h,native", [("R", 7, 11, lambda x, y: x % 2 == 0 and y % 2 == 0), ("G", 11, 13, lambda x, y: (x + y) % 2 == 1), ("B", 13, 7, lambda x, y: x % 2 == 1 and y % 2 == 1)])
def test_debayer_sizes_and_native_samples(spark, channel, w, h, native):
    i = np.arange(w * h).reshape(h, w)
    a = i * (i + 1) / 2
    got = image(stencil.debayer(frame(spark, a), channel))
    assert got.shape == (h & ~1, w & ~1) and not np.isnan(got).any()
    for y, x in np.ndindex(got.shape):
        if native(x, y):
            assert got[y, x] == a[y, x]


@pytest.mark.parametrize("sigma,n,centre", [(1, 3, 0.44198), (2, 9, 0.20236), (3, 13, 0.136498)])
def test_gaussian_kernel(sigma, n, centre):
    k = stencil.gaussian_kernel(sigma)
    assert len(k) == n and k[n // 2] == pytest.approx(centre, abs=1e-5) and sum(k) == pytest.approx(1)


@pytest.mark.parametrize("n,sigma", [(15, 1), (31, 2), (63, 3)])
def test_blur_of_an_impulse(spark, n, sigma):
    a = np.zeros((n, n))
    a[n // 2, n // 2] = 9.99
    got = image(stencil.gaussian_blur(frame(spark, a), sigma))
    r = len(stencil.gaussian_kernel(sigma)) // 2
    inside = np.zeros_like(a, bool)
    inside[n // 2 - r : n // 2 + r + 1, n // 2 - r : n // 2 + r + 1] = True
    assert (got[~inside] == 0).all() and (got[inside] > 0).all() and (got < 9.99).all()
    assert got.sum() == pytest.approx(9.99, abs=1e-5)


def test_tiles_agree_with_one_tile(spark):
    a = np.random.default_rng(0).random((40, 37))
    whole = image(stencil.tiled(frame(spark, a), lambda b, y0, x0, h, w: stencil.blurred(b, y0, x0, h, w, stencil.gaussian_kernel(2)), 4))
    small = image(stencil.tiled(frame(spark, a), lambda b, y0, x0, h, w: stencil.blurred(b, y0, x0, h, w, stencil.gaussian_kernel(2)), 4, tile=9))
    np.testing.assert_allclose(whole, small)


@pytest.mark.parametrize("sigma", [1, 2, 3])
def test_unsharp_mask_of_a_step(spark, sigma):
    a = np.full((15, 15), 10.0)
    a[7, 7] = 15
    limits = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 20.0)], "frame_id int, ch int, location double, scale double, min double, max double")
    got = image(stencil.unsharp_mask(frame(spark, a), limits, sigma, 1.0, 0.0))
    assert 15 < got[7, 7] <= 20
    r = len(stencil.gaussian_kernel(sigma)) // 2
    far = np.ones_like(a, bool)
    far[7 - r : 8 + r, 7 - r : 8 + r] = False
    np.testing.assert_allclose(got[far], 10, atol=1e-5)


def test_deband_against_brute_force(spark):
    a = np.random.default_rng(5).random((12, 9)) + 1
    a[4] *= 1.3
    ls = spark.createDataFrame([(0, 0, 10.0, 1.0)], "frame_id int, ch int, location double, scale double")
    got = image(stencil.deband(frame(spark, a), ls, 50, 4, 3.0))
    level = np.sort(a, axis=1)[:, max(1, int(9 * 50 / 100)) - 1]
    for y in range(12):
        lo = min(max(0, y - 2), 12 - 4)
        part, gone = level[lo : lo + 4], (y - 2) - lo
        left, right = np.median(part[:2]), np.median(part[2:])
        line = [(left + right) / 2 + np.sign(gone) * (right - left) / 2 * (2 + j) for j in range(1, abs(gone) + 1)]
        rest = part[: 4 - abs(gone)] if gone < 0 else part[abs(gone) :]
        np.testing.assert_allclose(got[y], a[y] * np.median([*rest, *line]) / level[y])


def test_project_identity_and_shift(spark):
    a = np.random.default_rng(1).random((6, 7))
    t = lambda *v: spark.createDataFrame([(0, *map(float, v), 7, 6)], "frame_id int, a double, b double, c double, d double, e double, f double, width int, height int")
    got = image(stencil.project(frame(spark, a), t(1, 0, 0, 0, 1, 0)))
    np.testing.assert_allclose(got[:5, :6], a[:5, :6])
    assert np.isnan(got[5]).all() and np.isnan(got[:, 6]).all()
    got = image(stencil.project(frame(spark, a), t(1, 0, 1, 0, 1, 0), F.lit(-1.0)))
    np.testing.assert_allclose(got[:5, 1:], a[:5, :-1])
    assert (got[:, 0] == -1).all()
    assert stencil.project(frame(spark, a), t(1, 1, 0, 1, 1, 0)).count() == 0


def test_project_tiles_agree_with_brute_force(spark):
    a = np.random.default_rng(8).random((23, 31))
    t = (0.97, 0.11, 2.3, -0.1, 1.02, -1.7)
    row = spark.createDataFrame([(0, *t, 35, 20)], "frame_id int, a double, b double, c double, d double, e double, f double, width int, height int")
    back = align.invert(t)
    want = np.full((20, 35), np.nan)
    for y, x in np.ndindex(want.shape):
        sx, sy = back[0] * x + back[1] * y + back[2], back[3] * x + back[4] * y + back[5]
        ix, iy = int(np.floor(sx)), int(np.floor(sy))
        if 0 <= ix < 30 and 0 <= iy < 22:
            fx, fy = sx - ix, sy - iy
            want[y, x] = (1 - fy) * ((1 - fx) * a[iy, ix] + fx * a[iy, ix + 1]) + fy * ((1 - fx) * a[iy + 1, ix] + fx * a[iy + 1, ix + 1])
    for tile in (256, 7):
        np.testing.assert_allclose(image(stencil.project(frame(spark, a), row, tile=tile)), want, atol=1e-9)


def stacked(spark, mode, frames, **kwargs):
    df = frame(spark, frames[0], 0)
    for i, f in enumerate(frames[1:], 1):
        df = df.unionByName(frame(spark, f, i))
    return stack.stack(df, mode, **kwargs)


def test_stack_modes_on_missing_and_single_values(spark):
    frames = [[[1.0, np.nan, 5.0]], [[1.0, np.nan, np.nan]], [[1.0, np.nan, np.nan]]]
    for mode in range(6):
        got = {r.x: r for r in stacked(spark, mode, frames).collect()}
        assert got[0].v == 1 and got[1].v is None and got[2].v == 5, mode


def test_stack_refuses_what_has_no_meaning(spark):
    df = frame(spark, [[1.0]]).withColumn("w", F.lit(1.0))
    for mode in (0, 4, 5):
        with pytest.raises(ValueError):
            stack.stack(df, mode, weight="w")
    with pytest.raises(ValueError):
        stack.stack(df, 2, sigma_low=-1)
    with pytest.raises(ValueError):
        stack.stack(df, 6)
    assert [stack.auto_mode(n) for n in (1, 6, 15, 25)] == [1, 2, 3, 5]


def test_two_level_stack_equals_the_mean(spark):
    r = np.random.default_rng(2)
    frames = [r.random((3, 4)) for _ in range(7)]
    df = frame(spark, frames[0], 0)
    for i, f in enumerate(frames[1:], 1):
        df = df.unionByName(frame(spark, f, i))
    np.testing.assert_allclose(image(stack.stack_batches(df, 3)), np.mean(frames, axis=0))
    np.testing.assert_allclose(image(incremental.incremental_stack(df)), np.mean(frames, axis=0))
    low, high = stack.goal_seek_sigma(df, 1.0, 1.0, rounds=4)
    assert 1 <= low <= 11 and 1 <= high <= 11


def test_streaming_stack(spark, tmp_path):
    frames = [np.full((2, 2), float(i)) for i in range(3)]
    for i, f in enumerate(frames):
        frame(spark, f, i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(spark, frames[0]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.incremental_stack(stream).writeStream.outputMode("complete").format("memory").queryName("stacked").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.v, r.frames) for r in spark.table("stacked").collect()} == {(1.0, 3)}


def test_affine_least_squares_recovers_a_transform(spark):
    r = np.random.default_rng(4)
    t = (1.01, -0.02, 3.0, 0.03, 0.98, -5.0)
    rows = [(0, x, y, t[0] * x + t[1] * y + t[2], t[3] * x + t[4] * y + t[5]) for x, y in (r.random((20, 2)) * 100).tolist()]
    got = align.affine_least_squares(spark.createDataFrame(rows, "frame_id int, x double, y double, u double, v double")).first()
    np.testing.assert_allclose([got[k] for k in "abcdef"], t, atol=1e-8)
    assert got.rms == pytest.approx(0, abs=1e-5)
    line = [(0, float(i), float(i), float(i), float(i)) for i in range(5)]
    assert align.affine_least_squares(spark.createDataFrame(line, "frame_id int, x double, y double, u double, v double")).first().a is None
    back = align.invert(t)
    assert align.invert((1, 1, 0, 1, 1, 0)) is None
    np.testing.assert_allclose(back[0] * (t[0] * 2 + t[1] * 3 + t[2]) + back[1] * (t[3] * 2 + t[4] * 3 + t[5]) + back[2], 2)


def test_triangles_of_a_frame_against_brute_force():
    xy = np.random.default_rng(4).integers(0, 9, (12, 2)).astype(float)  # with equal sides
    d = lambda p, q: float(np.hypot(*(xy[p] - xy[q])))
    want = {(a, b, c) for a, b, c in itertools.permutations(range(12), 3) if d(a, b) < d(a, c) < d(b, c)}
    idx, sides = align._triples(xy)
    assert {tuple(map(int, t)) for t in idx} == want and len(idx) == len(want)
    np.testing.assert_allclose(sides, [[d(a, b), d(a, c), d(b, c)] for a, b, c in idx])
    assert len(align._triples(xy[:2])[0]) == 0


def test_align_recovers_a_shifted_frame(spark):
    r = np.random.default_rng(7)
    xy = r.random((25, 2)) * [400, 300]
    mass = r.random(25) * 100
    moved = xy @ np.array([[0.999, 0.01], [-0.01, 1.001]]) + [4.0, -3.0]
    rows = [(0, float(x), float(y), float(m)) for (x, y), m in zip(xy, mass)] + [(1, float(x), float(y), float(m)) for (x, y), m in zip(moved, mass)] + [(2, float(x), float(y), float(m)) for (x, y), m in zip(r.random((25, 2)) * 300, mass)]
    s = spark.createDataFrame(rows, "frame_id int, x double, y double, mass double")
    sizes = spark.createDataFrame([(i, 400, 300) for i in range(3)], "frame_id int, width int, height int")
    got = {r.frame_id: r for r in align.align(s, sizes, s.where("frame_id = 0"), 400, 300, 0, k=12).collect()}
    assert set(got) == {0, 1} and got[0].residual == 0
    for (x, y), (u, v) in zip(moved, xy):
        assert got[1].a * x + got[1].b * y + got[1].c == pytest.approx(u, abs=1e-3) and got[1].d * x + got[1].e * y + got[1].f == pytest.approx(v, abs=1e-3)


def star_field(seed=0, n=6, size=80):
    r = np.random.default_rng(seed)
    y, x = np.indices((size, size))
    a = r.normal(0.1, 0.005, (size, size))
    places = [(12 + 25 * (i % 3) + r.random(), 15 + 40 * (i // 3) + r.random()) for i in range(n)]
    for k, (cx, cy) in enumerate(places):
        a += (1 + 0.1 * k) * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * 1.5**2))
    return a, places


def brute_stars(a, location, scale, radius, sigma, in_out, bad_sigma):
    """Detection by plain loops: bright runs, bad pixels out, overlaps out, centres of mass, overlaps out, half-flux radii."""
    import math

    h, w = a.shape
    clean = [[location if math.isnan(v) else float(v) for v in row] for row in a]
    spots = []
    for y in range(h):
        run = []
        for x in [x for x in range(w) if clean[y][x] > location + sigma * scale] + [None]:
            best = max(run, key=lambda i: (clean[y][i], -i)) if run else None
            # a run goes on from its brightest pixel so far
            if run and (x is None or x - best > radius):
                spots.append((clean[y][best], y, best))
                run = []
            if x is not None:
                run.append(x)
    if bad_sigma > 0:
        diff = {}
        for y in range(h):
            for x in range(w):
                if not math.isnan(a[y, x]):
                    near = [a[j, i] for j in range(max(0, y - 1), min(h, y + 2)) for i in range(max(0, x - 1), min(w, x + 2)) if not math.isnan(a[j, i])]
                    diff[y, x] = a[y, x] - np.median(near)
        limit = bad_sigma * np.std(list(diff.values()))
        spots = [s for s in spots if abs(diff[s[1], s[2]]) < limit]

    def apart(points):
        kept = []
        for p in sorted(points, key=lambda p: (-p[0], p[1], p[2])):
            if all(math.floor((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 + 0.5) > radius * radius for q in kept):
                kept.append(p)
        return kept

    centred = []
    for _, y, x in apart(spots):
        cy, cx = float(y), float(x)
        for _ in range(10):
            iy, ix = math.floor(cy + 0.5), math.floor(cx + 0.5)
            box = [(j, i, max(clean[j][i] - location - scale * sigma / 2, 0)) for j in range(max(0, iy - radius), min(h, iy + radius + 1)) for i in range(max(0, ix - radius), min(w, ix + radius + 1))]
            mass = math.fsum(m for *_, m in box)
            if mass <= 0:
                break
            ny, nx = math.fsum(j * m for j, _, m in box) / mass, math.fsum(i * m for _, i, m in box) / mass
            far, cy, cx = (ny - cy) ** 2 + (nx - cx) ** 2, ny, nx
            if far <= 1e-4:
                break
        if mass > 0:
            centred.append((mass, cy, cx))
    out = []
    for _, cy, cx in apart(centred):
        iy, ix = min(h - 1, math.floor(cy + 0.5)), min(w - 1, math.floor(cx + 0.5))
        disc = [(math.hypot(j - iy, i - ix), max(clean[j][i] - location, 0)) for j in range(h) for i in range(w) if (j - iy) ** 2 + (i - ix) ** 2 <= radius * radius]
        mass = math.fsum(v for _, v in disc)
        if mass <= 0:
            continue
        hfr = math.fsum(d * v for d, v in disc) / mass
        inner, outer = [v for d, v in disc if d <= hfr], [v for d, v in disc if d > hfr]
        if hfr <= radius and sum(inner) * len(outer) > in_out * sum(outer) * len(inner):
            out.append((iy * w + ix, clean[iy][ix], cx, cy, mass, hfr))
    return sorted(out, key=lambda s: (-s[4], s[0]))


@pytest.mark.parametrize("seed,radius,bad", [(0, 4, 0.0), (1, 6, 0.0), (2, 4, 6.0), (3, 5, 3.0)])
def test_star_detection_against_brute_force(spark, seed, radius, bad):
    r = np.random.default_rng(seed)
    a = r.normal(10, 1, (50, 60))
    y, x = np.indices(a.shape)
    for _ in range(14):
        cy, cx = r.uniform(0, 50), r.uniform(0, 60)
        a += r.uniform(30, 200) * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * r.uniform(0.7, 1.6) ** 2))
    a[tuple(r.integers(0, 50, (2, 5)))] = 400  # hot pixels
    a[r.random(a.shape) < 0.01] = np.nan
    ls = spark.createDataFrame([(0, 10.0, 1.0)], "frame_id int, location double, scale double")
    got = stars.detect(frame(spark, a), ls, radius, 8.0, 1.4, bad).orderBy("rank").collect()
    want = brute_stars(a, 10.0, 1.0, radius, 8.0, 1.4, bad)
    assert [g.idx for g in got] == [s[0] for s in want] and len(want) > 3 and [g["rank"] for g in got] == list(range(1, len(want) + 1))
    np.testing.assert_allclose([[g.value, g.x, g.y, g.mass, g.hfr] for g in got], [s[1:] for s in want], rtol=1e-9)


def test_star_detection_finds_planted_stars(spark):
    a, places = star_field()
    df = frame(spark, a)
    found = stars.detect(df, stats.median_mad(df, ["frame_id"]), radius=8, sigma=15, in_out=1.4)
    rows = found.orderBy("rank").collect()
    assert len(rows) == len(places)
    for cx, cy in places:
        assert min(np.hypot(r.x - cx, r.y - cy) for r in rows) < 0.3
    assert all(1 < r.hfr < 4 for r in rows) and [r.mass for r in rows] == sorted((r.mass for r in rows), reverse=True)
    assert stars.summary(found).first().n_stars == len(places)
    flat = frame(spark, np.full((9, 9), 1.0))
    assert stars.detect(flat, stats.median_mad(flat, ["frame_id"])).count() == 0


def test_overlap_filter_against_brute_force(spark):
    r = np.random.default_rng(9)
    pts = [(0, float(x), float(y), float(m)) for x, y, m in r.random((300, 3)) * [200, 200, 1]]
    got = {(p.x, p.y) for p in stars.overlap_filter(spark.createDataFrame(pts, "frame_id int, x double, y double, mass double"), 15.0).collect()}
    kept = []
    for _, x, y, _ in sorted(pts, key=lambda p: (-p[3], p[2], p[1])):
        if all(int((x - u) ** 2 + (y - v) ** 2 + 0.5) > 225 for u, v in kept):
            kept.append((x, y))
    assert got == set(kept)


def test_background_of_a_gradient_is_removed(spark):
    y, x = np.indices((32, 48))
    a = 1 + 0.01 * x + 0.02 * y
    out = image(background.subtract(frame(spark, a), background.finished(background.cells(frame(spark, a), 8))))
    assert np.abs(out[6:-6, 6:-6]).max() < 0.1
    one = np.full((4, 4), 3.0)
    np.testing.assert_allclose(image(background.subtract(frame(spark, one), background.finished(background.cells(frame(spark, one), 100)))), 0)


def test_background_fill():
    a = np.array([[1.0, np.nan], [3.0, np.nan]])
    assert not np.isnan(background.filled(a)).any()
    assert (background.filled(np.full((2, 2), np.nan)) == 0).all()


def test_hsluv_round_trip_and_known_values():
    r = np.random.default_rng(0)
    rgb = tuple(r.random((3, 500)))
    for back in (colors.hsluv_to_rgb(*colors.rgb_to_hsluv(*rgb)), colors.xyy_to_rgb(*colors.rgb_to_xyy(*rgb)), colors.hsl_to_rgb(*colors.rgb_to_hsl(*rgb)), colors.oklab_to_rgb(*colors.rgb_to_oklab(*rgb))):
        np.testing.assert_allclose(np.stack(back), np.stack(rgb), atol=1e-6)
    h, s, l = colors.rgb_to_hsluv(np.array([1.0, 0.0]), np.array([0.0, 0.0]), np.array([0.0, 0.0]))
    assert h[0] == pytest.approx(12.1770506, abs=1e-4) and s[0] == pytest.approx(1, abs=1e-6) and l[0] == pytest.approx(0.5323712, abs=1e-5) and l[1] == 0
    red, green, blue = colors.star_colour(np.array([1.8])), None, colors.star_colour(np.array([-0.3]))
    assert red[0][0] == 1 and red[2][0] < 0.6 and blue[2][0] == 1


def test_colour_columns_agree_with_the_kernels(spark):
    r = np.random.default_rng(5)
    rgb = np.concatenate([r.random((300, 3)), [[0, 0, 0], [1, 1, 1], [1, 0, 0], [0, 1, 0], [0, 0, 1], [0.5, 0.5, 0.5], [1e-9, 0, 0]]])
    df = spark.createDataFrame([(i, 0, 0, *map(float, c)) for i, c in enumerate(rgb)] + [(900, 0, 0, None, 0.5, 0.5)], "frame_id int, y int, x int, c0 double, c1 double, c2 double")
    rows = lambda out: np.array([[q.c0, q.c1, q.c2] for q in out.where("frame_id < 900").orderBy("frame_id").collect()], float)
    hsl = color.rgb_to_hsluv(df)
    want = np.stack(colors.rgb_to_hsluv(*rgb.T), 1)
    grey = want[:, 1] < 1e-6  # the hue of a grey is arbitrary
    np.testing.assert_allclose(rows(hsl)[~grey], want[~grey], atol=1e-6)
    np.testing.assert_allclose(rows(hsl)[grey][:, 1:], want[grey][:, 1:], atol=1e-6)
    np.testing.assert_allclose(rows(color.hsluv_to_rgb(hsl)), np.stack(colors.hsluv_to_rgb(*want.T), 1), atol=1e-6)
    greener = color.scnr(hsl, 0.5)
    assert greener.columns == hsl.columns
    np.testing.assert_allclose(rows(greener)[~grey], np.stack(colors.scnr(*want.T, 0.5), 1)[~grey], atol=1e-5)
    last = hsl.where("frame_id = 900").first()
    assert last.c0 is None and last.c1 is None and last.c2 is None


def test_scnr_never_raises_green():
    r = np.random.default_rng(1)
    rgb = tuple(r.random((3, 200)))
    h, s, l = colors.rgb_to_hsluv(*rgb)
    h2, s2, l2 = colors.scnr(h, s, l, 0.0)
    np.testing.assert_allclose(h2, h, atol=1e-5)
    assert (colors.scnr(h, s, l, 1.0)[2] == l).all()


def test_neutral_parameters_return_the_input(spark):
    df = frame(spark, [[1.0, 2.0]])
    assert pixelmath.gamma(df) is df and pixelmath.scale_offset(df) is df and stencil.bin_pixels(df) is df and stencil.gaussian_blur(df, 0) is df
    assert pixelmath.match_histogram(df, 0, df, df) is df and pixelmath.midtones(df, 0, 2, df) is df


def test_stretch_reaches_its_location(spark):
    a = np.random.default_rng(2).normal(0.02, 0.001, (40, 40)).clip(0.001, 1)
    out = pixelmath.stretch(frame(spark, a), 0.1, 0.02)
    ls = stats.median_mad(out, ["frame_id"]).first()
    assert ls.location == pytest.approx(0.1, abs=0.02)


def test_reference_selection(spark):
    rows = [(0, "a", 10, 2.0, 0.1), (1, "b", 30, 3.0, 0.2), (2, "c", 30, 3.0, 0.3), (3, "d", 0, None, 0.9)]
    f = spark.createDataFrame(rows, "frame_id int, file string, n_stars int, hfr double, location double")
    pick = lambda m: [r.frame_id for r in reference.select_reference(f, m).collect()]
    assert pick("%starsHFR") == [1] and pick("%location") == [1] and pick("%rgb") == [3] and pick(2) == [2] and pick("d") == [3] and pick("") == []


def test_colour_balance_makes_channels_equal(spark):
    w = spark.createDataFrame([(0, 0, 0, 0.1, 0.2, 0.3), (0, 0, 1, 0.5, 0.6, 0.9)], "frame_id int, y int, x int, c0 double, c1 double, c2 double")
    lo = spark.createDataFrame([(0, 0.1, 0.2, 0.3)], "frame_id int, m0 double, m1 double, m2 double")
    hi = spark.createDataFrame([(0, 0.5, 0.6, 0.9)], "frame_id int, s0 double, s1 double, s2 double")
    for r in color.balance(w, lo, hi).collect():
        assert r.c0 == pytest.approx(r.c1) == pytest.approx(r.c2)


def test_empty_tables(spark):
    e = frame(spark, [[1.0]]).limit(0)
    by = ["frame_id"]
    for out in (stack.stack(e, 0), stack.stack(e, 2), stats.basic(e, by), stats.median_mad(e, by), stats.noise(e, by), stencil.gaussian_blur(e, 1), pixelmath.norm_range(e), background.cells(e, 4)):
        assert out.count() == 0


def test_windowed_levels_of_a_stream_drop_what_is_too_late(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "ts string, event_type string, value double").coalesce(1).write.json(f"file://{tmp_path}/{name}", mode="append")

    put("in", [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0), ("2024-01-01 01:10:00", "b", 5.0)])
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").json(f"file://{tmp_path}/in")
    q = incremental.windowed_levels(stream).writeStream.outputMode("update").format("memory").queryName("levels").option("checkpointLocation", f"file://{tmp_path}/state").start()
    q.processAllAvailable()
    put("in", [("2024-01-01 09:00:00", "a", 7.0)])
    q.processAllAvailable()
    put("in", [("2024-01-01 00:20:00", "a", 100.0), ("2024-01-01 08:59:00", "a", 9.0)])  # the first one is past the watermark
    q.processAllAvailable()
    q.stop()
    got = {(str(r.start), r.event_type, r.v, r.n) for r in spark.table("levels").collect()}
    assert got == {("2024-01-01 00:00:00", "a", 2.0, 2), ("2024-01-01 01:00:00", "b", 5.0, 1), ("2024-01-01 09:00:00", "a", 7.0, 1), ("2024-01-01 08:00:00", "a", 9.0, 1)}


def test_black_and_white_points_clip_the_asked_shares(spark):
    a = np.random.default_rng(3).permutation(10_000).reshape(100, 100) / 10_000.0
    got = image(pixelmath.black_white(frame(spark, a), 10.0, 5.0))
    assert (got == 0).mean() == pytest.approx(0.1, abs=0.002) and (got == 1).mean() == pytest.approx(0.05, abs=0.002)
    flat = image(pixelmath.black_white(frame(spark, np.full((3, 3), 2.0)), 10.0, 5.0))
    assert set(flat.ravel()) == {0.0}


def test_nearest_rows_and_grid_against_brute_force():
    r = np.random.default_rng(7)
    among = r.integers(0, 12, (400, 3)).astype(float)  # many ties
    ties = r.permutation(400).reshape(-1, 1)
    order = np.argsort(among[:, 0], kind="stable")
    among, ties = among[order], ties[order]
    points = r.uniform(-3, 15, (700, 3)).round(1)
    j, d2 = align.nearest_rows(points, among, ties)
    want = ((points[:, None] - among[None]) ** 2).sum(axis=2)
    assert [int(x) for x in j] == [min(range(400), key=lambda k: (row[k], ties[k, 0])) for row in want]
    np.testing.assert_allclose(d2, want.min(axis=1))
    ref, at = r.uniform(-50, 50, (300, 2)).round(1), r.uniform(-60, 60, (500, 2)).round(1)
    who, near, far = align._Grid(ref, 4.0).nearest(at)
    want = ((at[:, None] - ref[None]) ** 2).sum(axis=2)
    assert who.tolist() == np.flatnonzero(want.min(axis=1) < 16).tolist() and near.tolist() == want[who].argmin(axis=1).tolist()
    np.testing.assert_allclose(far, want[who].min(axis=1))
