import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import planes, stack, stencil
from frameloom.sources import fits

from test_operators import frame, image


def plane(df):
    return image(df.select("y", "x", "v"))


@pytest.mark.parametrize("shape,tile,halo", [((23, 31), 7, 3), ((8, 8), 8, 4), ((5, 40), 6, 6), ((1, 1), 4, 2)])
def test_stencils_on_tiles_agree_with_one_block(spark, shape, tile, halo):
    a = np.random.default_rng(1).random(shape).astype(np.float32).astype(float)
    a[np.random.default_rng(2).random(shape) < 0.05] = np.nan
    t = planes.from_pixels(frame(spark, a), tile)
    kernel = lambda b, y0, x0, h, w: stencil._nanmedian([stencil.shifted(b, dy, dx) for dy in range(-halo, halo + 1) for dx in (-halo, 0, halo)])
    got = plane(planes.to_pixels(planes.stencil(t, kernel, halo, tile), tile))
    np.testing.assert_allclose(got, kernel(a[None], 0, 0, *shape)[0], rtol=1e-6)
    np.testing.assert_allclose(plane(planes.to_pixels(t, tile)), a, rtol=1e-6)


@pytest.mark.parametrize("mode", [0, 1, 2, 3, 4, 5])
def test_stacks_of_tiles_agree_with_stacks_of_pixels(spark, mode):
    r = np.random.default_rng(3)
    frames = r.normal(10, 1, (9, 11, 13)).astype(np.float32).astype(float)
    frames[4, 5, 6], frames[2, 2, 2] = 90, np.nan
    df = frame(spark, frames[0], 0)
    for i in range(1, 9):
        df = df.unionByName(frame(spark, frames[i], i))
    want = stack.stack(df, mode, ("y", "x"), 2.0, 2.0)
    done = planes.stacked(planes.from_pixels(df, 4), mode, 9, 2.0, 2.0, 4)
    np.testing.assert_allclose(plane(planes.to_pixels(done.withColumn("frame_id", F.lit(0)), 4)), plane(want), rtol=1e-5)
    counted = done.select(F.aggregate("n_low", F.lit(0), lambda a, x: a + x).alias("lo"), F.aggregate("n_high", F.lit(0), lambda a, x: a + x).alias("hi")).agg(F.sum("lo"), F.sum("hi")).first()
    assert tuple(counted) == tuple(want.agg(F.sum("n_low"), F.sum("n_high")).first())


def test_tiles_of_files_and_maps(spark, tmp_path):
    r = np.random.default_rng(5)
    data = r.random((2, 3, 50, 70)).astype(np.float32)
    data[0, 1, 2, 3] = np.nan
    for i in range(2):
        (tmp_path / f"f{i}.fits").write_bytes(fits.encode(fits.Image(data[i])))
    t = fits.tiles(spark, ["f*.fits"], f"file://{tmp_path}")
    assert t.count() == 6
    dark = t.where("frame_id = 0").select("ch", "ty", "tx", "v")
    out = planes.to_pixels(planes.mapped(planes.combined(t.where("frame_id = 1"), dark, np.subtract), lambda v: v * 2)).toPandas()
    got = np.zeros((3, 50, 70))
    got[out.ch, out.y, out.x] = out.v
    np.testing.assert_allclose(got, (data[1] - np.nan_to_num(data[0])) * 2, rtol=1e-5)
    s = {x.frame_id: x for x in planes.statistics(t).collect()}
    np.testing.assert_allclose([s[1].min, s[1].max, s[1]["mean"], s[1].std_dev], [data[1].min(), data[1].max(), data[1].mean(), data[1].std()], rtol=1e-5)
    assert planes.statistics(t.limit(0)).count() == 0 and planes.stencil(t.limit(0), lambda b, *at: b, 1).count() == 0
