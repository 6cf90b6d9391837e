"""Frames as tiles of arrays: the physical form for large frames.

One row a tile: frame_id, ch, ty, tx, h, w (size of the frame) and v, the tile's values row by row as an
``array<float>``, missing ones NaN.  A frame of 20 million samples is some 300 rows of a quarter megabyte.
Pixel maths map over arrays without a shuffle, stencils move only the strips along tile edges besides the
tiles themselves, stacks group a tile's lines over frames.  ``from_pixels`` and ``to_pixels`` convert.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import robust
from . import stack as ST
from .tiles import TILE, Kernel

KEY = ("frame_id", "ch")
COLUMNS = ("frame_id", "ch", "ty", "tx", "h", "w", "v")
SCHEMA = "frame_id int, ch int, ty int, tx int, h int, w int, v array<float>"
#: Bytes of one tile's lines over all frames that a task gathers at once, about.
GATHERED = 32 << 20


def _shape(ty: int, tx: int, h: int, w: int, tile: int) -> tuple[int, int]:
    return min(h, (ty + 1) * tile) - ty * tile, min(w, (tx + 1) * tile) - tx * tile


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values).astype(np.float32) if values else np.zeros(0, np.float32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _rows(column: pa.ListArray) -> list[np.ndarray]:
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def cut(data: np.ndarray, frame_id: int, tile: int = TILE) -> Iterator[tuple]:
    """Rows of planar samples data[ch, y, x]."""
    for ch, plane in enumerate(data):
        h, w = plane.shape
        for ty in range(-(-h // tile)):
            for tx in range(-(-w // tile)):
                yield frame_id, ch, ty, tx, h, w, plane[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile].reshape(-1)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    fixed = [pa.array([r[i] for r in rows], pa.int32()) for i in range(6)]
    return pa.RecordBatch.from_arrays([*fixed, _lists([r[6] for r in rows])], names=list(COLUMNS))


def from_pixels(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles of frame_id, ch, y, x, v; samples without a row are missing."""
    sizes = pixels.groupBy(*KEY).agg((F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"))
    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    value = F.coalesce(F.col("v").cast("float"), F.lit(float("nan")).cast("float"))
    placed = pixels.join(sizes, list(KEY)).select(F.col("frame_id").cast("int"), F.col("ch").cast("int"), at("y").alias("ty"), at("x").alias("tx"), "h", "w", (F.col("y") % tile).alias("y"), (F.col("x") % tile).alias("x"), value.alias("v"))
    held = placed.groupBy("frame_id", "ch", "ty", "tx", "h", "w").agg(F.collect_list("y").alias("ys"), F.collect_list("x").alias("xs"), F.collect_list("v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *key, y, x, v in zip(*(batch.column(i).to_pylist() for i in range(6)), *(_rows(batch.column(i)) for i in (6, 7, 8))):
                block = np.full(_shape(*key[2:6], tile), np.nan, np.float32)
                block[y, x] = v
                rows.append((*key, block.reshape(-1)))
            yield batch_of(rows)

    return held.mapInArrow(run, SCHEMA)


def to_pixels(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """frame_id, ch, y, x, v of tiles; NaN becomes NULL."""
    width = F.least(F.lit(tile), F.col("w") - F.col("tx") * tile)
    flat = tiles.select("frame_id", "ch", "ty", "tx", width.alias("n"), F.posexplode("v").alias("i", "v"))
    y, x = F.col("ty") * tile + F.floor(F.col("i") / F.col("n")), F.col("tx") * tile + F.col("i") % F.col("n")
    return flat.select("frame_id", "ch", y.cast("int").alias("y"), x.cast("int").alias("x"), F.when(~F.isnan("v"), F.col("v")).alias("v"))


def mapped(tiles: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """f over the values of every tile; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            new = pa.ListArray.from_arrays(column.offsets, pa.array(np.asarray(f(column.values.to_numpy(zero_copy_only=False)), np.float32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), new], names=list(COLUMNS))

    return tiles.select(*COLUMNS).mapInArrow(run, SCHEMA)


def combined(tiles: DataFrame, other: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """f over the values of every tile and those of the same tile of another image (ch, ty, tx, v), a dark or a flat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [f(a, b) for a, b in zip(_rows(batch.column("v")), _rows(batch.column("v2")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), _lists(new)], names=list(COLUMNS))

    return tiles.join(other.select("ch", "ty", "tx", F.col("v").alias("v2")), ["ch", "ty", "tx"]).select(*COLUMNS, "v2").mapInArrow(run, SCHEMA)


def stencil(tiles: DataFrame, kernel: Kernel, halo: int, tile: int = TILE) -> DataFrame:
    """A kernel (see tiles.Kernel) over every tile with `halo` samples around it.

    A tile goes to its own key whole and to its eight neighbours as strips, so little more than the tiles is moved.
    """
    if halo > tile:
        raise ValueError("a halo is at most a tile wide")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spots = [], []
            for *key, v in zip(*(batch.column(i).to_pylist() for i in range(6)), _rows(batch.column(6))):
                frame, ch, ty, tx, h, w = key
                block = v.reshape(_shape(ty, tx, h, w, tile))
                y0, x0 = ty * tile, tx * tile
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        ny, nx = ty + dy, tx + dx
                        if 0 <= ny and 0 <= nx and ny * tile < h and nx * tile < w:
                            a, b = max(y0, ny * tile - halo), min(y0 + block.shape[0], (ny + 1) * tile + halo)
                            c, d = max(x0, nx * tile - halo), min(x0 + block.shape[1], (nx + 1) * tile + halo)
                            if a < b and c < d:
                                rows.append((frame, ch, ny, nx, h, w, block[a - y0 : b - y0, c - x0 : d - x0].reshape(-1)))
                                spots.append((a, c, d - c))
            made = batch_of(rows)
            yield pa.RecordBatch.from_arrays([*made.columns, *(pa.array([s[i] for s in spots], pa.int32()) for i in range(3))], names=[*COLUMNS, "y0", "x0", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (frame, ch, ty, tx, h, w) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)))):
                top, left = max(0, ty * tile - halo), max(0, tx * tile - halo)
                block = np.full((min(h, (ty + 1) * tile + halo) - top, min(w, (tx + 1) * tile + halo) - left), np.nan)
                pieces = batch.column(6)[i].values
                for y0, x0, n, v in zip(*(pieces.field(c).to_pylist() for c in ("y0", "x0", "n")), _rows(pieces.field("v"))):
                    part = v.reshape(-1, n)
                    block[y0 - top : y0 - top + part.shape[0], x0 - left : x0 - left + n] = part
                new = kernel(block[None], top, left, h, w)[0]
                a, b = _shape(ty, tx, h, w, tile)
                y, x = ty * tile - top, tx * tile - left
                rows.append((frame, ch, ty, tx, h, w, new[y : y + a, x : x + b].reshape(-1)))
            yield batch_of(rows)

    dealt = tiles.select(*COLUMNS).mapInArrow(deal, SCHEMA + ", y0 int, x0 int, n int")
    gathered = dealt.groupBy(*COLUMNS[:6]).agg(F.collect_list(F.struct("y0", "x0", "n", "v")).alias("parts"))  # nine pieces at most
    return gathered.mapInArrow(run, SCHEMA)


def stacked(tiles: DataFrame, mode: ST.StackMode | int, frames: int, sigma_low: float = 2.75, sigma_high: float = 2.75, tile: int = TILE) -> DataFrame:
    """One image (ch, ty, tx, h, w, v, n_low, n_high as arrays) from the tiles of all frames.

    A tile's lines are dealt into as many parts as keep what a task gathers near GATHERED bytes, given the number of frames.
    """
    mode = ST.StackMode(mode)
    if mode == ST.StackMode.AUTO:
        mode = ST.auto_mode(frames)
    parts = max(1, min(tile, -(-4 * frames * tile * tile // GATHERED)))
    lines = -(-tile // parts)
    width = F.least(F.lit(tile), F.col("w") - F.col("tx") * tile)
    rows = F.least(F.lit(tile), F.col("h") - F.col("ty") * tile)
    dealt = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((rows - 1) / lines).cast("int")))).withColumn("v", F.slice("v", (F.col("part") * lines * width + 1).cast("int"), (lines * width).cast("int")))
    gathered = dealt.groupBy("ch", "ty", "tx", "h", "w", "part").agg(F.collect_list("v").alias("vs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for i in range(batch.num_rows):
                m = np.stack(_rows(batch.column(6)[i].values), axis=1).astype(np.float64)
                zero = np.zeros(len(m), np.int64)
                if mode == ST.StackMode.MEDIAN:
                    found = (robust.median_of_rows(m), zero, zero)
                elif mode == ST.StackMode.MEAN:
                    n = (~np.isnan(m)).sum(axis=1)
                    found = (np.where(n > 0, np.nansum(m, axis=1) / np.maximum(n, 1), np.nan), zero, zero)
                elif mode == ST.StackMode.MAD_SIGMA:
                    found = robust.mad_sigma(m, sigma_low, sigma_high)
                elif mode == ST.StackMode.LINEAR_FIT:
                    found = robust.linear_fit(m, sigma_low, sigma_high)
                else:
                    found = robust.sigma_clip(m, sigma_low, sigma_high, None, winsor=mode == ST.StackMode.WINSOR_SIGMA)
                for a, b in zip(out, found):
                    a.append(b)
            arrays = [_lists(out[0]), *(_lists(o).cast(pa.list_(pa.int32())) for o in out[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), *arrays], names=["ch", "ty", "tx", "h", "w", "part", "v", "n_low", "n_high"])

    done = gathered.mapInArrow(run, "ch int, ty int, tx int, h int, w int, part int, v array<float>, n_low array<int>, n_high array<int>")
    joined = done.groupBy("ch", "ty", "tx", "h", "w").agg(F.sort_array(F.collect_list(F.struct("part", "v", "n_low", "n_high"))).alias("p"))
    return joined.select("ch", "ty", "tx", "h", "w", *[F.flatten(F.col(f"p.{c}")).alias(c) for c in ("v", "n_low", "n_high")])


def statistics(tiles: DataFrame, by: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """by, n, min, max, mean, std_dev (population): a row of moments a tile, then one aggregation of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for frame, ch, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _rows(batch.column(2))):
                v = v[~np.isnan(v)].astype(np.float64)
                if len(v):
                    m = float(v.mean())
                    rows.append((frame, ch, len(v), float(v.min()), float(v.max()), m, float(((v - m) ** 2).sum())))
            kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["frame_id", "ch", "n", "lo", "hi", "m", "s"])

    moments = tiles.select("frame_id", "ch", "v").mapInArrow(run, "frame_id int, ch int, n long, lo double, hi double, m double, s double")
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / total
    square = F.sum(F.col("s") + F.col("n") * F.col("m") * F.col("m")) / total
    return moments.groupBy(*by).agg(total.alias("n"), F.min("lo").alias("min"), F.max("hi").alias("max"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std_dev"))
