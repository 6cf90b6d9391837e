"""Stencils over tiles with halos.

A stencil needs a dense neighbourhood.  ``tiled`` deals the pixels of each frame into square
tiles, copies those near an edge to the neighbouring tiles as well, gathers each tile as one row of
arrays, and runs a numpy kernel over stacks of equal tiles; one shuffle, and memory bounded by a batch of
tiles, whatever the size of a frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256

#: kernel(blocks, y0, x0, height, width) -> blocks of the same shape (..., rows, columns), or a tuple of such; blocks[..., 0, 0] is the frame's (y0, x0),
#: missing values are NaN.
Kernel = Callable[[np.ndarray, int, int, int, int], "np.ndarray | tuple[np.ndarray, ...]"]


def tiled(pixels: DataFrame, kernel: Kernel, halo: int, by: tuple[str, ...] = ("frame_id", "ch"), tile: int = TILE, names: tuple[str, ...] = ("v",)) -> DataFrame:
    """Apply a kernel to every tile; pixels keep their columns, v is replaced.

    Values within `halo` of a tile's inside are given to the kernel; only its inside is used.  names: of what the
    kernel returns; those that pixels don't have become new columns.
    """
    by = list(by)
    tile = max(tile, halo)
    sizes = pixels.groupBy(*by).agg((F.max("y") + 1).alias("__h"), (F.max("x") + 1).alias("__w"))
    near = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - halo) / tile), F.floor(F.col(c) / tile), F.floor((F.col(c) + halo) / tile)))
    columns = pixels.columns
    gathered = (
        pixels.join(sizes, by)
        .withColumn("__ty", F.explode(near("y")))
        .withColumn("__tx", F.explode(near("x")))
        .where("__ty >= 0 AND __tx >= 0 AND __ty * {0} < __h AND __tx * {0} < __w".format(tile))
        .withColumn("v", F.col("v").cast("double"))
        .groupBy(*by, "__ty", "__tx", "__h", "__w")
        .agg(F.collect_list(F.struct(*[c for c in columns if c not in by])).alias("__px"))
    )

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list[tuple]]]:
        """Tiles of a batch that have the same place and size in frames of the same size."""
        held = batch.column("__px")
        px, ends = held.flatten(), held.offsets.to_numpy() - held.offsets[0].as_py()
        py, px_, v = (px.field(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "v"))
        alike: dict[tuple, list[tuple]] = {}
        for i, (ty, tx, h, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("__ty", "__tx", "__h", "__w")))):
            a, b = ends[i], ends[i + 1]
            y0, x0 = max(0, ty * tile - halo), max(0, tx * tile - halo)
            alike.setdefault((ty, tx, y0, x0, h, w), []).append((i, a, py[a:b], px_[a:b], v[a:b].astype(float)))
        yield from alike.items()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, new = [], [], [[] for _ in names]
            for (ty, tx, y0, x0, h, w), tiles in blocks(batch):
                shape = min(h, (ty + 1) * tile + halo) - y0, min(w, (tx + 1) * tile + halo) - x0
                step = max(1, (1 << 21) // (shape[0] * shape[1]))
                for lo in range(0, len(tiles), step):
                    part = tiles[lo : lo + step]
                    stack = np.full((len(part), *shape), np.nan)
                    for k, (_, _, y, x, v) in enumerate(part):
                        stack[k, y - y0, x - x0] = v
                    done = kernel(stack, y0, x0, h, w)
                    for k, (i, a, y, x, _) in enumerate(part):
                        mine = np.flatnonzero((y // tile == ty) & (x // tile == tx))
                        rows.append(np.full(len(mine), i))
                        at.append(a + mine)
                        for out, d in zip(new, done if isinstance(done, tuple) else (done,)):
                            out.append(d[k, y[mine] - y0, x[mine] - x0])
            if not rows:
                continue
            rows, at, px = np.concatenate(rows), np.concatenate(at), batch.column("__px").flatten()
            made = dict(zip(names, (np.concatenate(n) for n in new)))
            made = {n: pa.array(a, pa.float64(), mask=np.isnan(a)) for n, a in made.items()}
            every = [made[c] if c in made else batch.column(c).take(pa.array(rows)) if c in by else px.field(c).take(pa.array(at)) for c in columns]
            extra = [n for n in names if n not in columns]
            yield pa.RecordBatch.from_arrays([*every, *(made[n] for n in extra)], names=[*columns, *extra])

    schema = ", ".join([f"`{f.name}` {'double' if f.name in names or f.name == 'v' else f.dataType.simpleString()}" for f in pixels.schema] + [f"`{n}` double" for n in names if n not in columns])
    return gathered.mapInArrow(run, schema)


def shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """a[..., y + dy, x + dx], NaN outside."""
    out = np.full(a.shape, np.nan)
    h, w = a.shape[-2:]
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    yt, xt = slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx))
    if ys.start < ys.stop and xs.start < xs.stop:
        out[..., ys, xs] = a[..., yt, xt]
    return out
