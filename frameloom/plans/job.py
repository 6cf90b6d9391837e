"""Job documents: JSON operator trees, compiled to lazy DataFrames.

A job is ``{"type": "seq", "steps": [...]}``.  Every operator is a dataclass whose fields are its
JSON parameters with their defaults; ``from_json`` reads a document, ``to_json`` writes one that
can be run again.  ``run`` passes a PipelineState from step to step: relations stay lazy, and
barriers (reference selection, stacking) are small aggregates.  Neutral steps are left out
before anything is planned.
"""

from __future__ import annotations

import dataclasses
import logging
import re
from dataclasses import dataclass, field
from typing import Any, ClassVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align as A
from ..operators import background as B
from ..operators import color as C
from ..operators import pixelmath as P
from ..operators import reference as R
from ..operators import stack as ST
from ..operators import stars as S
from ..operators import stats as X
from ..operators import stencil as N
from ..sources import fits, jpeg, tiff
from ..tables import dropped, stored

log = logging.getLogger("frameloom")
FRAME = ["frame_id"]
PLANE = ["frame_id", "ch"]


@dataclass
class PipelineState:
    """What flows through a job: relations, and the references chosen on the way."""

    spark: SparkSession
    base: str = "."
    out: str = "."
    estimator: int = X.Estimator.MEDIAN_MAD
    pixels: DataFrame | None = None
    frames: DataFrame | None = None  # frame_id, file, exposure
    stars: DataFrame | None = None
    histogram_reference: DataFrame | None = None  # one row: ref_location, ref_scale
    align_reference: tuple[int, DataFrame, int, int] | None = None  # frame id, its stars, width, height
    luminance: DataFrame | None = None
    pending: bool = False  # pixels are the plan of a step that isn't a mere projection
    table: DataFrame | None = None  # the pixels' last table within this sequence

    def settled(self) -> "PipelineState":
        """Pixels (and frames and stars) as tables, if a step is pending; what comes next may read them many times."""
        if not self.pending:
            return self
        keep = lambda df, name: df if df is None or hasattr(df, "_stored_at") else stored(df, name)
        new = dataclasses.replace(self, pixels=keep(self.pixels, "pixels"), frames=keep(self.frames, "frames"), stars=keep(self.stars, "stars"), luminance=keep(self.luminance, "luminance"), pending=False)
        if new.pixels is not self.table:
            dropped(self.table)  # nothing lazy is left that reads it
        return dataclasses.replace(new, table=new.pixels)

    def plane_stats(self, by: list[str] | None = None, where=None) -> DataFrame:
        """by, location, scale by the job's estimator."""
        p = self.pixels if where is None else self.pixels.where(where)
        return X.location_scale(p, by or FRAME, self.estimator)

    def frame_table(self) -> DataFrame:
        """One row a frame with all statistics and, if detected, stars."""
        p = self.pixels
        t = self.frames.select("frame_id", "file", "exposure").join(X.basic(p, FRAME), "frame_id").join(self.plane_stats(), "frame_id").join(X.noise(p.where("ch = 0"), FRAME), "frame_id", "left")
        if self.stars is not None:
            t = t.join(S.summary(self.stars), "frame_id", "left")
        else:
            t = t.withColumn("n_stars", F.lit(None).cast("int")).withColumn("hfr", F.lit(None).cast("double"))
        return t.withColumn("n_stars", F.coalesce("n_stars", F.lit(0)))

    def sizes(self) -> DataFrame:
        return self.pixels.groupBy("frame_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


REGISTRY: dict[str, type["Op"]] = {}


def register(kind: str):
    """Make a dataclass the operator of a type string; a type can be registered once."""

    def add(cls):
        if kind in REGISTRY:
            raise ValueError(f"operator type {kind} is already registered")
        cls = dataclass(cls)
        cls.kind = kind
        REGISTRY[kind] = cls
        return cls

    return add


class Op:
    kind: ClassVar[str] = ""
    #: Projections chain freely; other steps read the pixels more than once and get them as a table.
    projection: ClassVar[bool] = False

    def is_noop(self) -> bool:
        return False

    def apply(self, s: PipelineState) -> PipelineState:
        raise NotImplementedError

    def run(self, s: PipelineState) -> PipelineState:
        if self.is_noop():
            return s
        if self.projection:
            return self.apply(s)
        out = self.apply(s.settled())
        changed = out.pixels is not s.pixels or out.stars is not s.stars
        return dataclasses.replace(out, pending=True) if changed and not isinstance(self, (Sequence, StackBatches)) else out

    def to_json(self) -> dict[str, Any]:
        out: dict[str, Any] = {"type": self.kind}
        for f in dataclasses.fields(self):
            v = getattr(self, f.name)
            out[f.name.rstrip("_")] = v.to_json() if isinstance(v, Op) else [x.to_json() for x in v] if f.name == "steps" else v
        return out


def from_json(doc: dict[str, Any] | None) -> Op | None:
    """An operator tree from a document; unknown types raise, unknown keys are ignored, missing ones take defaults."""
    if doc is None:
        return None
    kind = doc.get("type")
    if kind not in REGISTRY:
        raise ValueError(f"unknown operator type {kind!r}")
    cls, args = REGISTRY[kind], {}
    for f in dataclasses.fields(cls):
        key = f.name.rstrip("_")  # "from" can't be a field's name
        if key in doc:
            v = doc[key]
            if f.name == "steps":
                v = [from_json(x) for x in v]
            elif isinstance(v, dict) and "type" in v:
                v = from_json(v)
            elif f.name in NESTED and isinstance(v, dict):
                v = from_json({"type": NESTED[f.name]} | v)
            args[f.name] = v
    return cls(**args)


#: The operator of nested fields that may be written without a type.
NESTED = {"save": "save", "starDetect": "starDetect", "perBatch": "seq", "debayer": "debayer"}


def _pixels(s: PipelineState, new: DataFrame) -> PipelineState:
    return dataclasses.replace(s, pixels=new)


def _added(s: PipelineState, patterns: list[str], first: int) -> PipelineState:
    p = fits.pixels(s.spark, patterns, s.base, first)
    f = fits.frames(s.spark, patterns, s.base, first).select("frame_id", "file", F.col("exposure").cast("double").alias("exposure"))
    p = p.withColumn("v", F.col("v").cast("double"))
    if s.pixels is None:
        return dataclasses.replace(s, pixels=p, frames=f)
    return dataclasses.replace(s, pixels=s.pixels.unionByName(p), frames=s.frames.unionByName(f))


@register("seq")
class Sequence(Op):
    projection: ClassVar[bool] = True
    steps: list = field(default_factory=list)

    def apply(self, s):
        outer = s.table
        s = dataclasses.replace(s, table=None)  # tables of the caller aren't ours to drop
        for step in self.steps:
            s = step.run(s)
        return dataclasses.replace(s, table=s.table if s.table is not None else outer)


@register("load")
class Load(Op):
    id: int = 0
    fileName: str = ""

    def apply(self, s):
        return _added(s, [self.fileName], self.id)


@register("loadMany")
class LoadMany(Op):
    filePatterns: list = field(default_factory=list)

    def apply(self, s):
        if not self.filePatterns:
            raise ValueError("loadMany: no file patterns")
        return _added(s, list(self.filePatterns), 0)


def file_name(pattern: str, frame_id: int) -> str:
    """The pattern with %d, or a width as in %04d, replaced by the frame's number."""
    return re.sub(r"%(0?\d*)d", lambda m: format(frame_id, m[1] + "d"), pattern)


@register("save")
class Save(Op):
    filePattern: str = ""
    saveMode: int = 0  # 0 own range, 1 [0, 1], 2 [0, 255], 3 [0, 65535]
    gamma: float = 1.0

    def is_noop(self):
        return not self.filePattern

    def apply(self, s):
        self.write(s, s.pixels, s.frames)
        return s

    def write(self, s: PipelineState, pixels: DataFrame, frames: DataFrame | None = None) -> None:
        """Encode and write in tasks, one a frame; previews are encoded by the driver's JVM, one at a time."""
        name = fits.safe_path(self.filePattern).lower()
        low, high = {0: (None, None), 1: (0.0, 1.0), 2: (0.0, 255.0), 3: (0.0, 65535.0)}[self.saveMode]
        gamma, zipped = self.gamma, name.endswith((".gz", ".gzip"))
        bare = re.sub(r"\.(gz|gzip)$", "", name)

        def span(data):
            return (low, high) if low is not None else (float(np.nanmin(data)), float(np.nanmax(data)))

        if bare.endswith(fits.SUFFIXES):
            one = lambda data, e: fits.encode(fits.Image(data, exposure=e), zipped)
        elif bare.endswith((".tif", ".tiff")):
            one = lambda data, e: tiff.encode(data, *span(data), gamma)
        elif bare.endswith((".jpg", ".jpeg")):
            one = lambda data, e: fits.encode(fits.Image(data))
        else:
            raise ValueError(f"save: unknown suffix of {self.filePattern}")
        encoded, pattern = fits.images(pixels, frames, one), self.filePattern
        if not bare.endswith((".jpg", ".jpeg")):
            fits.written(encoded, s.out, lambda i: file_name(pattern, int(i)))
            return
        for row in encoded.toLocalIterator():
            data = fits.parse(bytes(row.content)).data
            fits.write_bytes(s.spark, f"{s.out.rstrip('/')}/{file_name(pattern, row.frame_id)}", jpeg.encode(s.spark, data, *span(data), gamma))


@register("calibrate")
class Calibrate(Op):
    dark: str = ""
    flat: str = ""

    def is_noop(self):
        return not (self.dark or self.flat)

    def apply(self, s):
        one = lambda name, i: fits.pixels(s.spark, [name], s.base, i).select("ch", "y", "x", F.col("v").cast("double").alias("v")) if name else None
        return _pixels(s, P.calibrate(s.pixels, one(self.dark, -1), one(self.flat, -2)))


@register("badPixel")
class BadPixel(Op):
    sigmaLow: float = 3.0
    sigmaHigh: float = 5.0
    debayer: Any = None

    def is_noop(self):
        return self.sigmaLow == 0 or self.sigmaHigh == 0

    def apply(self, s):
        d = self.debayer
        if d is not None and d.channel:
            new = N.bad_pixels_bayer(s.pixels, d.channel, d.colorFilterArray, self.sigmaLow, self.sigmaHigh)
        else:
            new = N.bad_pixels(s.pixels, self.sigmaLow, self.sigmaHigh)
        return _pixels(s, new.drop("bad"))


@register("debayer")
class Debayer(Op):
    channel: str = ""
    colorFilterArray: str = "RGGB"

    def is_noop(self):
        return not (self.channel and self.colorFilterArray)

    def apply(self, s):
        return _pixels(s, N.debayer(s.pixels, self.channel, self.colorFilterArray))


@register("debandHoriz")
class DebandHoriz(Op):
    percentile: float = 50.0
    window: int = 128
    sigma: float = 3.0
    vertical: ClassVar[bool] = False

    def is_noop(self):
        return not 0 < self.percentile < 100 or self.window <= 0

    def apply(self, s):
        return _pixels(s, N.deband(s.pixels, s.plane_stats(PLANE), self.percentile, self.window, self.sigma, self.vertical))


@register("debandVert")
class DebandVert(DebandHoriz):
    vertical: ClassVar[bool] = True


@register("scaleOffset")
class ScaleOffset(Op):
    projection: ClassVar[bool] = True
    scale: float = 1.0
    offset: float = 0.0

    def apply(self, s):
        return _pixels(s, P.scale_offset(s.pixels, self.scale, self.offset))


@register("bin")
class Bin(Op):
    binSize: int = 1

    def is_noop(self):
        return self.binSize <= 1

    def apply(self, s):
        return _pixels(s, N.bin_pixels(s.pixels, self.binSize))


@register("starDetect")
class StarDetect(Op):
    radius: int = 16
    sigma: float = 10.0
    badPixelSigma: float = 0.0
    inOutRatio: float = 10.0
    save: Any = None

    def is_noop(self):
        return self.radius == 0 or self.sigma == 0

    def apply(self, s):
        found = S.detect(s.pixels, s.plane_stats(FRAME, F.col("ch") == 0), self.radius, self.sigma, self.inOutRatio, self.badPixelSigma)
        s = dataclasses.replace(s, stars=found)
        if self.save is not None and not self.save.is_noop():
            mask = N.star_mask(found, s.sizes(), 2.0)
            drawn = s.pixels.where("ch = 0").select("frame_id", "ch", "y", "x").join(mask, ["frame_id", "y", "x"], "left").fillna(0.0, ["v"])
            self.save.write(s, drawn)
        return s


@register("backExtract")
class BackExtract(Op):
    gridSize: int = 0
    hfrFactor: float = 4.0
    sigma: float = 1.5
    clip: int = 0
    save: Any = None

    def is_noop(self):
        return self.gridSize <= 0

    def apply(self, s):
        model = B.finished(B.cells(s.pixels, self.gridSize, self.sigma, s.stars, self.hfrFactor), self.clip)
        out = B.subtract(s.pixels, model, keep_background=True)
        if self.save is not None and not self.save.is_noop():
            self.save.write(s, out.select("frame_id", "ch", "y", "x", F.col("background").alias("v")))
        return _pixels(s, out.drop("background"))


@register("selectRef")
class SelectRef(Op):
    target: int = 0  # 0 alignment, 1 histogram
    mode: str = "%starsHFR"
    starDetect: Any = None

    def is_noop(self):
        return str(self.mode) == ""

    def apply(self, s):
        if (s.align_reference if self.target == 0 else s.histogram_reference) is not None:
            return s
        mode = str(self.mode)
        if mode[0] != "%" and not mode.lstrip("-").isdigit():
            other = _added(PipelineState(s.spark, s.base, s.out, s.estimator), [mode], -3)
            other = (self.starDetect or StarDetect()).run(other)
            chosen, at, ref_id = other, F.lit(True), -3
        else:
            row = R.select_reference(s.frame_table(), mode).select("frame_id").first()  # one row
            if row is None:
                raise ValueError("selectRef: no frame to choose")
            chosen, at, ref_id = s, F.col("frame_id") == row.frame_id, row.frame_id
        if self.target == 1:
            ls = chosen.plane_stats(FRAME, at).select(F.col("location").alias("ref_location"), F.col("scale").alias("ref_scale"))
            return dataclasses.replace(s, histogram_reference=s.spark.createDataFrame(ls.collect(), ls.schema))  # one row
        if chosen.stars is None:
            raise ValueError("selectRef: alignment needs starDetect before it")
        size = chosen.sizes().where(at).first()
        return dataclasses.replace(s, align_reference=(ref_id, stored(chosen.stars.where(at), "reference_stars"), size.width, size.height))


@register("filter")
class Filter(Op):
    minStars: int = 0

    def is_noop(self):
        return self.minStars <= 0

    def apply(self, s):
        found = s.frames.select("frame_id").limit(0) if s.stars is None else S.summary(s.stars).where(F.col("n_stars") >= self.minStars)
        kept = found.select("frame_id")  # frames without stars have no row
        only = lambda df: None if df is None else df.join(kept, "frame_id", "left_semi")
        return dataclasses.replace(s, pixels=only(s.pixels), frames=only(s.frames), stars=only(s.stars))


@register("exportStats")
class ExportStats(Op):
    fileName: str = "out.html"

    def is_noop(self):
        return not self.fileName

    def apply(self, s):
        fits.write_bytes(s.spark, f"{s.out.rstrip('/')}/{fits.safe_path(self.fileName)}", R.stats_html(s.frame_table()).encode())
        return s


@register("matchHist")
class MatchHist(Op):
    mode: int = 2

    def is_noop(self):
        return self.mode == 0

    def apply(self, s):
        if s.histogram_reference is None:
            raise ValueError("matchHist: no histogram reference was selected")
        return _pixels(s, P.match_histogram(s.pixels, self.mode, s.plane_stats(), s.histogram_reference))


@register("align")
class Align(Op):
    k: int = 50
    threshold: float = 1.0
    oobMode: int = 0  # 0 missing, 1 the reference's location, 2 the frame's own

    def is_noop(self):
        return self.k <= 0

    def apply(self, s):
        if s.align_reference is None or s.stars is None:
            raise ValueError("align: no alignment reference was selected")
        ref_id, ref_stars, width, height = s.align_reference
        found = A.align(s.stars, s.sizes(), ref_stars, width, height, ref_id, self.k, self.threshold)
        t = found.withColumn("width", F.lit(width)).withColumn("height", F.lit(height))
        warped = N.project(s.pixels, t)
        if self.oobMode:
            own = s.plane_stats().select("frame_id", F.col("location").alias("__fill"))
            if self.oobMode == 1:
                own = own.select("frame_id").crossJoin(F.broadcast(s.histogram_reference.select(F.col("ref_location").alias("__fill"))) if s.histogram_reference is not None else s.spark.range(1).select(F.lit(0.0).alias("__fill")))  # one row
            warped = warped.join(own, "frame_id").withColumn("v", F.coalesce("v", "__fill")).drop("__fill")
        only = lambda df: df.join(found.select("frame_id"), "frame_id", "left_semi")
        x, y = A.apply_affine("", F.col("x"), F.col("y"))
        stars = s.stars.join(found, "frame_id").withColumn("__x", x).withColumn("y", y).withColumn("x", F.col("__x")).select(*s.stars.columns)
        return dataclasses.replace(s, pixels=warped, frames=only(s.frames), stars=stars)


@register("stack")
class Stack(Op):
    mode: int = 6
    weighting: int = 0
    sigmaLow: float = 2.75
    sigmaHigh: float = 2.75

    def apply(self, s):
        n = s.frames.count()
        if not n:
            raise ValueError("stack: no frames are left")
        mode = ST.auto_mode(n) if self.mode == ST.StackMode.AUTO else ST.StackMode(self.mode)
        p, weight = s.pixels, None
        if self.weighting:
            w = ST.weights(s.frame_table(), ST.Weighting(self.weighting))
            if w.where("weight IS NULL").limit(1).count():
                raise ValueError("stack: a frame has no exposure, noise or HFR to weigh it by")
            p, weight = p.join(w, "frame_id"), "weight"
        done = ST.stack(p, mode, ("ch", "y", "x"), self.sigmaLow, self.sigmaHigh, weight)
        out = done.select(F.lit(0).alias("frame_id"), "ch", "y", "x", "v")
        f = s.frames.agg(F.sum("exposure").alias("exposure")).select(F.lit(0).alias("frame_id"), F.lit("stack").alias("file"), "exposure")
        return dataclasses.replace(s, pixels=out, frames=f, stars=None)


@register("stackBatches")
class StackBatches(Op):
    projection: ClassVar[bool] = True
    perBatch: Any = None

    def apply(self, s):
        """The batch pipeline over all frames at once: Spark spills where a single machine would batch."""
        return self.perBatch.run(s) if self.perBatch is not None else s


@register("normRange")
class NormRange(Op):
    def apply(self, s):
        return _pixels(s, P.norm_range(s.pixels))


@register("stretch")
class Stretch(Op):
    location: float = 0.1
    scale: float = 0.004

    def is_noop(self):
        return self.location == 0 and self.scale == 0

    def apply(self, s):
        return _pixels(s, P.stretch(s.pixels, self.location, self.scale, estimator=s.estimator))


@register("midtones")
class Midtones(Op):
    mid: float = 0.0
    black: float = 1.0

    def is_noop(self):
        return self.mid == 0

    def apply(self, s):
        return _pixels(s, P.midtones(s.pixels, self.mid, self.black, s.plane_stats()))


@register("gamma")
class Gamma(Op):
    projection: ClassVar[bool] = True
    gamma: float = 1.0

    def apply(self, s):
        return _pixels(s, P.gamma(s.pixels, self.gamma))


@register("gammaPP")
class GammaPP(Op):
    gamma: float = 1.0
    sigma: float = 1.0

    def is_noop(self):
        return self.gamma == 1

    def apply(self, s):
        return _pixels(s, P.gamma_pp(s.pixels, self.gamma, self.sigma, s.plane_stats()))


@register("scaleBlack")
class ScaleBlack(Op):
    location: float = 0.0

    def is_noop(self):
        return self.location == 0

    def apply(self, s):
        return _pixels(s, P.scale_black(s.pixels, self.location, s.plane_stats()))


@register("gaussianBlur")
class GaussianBlur(Op):
    sigma: float = 2.0

    def is_noop(self):
        return self.sigma == 0

    def apply(self, s):
        return _pixels(s, N.gaussian_blur(s.pixels, self.sigma))


@register("unsharpMask")
class UnsharpMask(Op):
    sigma: float = 1.5
    gain: float = 0.0
    threshold: float = 1.0

    def is_noop(self):
        return self.sigma == 0 or self.gain == 0

    def apply(self, s):
        limits = s.plane_stats(PLANE).join(X.basic(s.pixels, PLANE), PLANE)
        return _pixels(s, N.unsharp_mask(s.pixels, limits, self.sigma, self.gain, self.threshold))


@register("rgbCombine")
class RGBCombine(Op):
    def apply(self, s):
        """Frames 0, 1, 2 become the channels; frame 3, if there is one, the luminance."""
        rows = s.frames.orderBy("frame_id").limit(5).collect()  # three or four frames
        if len(rows) not in (3, 4):
            raise ValueError("rgbCombine: three or four frames are needed")
        ids = [r.frame_id for r in rows]
        ch = F.create_map(*[x for i, f in enumerate(ids) for x in (F.lit(f), F.lit(i))])
        numbered = s.pixels.where("ch = 0").withColumn("ch", F.element_at(ch, F.col("frame_id"))).withColumn("frame_id", F.lit(0))
        lum = numbered.where("ch = 3").select("y", "x", "v") if len(ids) == 4 else None
        out = C.planar(C.rgb_combine(numbered.where("ch < 3"), ("frame_id",))).select("frame_id", "ch", "y", "x", "v")
        f = s.spark.createDataFrame([(0, "rgb", float(sum(r.exposure or 0 for r in rows[:3])))], "frame_id int, file string, exposure double")
        stars = s.stars
        if s.align_reference is not None:
            stars = s.align_reference[1].withColumn("frame_id", F.lit(0))
        return dataclasses.replace(s, pixels=out, frames=f, luminance=lum, stars=stars)


def _on_colour(s: PipelineState, change) -> PipelineState:
    new = C.planar(change(C.wide(s.pixels))).select("frame_id", "ch", "y", "x", "v")
    return _pixels(s, new)


@register("rgbBalance")
class RGBBalance(Op):
    block: int = 16
    border: float = 0.1
    skipBright: float = 0.0
    skipDim: float = 0.75
    shadows: dict = field(default_factory=lambda: {"R": 1, "G": 1, "B": 1})
    highlights: dict = field(default_factory=lambda: {"R": 1, "G": 1, "B": 1})

    def apply(self, s):
        if s.stars is None or s.stars.isEmpty():
            raise ValueError("rgbBalance: no stars were detected")
        tint = lambda d: tuple(float(d.get(k, d.get(k.lower(), 1))) for k in "RGB")
        ls = s.plane_stats(PLANE)
        return _on_colour(s, lambda w: C.rgb_balance(w, ls, s.stars, self.block, self.border, self.skipBright, self.skipDim, tint(self.shadows), tint(self.highlights)))


@register("rgbToHSLuv")
class RGBToHSLuv(Op):
    projection: ClassVar[bool] = True
    def apply(self, s):
        return _on_colour(s, C.rgb_to_hsluv)


@register("hsluvToRGB")
class HSLuvToRGB(Op):
    projection: ClassVar[bool] = True
    def apply(self, s):
        return _on_colour(s, C.hsluv_to_rgb)


@register("hslApplyLum")
class HSLApplyLum(Op):
    def apply(self, s):
        return s if s.luminance is None else _on_colour(s, lambda w: C.apply_luminance(w, s.luminance))


@register("hslScaleOffsetChannel")
class HSLScaleOffsetChannel(Op):
    projection: ClassVar[bool] = True
    channelID: int = 2
    scale: float = 1.0
    offset: float = 0.0

    def apply(self, s):
        return _pixels(s, P.scale_offset(s.pixels, self.scale, self.offset, F.col("ch") == self.channelID))


def _lightness_stats(s: PipelineState) -> DataFrame:
    return s.plane_stats(FRAME, F.col("ch") == 2)


@register("hslNeutralizeBackground")
class HSLNeutralizeBackground(Op):
    sigmaLow: float = 0.75
    sigmaHigh: float = 1.0

    def is_noop(self):
        return self.sigmaLow <= 0 and self.sigmaHigh <= 0

    def apply(self, s):
        ls = _lightness_stats(s)
        return _on_colour(s, lambda w: C.neutralize_background(w, self.sigmaLow, self.sigmaHigh, ls))


@register("hslSaturationGamma")
class HSLSaturationGamma(Op):
    gamma: float = 1.75
    sigma: float = 0.75

    def is_noop(self):
        return self.gamma == 1

    def apply(self, s):
        ls = _lightness_stats(s)
        return _on_colour(s, lambda w: C.saturation_gamma(w, self.gamma, self.sigma, ls))


@register("hslSelectiveSaturation")
class HSLSelectiveSaturation(Op):
    projection: ClassVar[bool] = True
    from_: float = 295.0
    to: float = 40.0
    factor: float = 1.0

    def is_noop(self):
        return self.factor == 1

    def apply(self, s):
        return _on_colour(s, lambda w: C.selective_saturation(w, self.from_, self.to, self.factor))


@register("hslRotateHue")
class HSLRotateHue(Op):
    from_: float = 100.0
    to: float = 190.0
    offset: float = 0.0
    sigma: float = 1.0

    def is_noop(self):
        return self.offset == 0

    def apply(self, s):
        ls = _lightness_stats(s)
        return _on_colour(s, lambda w: C.rotate_hue(w, self.from_, self.to, self.offset, self.sigma, ls))


@register("hslSCNR")
class HSLSCNR(Op):
    projection: ClassVar[bool] = True
    factor: float = 0.0

    def is_noop(self):
        return self.factor == 0

    def apply(self, s):
        return _on_colour(s, lambda w: C.scnr(w, self.factor))


def _on_lightness(s: PipelineState, op, *args, **kwargs) -> PipelineState:
    return _pixels(s, op(s.pixels, *args, where=F.col("ch") == 2, **kwargs))


@register("hslStretch")
class HSLStretch(Stretch):
    def apply(self, s):
        return _on_lightness(s, P.stretch, self.location, self.scale, estimator=s.estimator)


@register("hslMidtones")
class HSLMidtones(Midtones):
    mid: float = 0.0
    black: float = 2.0

    def apply(self, s):
        return _on_lightness(s, P.midtones, self.mid, self.black, _lightness_stats(s))


@register("hslGamma")
class HSLGamma(Gamma):
    projection: ClassVar[bool] = True
    def apply(self, s):
        return _on_lightness(s, P.gamma, self.gamma)


@register("hslGammaPP")
class HSLGammaPP(GammaPP):
    def apply(self, s):
        return _on_lightness(s, P.gamma_pp, self.gamma, self.sigma, _lightness_stats(s))


@register("HSLUnsharpMask")
class HSLUnsharpMask(UnsharpMask):
    sigma: float = 1.5
    gain: float = 0.0
    threshold: float = 0.75

    def apply(self, s):
        limits = s.plane_stats(PLANE).join(X.basic(s.pixels, PLANE), PLANE)
        return _on_lightness(s, N.unsharp_mask, limits, self.sigma, self.gain, self.threshold)


@register("hslScaleBlack")
class HSLScaleBlack(ScaleBlack):
    def apply(self, s):
        from ..functions import colors

        return _on_lightness(s, P.scale_black, float(colors.lightness(np.array(self.location))), _lightness_stats(s))
