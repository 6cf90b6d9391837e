"""Canonical relations.

``frames``: one row per frame.  ``pixels``: one row per sample, (frame_id, ch, y, x, v); a missing
sample is NULL, never NaN, because Spark's aggregates skip NULL only.  Operators take and
return these relations as lazy DataFrames; extra columns (a session, say) ride along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = T.StructType(
    [T.StructField(n, T.MapType(T.StringType(), t)) for n, t in (("bools", T.BooleanType()), ("ints", T.IntegerType()), ("floats", T.FloatType()), ("strings", T.StringType()), ("dates", T.StringType()))]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("comments", "history")]
)
FRAMES = T.StructType(
    [
        T.StructField("frame_id", T.IntegerType()),
        T.StructField("file", T.StringType()),
        T.StructField("naxisn", T.ArrayType(T.IntegerType())),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("bitpix", T.IntegerType()),
        T.StructField("bzero", T.FloatType()),
        T.StructField("bscale", T.FloatType()),
        T.StructField("exposure", T.FloatType()),
        T.StructField("header", HEADER),
    ]
)
PIXELS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("frame_id", "ch", "y", "x")] + [T.StructField("v", T.FloatType())])
STARS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("frame_id", "rank", "idx")] + [T.StructField(n, T.DoubleType()) for n in ("value", "x", "y", "mass", "hfr")])
AFFINE = T.StructType([T.StructField(n, T.DoubleType()) for n in "abcdef"])


def nan_to_null(v: Column) -> Column:
    return F.nanvl(v, F.lit(None).cast("double"))


def frame_sizes(pixels: DataFrame) -> DataFrame:
    """frame_id, width, height from the pixels themselves."""
    return pixels.groupBy("frame_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
