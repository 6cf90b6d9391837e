"""The relations that the registered queries work on, derived from the test tables.

``px``: each embedding is an 8x8 frame of its label's session.  ``star_cat``: line items as stars of
the supplier's frame.  ``signal``: hourly means of events as rows and columns of a frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("label").alias("session"), F.posexplode("embedding").alias("pos", "v"))
    return e.select("frame_id", "session", F.lit(0).alias("ch"), F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def px_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = (F.col("frame_id") * 31 + F.col("y") * 8 + F.col("x")) % 17 == 0
    return px(spark, sf_dir).withColumn("v", F.when(~gone, F.col("v")))


def px01(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import pixelmath

    return pixelmath.norm_range(px(spark, sf_dir))


def frame_meta(pixels: DataFrame) -> DataFrame:
    """frame_id, session, exposure, location, scale, noise, n_stars, hfr of px frames."""
    from .operators import stats

    by = ["frame_id", "session"]
    loc = stats.median_mad(pixels, by).withColumn("exposure", 30.0 + 10 * (F.col("frame_id") % 4))
    return loc.join(stats.noise(pixels, by), by).withColumn("n_stars", (F.col("frame_id") % 13).cast("int")).withColumn("hfr", 1 + (F.col("frame_id") % 7) / 2)


def star_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("frame_id"), F.col("l_partkey").cast("double").alias("x"), F.col("l_orderkey").cast("double").alias("y"),
        F.col("l_extendedprice").alias("mass"), (F.col("l_quantity") / 10).alias("hfr"), "l_linenumber", "l_discount", "l_tax",
    )


def bright_stars(spark: SparkSession, sf_dir: str, k: int | None = None) -> DataFrame:
    """Stars with their rank in the frame by mass; the k brightest of a frame, or all."""
    from .operators import stars

    return stars.brightest(star_cat(spark, sf_dir), k, order=("x", "y", "hfr", "l_linenumber", "l_discount", "l_tax"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame: row = event type (by name), column = hour since the first one, v = mean value."""
    e = table(spark, sf_dir, "events").select("event_type", F.unix_timestamp("ts").alias("s"), "value")
    first = e.agg(F.floor(F.min("s") / 3600).alias("h0"))
    hours = e.crossJoin(F.broadcast(first)).groupBy("event_type", (F.floor(F.col("s") / 3600) - F.col("h0")).cast("int").alias("x")).agg(F.avg("value").alias("v"))  # first is one row
    kinds = e.select("event_type").distinct().groupBy().agg(F.sort_array(F.collect_list("event_type")).alias("kinds"))  # a handful of types
    return hours.crossJoin(F.broadcast(kinds)).select(F.lit(0).cast("long").alias("frame_id"), F.lit(0).alias("ch"), (F.array_position("kinds", F.col("event_type")) - 1).cast("int").alias("y"), "x", "v")


#: Images of one session have numbers session * IMAGES, session * IMAGES + 1, ...
IMAGES = 1_000_000


def rgb_px(pixels: DataFrame) -> DataFrame:
    """All frames of a session, in order, as channels 0, 1, 2 of one colour image after another: image, ch, y, x, v.

    A colour image has three channels, so one or two frames left over at a session's end make none.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("session").orderBy("frame_id")  # frames, not pixels
    rank = F.row_number().over(order) - 1
    n = F.count("*").over(Window.partitionBy("session"))
    dealt = pixels.select("session", "frame_id").distinct().withColumn("rank", rank).withColumn("n", n).where("rank < n - n % 3")
    chosen = dealt.select("session", "frame_id", (F.col("session").cast("long") * IMAGES + F.floor(F.col("rank") / 3)).alias("image"), (F.col("rank") % 3).cast("int").alias("ch"))
    return pixels.drop("ch").join(chosen, ["session", "frame_id"]).select("image", "ch", "y", "x", "v")
