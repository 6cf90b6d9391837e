"""Choice of a reference frame: aggregates over one row a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_stars_hfr(frames: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The frame with the largest stars / HFR (0 if either is 0 or missing); the least frame_id of equal ones."""
    score = F.when((F.col("n_stars") > 0) & (F.col("hfr") > 0), F.col("n_stars") / F.col("hfr")).otherwise(0.0)
    best = frames.withColumn("score", score).groupBy(*by).agg(F.max(F.struct("score", (-F.col("frame_id")).alias("m"))).alias("b"))
    return best.select(*by, (-F.col("b.m")).alias("frame_id"), F.col("b.score").alias("score"))


def by_median_location(frames: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The frame whose location is nearest to the median location; the least frame_id of equal ones."""
    by = list(by)
    mid = frames.groupBy(*by).agg(F.median("location").alias("mid"))
    joined = frames.join(mid, by) if by else frames.crossJoin(F.broadcast(mid))  # mid is one row
    best = joined.groupBy(*by).agg(F.min(F.struct(F.abs(F.col("location") - F.col("mid")).alias("d"), "frame_id", "location")).alias("b"))
    return best.select(*by, F.col("b.frame_id").alias("frame_id"), F.col("b.location").alias("location"))


def select_reference(frames: DataFrame, mode: str | int = "%starsHFR") -> DataFrame:
    """One row of frames.

    Modes: "%starsHFR", "%location", "%rgb" (the fourth frame if there are more than three, else as
    %starsHFR), an integer (position in frame_id order), anything else a file name.  Empty: no row.
    """
    text = str(mode)
    at = F.row_number().over(Window.orderBy("frame_id")) - 1  # one row a frame
    if text == "%rgb":
        text = "3" if frames.limit(4).count() > 3 else "%starsHFR"
    if text == "%starsHFR":
        return frames.join(F.broadcast(by_stars_hfr(frames).select("frame_id")), "frame_id", "left_semi")
    if text == "%location":
        return frames.join(F.broadcast(by_median_location(frames).select("frame_id")), "frame_id", "left_semi")
    if text.lstrip("-").isdigit():
        return frames.withColumn("__at", at).where(F.col("__at") == int(text)).drop("__at")
    return frames.where(F.col("file") == text) if text else frames.limit(0)


def export_stats(frames: DataFrame) -> DataFrame:
    """Per-frame statistics as the chart shows them, by frame_id."""
    return frames.select("frame_id", "min", "mean", "max", "location", "scale", "n_stars", "hfr").orderBy("frame_id")


def stats_html(frames: DataFrame) -> str:
    """A self-contained HTML page with one line a statistic, each divided by its median."""
    rows = export_stats(frames).toPandas()  # one row a frame
    lines = []
    for c in ("min", "mean", "max", "location", "scale", "n_stars", "hfr"):
        v = rows[c].astype(float)
        m = v.median() or 1.0
        lines.append({"name": c, "values": [None if x != x else round(float(x / m), 6) for x in v]})
    import json

    data = json.dumps({"id": rows["frame_id"].astype(int).tolist(), "lines": lines})
    return f"""<!doctype html><meta charset="utf-8"><title>Frame statistics</title><h1>Frame statistics</h1>
<svg id="c" viewBox="0 0 1000 420" width="1000" height="420"></svg><div id="k"></div><script>
const d={data}, c=document.getElementById("c"), k=document.getElementById("k"), n=Math.max(1,d.id.length-1);
const all=d.lines.flatMap(l=>l.values).filter(v=>v!==null), lo=Math.min(...all,0), hi=Math.max(...all,1);
d.lines.forEach((l,i)=>{{const p=document.createElementNS("http://www.w3.org/2000/svg","polyline"), h=`hsl(${{i*51}} 70% 40%)`;
p.setAttribute("points",l.values.map((v,j)=>v===null?null:`${{10+980*j/n}},${{410-400*(v-lo)/(hi-lo||1)}}`).filter(x=>x).join(" "));
p.setAttribute("fill","none");p.setAttribute("stroke",h);c.append(p);
const s=document.createElement("span");s.textContent=l.name+" ";s.style.color=h;k.append(s)}});</script>
"""
