"""All registered queries of the image engine, and the same in DuckDB's SQL.

Queries call the operators on the relations of ``views``; the SQL is written independently
of them; operators that loop on data are recursive there.  What leaves SQL (star detection, files) has none and is
tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as V
from .operators import align, background, color, pixelmath, planes, reference, stack, stars, stats, stencil
from .sources import fits, tiff
from .streaming import incremental

SESSION = ("session", "y", "x")
FRAME = ["frame_id"]


def _round(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c).cast("double"), 6))
    return df


def _longs(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


PX = """
WITH px AS (
  SELECT vec_id AS frame_id, label AS session, 0 AS ch, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x,
         CAST(embedding[p + 1] AS DOUBLE) AS v
  FROM embeddings, (SELECT unnest(range(0, 64)) AS p)),
pm AS (SELECT frame_id, session, ch, y, x, CASE WHEN (frame_id * 31 + y * 8 + x) % 17 = 0 THEN NULL ELSE v END AS v FROM px),
sp AS (SELECT frame_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1),
p1 AS (SELECT px.frame_id, session, ch, y, x, CASE WHEN hi - lo >= 1e-8 THEN (v - lo) / (hi - lo) ELSE v END AS v FROM px JOIN sp USING (frame_id)),
md AS (SELECT frame_id, session, median(v) AS location FROM px GROUP BY 1, 2),
ls AS (SELECT px.frame_id, px.session, any_value(location) AS location, 1.4826 * median(abs(v - location)) AS scale FROM px JOIN md USING (frame_id) GROUP BY 1, 2),
md1 AS (SELECT frame_id, median(v) AS location FROM p1 GROUP BY 1),
ls1 AS (SELECT p1.frame_id, any_value(location) AS location, 1.4826 * median(abs(v - location)) AS scale FROM p1 JOIN md1 USING (frame_id) GROUP BY 1),
dx AS (SELECT frame_id, session, y, x, CASE WHEN x BETWEEN 1 AND 6 THEN lag(v) OVER w - 2 * v + lead(v) OVER w END AS d FROM px WINDOW w AS (PARTITION BY frame_id, y ORDER BY x)),
dd AS (SELECT frame_id, y, x, CASE WHEN y BETWEEN 1 AND 6 THEN lag(d) OVER w - 2 * d + lead(d) OVER w END AS l FROM dx WINDOW w AS (PARTITION BY frame_id, x ORDER BY y)),
ns AS (SELECT frame_id, sum(abs(l)) * sqrt(pi() / 2) / (6.0 * count(l)) AS noise FROM dd GROUP BY 1),
fm AS (SELECT ls.*, 30.0 + 10 * (frame_id % 4) AS exposure, noise, CAST(frame_id % 13 AS INTEGER) AS n_stars, 1 + (frame_id % 7) / 2.0 AS hfr FROM ls JOIN ns USING (frame_id))
"""


# ---- stacking


def _stacked(spark, sf_dir, mode, **kwargs):
    return _longs(_round(stack.stack(V.px_missing(spark, sf_dir), mode, SESSION, **kwargs), "v"), "n_low", "n_high")


@query(PX + "SELECT session, y, x, round(median(v), 6) AS v, CAST(0 AS BIGINT) AS n_low, CAST(0 AS BIGINT) AS n_high FROM pm GROUP BY 1, 2, 3")
def stack_median(spark, sf_dir):
    return _stacked(spark, sf_dir, stack.StackMode.MEDIAN)


@query(PX + "SELECT session, y, x, round(avg(v), 6) AS v, CAST(0 AS BIGINT) AS n_low, CAST(0 AS BIGINT) AS n_high FROM pm GROUP BY 1, 2, 3")
def stack_mean(spark, sf_dir):
    return _stacked(spark, sf_dir, stack.StackMode.MEAN)


def _weighted(spark, sf_dir, how, mode=stack.StackMode.MEAN, **kwargs):
    pixels = V.px_missing(spark, sf_dir)
    w = stack.weights(V.frame_meta(V.px(spark, sf_dir)), how, ("session",))
    return _longs(_round(stack.stack(pixels.join(w, "frame_id"), mode, SESSION, weight="weight", **kwargs), "v"), "n_low", "n_high")


_WMEAN = "SELECT session, y, x, round(sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END), 6) AS v, CAST(0 AS BIGINT) AS n_low, CAST(0 AS BIGINT) AS n_high FROM pm JOIN wt USING (frame_id) GROUP BY 1, 2, 3"
_QW = ", qs AS (SELECT session, min({0}) AS lo, max({0}) AS hi FROM fm GROUP BY 1), wt AS (SELECT frame_id, 1 / (1 + 4 * CASE WHEN hi > lo THEN ({0} - lo) / (hi - lo) ELSE 0 END) AS w FROM fm JOIN qs USING (session)) "


@query(PX + ", wt AS (SELECT frame_id, exposure AS w FROM fm) " + _WMEAN)
def stack_wmean_exposure(spark, sf_dir):
    return _weighted(spark, sf_dir, stack.Weighting.EXPOSURE)


@query(PX + _QW.format("noise") + _WMEAN)
def stack_wmean_noise(spark, sf_dir):
    return _weighted(spark, sf_dir, stack.Weighting.INVERSE_NOISE)


@query(PX + _QW.format("hfr") + _WMEAN)
def stack_wmean_hfr(spark, sf_dir):
    return _weighted(spark, sf_dir, stack.Weighting.INVERSE_HFR)


_MAD = """, a AS (SELECT session, y, x, median(v) AS m FROM pm GROUP BY 1, 2, 3),
b AS (SELECT session, y, x, any_value(m) AS m, 1.4826 * median(abs(v - m)) AS s FROM pm JOIN a USING (session, y, x) GROUP BY 1, 2, 3)
SELECT session, y, x, round(avg(CASE WHEN v >= m - {0} * s AND v <= m + {0} * s THEN v END), 6) AS v,
       count(CASE WHEN v < m - {0} * s THEN 1 END) AS n_low, count(CASE WHEN v > m + {0} * s THEN 1 END) AS n_high
FROM pm JOIN b USING (session, y, x) GROUP BY 1, 2, 3"""


@query(PX + _MAD.format("2.0"))
def stack_mad_sigma(spark, sf_dir):
    return _stacked(spark, sf_dir, stack.StackMode.MAD_SIGMA, sigma_low=2.0, sigma_high=2.0)


def _clip_sql(sigma: float, weighted: bool, passes: int = 14) -> str:
    """Passes spelled out: s<i> is the set before pass i, r<i> its statistics and what the pass drops."""
    g = "session, y, x"
    w = ", w" if weighted else ""
    parts = [f"s0 AS (SELECT {g}, v{w} FROM pm{' JOIN wt USING (frame_id)' if weighted else ''} WHERE v IS NOT NULL)"]
    for i in range(passes):
        parts.append(f"b{i} AS (SELECT {g}, median(v) AS m, avg(v) AS a, stddev_pop(v) AS d FROM s{i} GROUP BY {g})")
        inside = f"v >= m - {sigma} * d AND v <= m + {sigma} * d"
        value = f"sum(CASE WHEN {inside} THEN v * w END) / sum(CASE WHEN {inside} THEN w END)" if weighted else "any_value(a)"
        parts.append(f"r{i} AS (SELECT {g}, {value} AS v, count(CASE WHEN v < m - {sigma} * d THEN 1 END) AS lo, count(CASE WHEN v > m + {sigma} * d THEN 1 END) AS hi, count(CASE WHEN {inside} THEN 1 END) AS n FROM s{i} JOIN b{i} USING ({g}) GROUP BY {g})")
        parts.append(f"s{i + 1} AS (SELECT {g}, s.v{', s.w' if weighted else ''} FROM s{i} s JOIN b{i} USING ({g}) JOIN (SELECT {g} FROM r{i} WHERE lo + hi > 0 AND n > 1) USING ({g}) WHERE s.v >= m - {sigma} * d AND s.v <= m + {sigma} * d)")
    every = " UNION ALL ".join(f"SELECT {g}, {i} AS i, v, lo, hi FROM r{i}" for i in range(passes))
    return f", {', '.join(parts)} SELECT {g}, round(arg_max(v, i), 6) AS v, CAST(sum(lo) AS BIGINT) AS n_low, CAST(sum(hi) AS BIGINT) AS n_high FROM ({every}) GROUP BY {g}"


@query(PX + _clip_sql(2.75, False))
def stack_sigma_clip(spark, sf_dir):
    return _stacked(spark, sf_dir, stack.StackMode.SIGMA)


@query(PX + ", wt AS (SELECT frame_id, exposure AS w FROM fm)" + _clip_sql(2.75, True))
def stack_sigma_clip_weighted(spark, sf_dir):
    return _weighted(spark, sf_dir, stack.Weighting.EXPOSURE, stack.StackMode.SIGMA)


_LISTS = PX.replace("WITH ", "WITH RECURSIVE ", 1) + ", ls0 AS (SELECT session, y, x, list(v ORDER BY v) AS a FROM pm WHERE v IS NOT NULL GROUP BY 1, 2, 3)"
_SD, _MEAN = "list_aggregate({0}, 'stddev_pop')", "list_aggregate({0}, 'avg')"


def _winsor_sql(low: float, high: float, weighted: bool = False) -> str:
    """One row a step: the set a, its winsorised form b and sigma; phase 0 pulls b in, 1 clips a, 2 is done.

    With weights the lists hold values, and w the weights beside them; the result is the weighted mean of what is left.
    """
    clip = "list_transform(b, lambda v: least(greatest(v, m - 1.5 * s), m + 1.5 * s))"
    inside = f"v >= m - {low} * s AND v <= m + {high} * s"
    kept = f"list_filter(a, lambda v: {inside})"
    kept_w = f"list_filter(w, lambda v, i: a[i] >= m - {low} * s AND a[i] <= m + {high} * s)"
    value = "list_sum(list_transform(na, lambda v, i: v * nw[i])) / list_sum(nw)" if weighted else _MEAN.format("a")
    w = "list(w ORDER BY v, w)" if weighted else "list(1 ORDER BY v)"
    source = f"(SELECT session, y, x, list(v ORDER BY v{', w' if weighted else ''}) AS a, {w} AS w FROM pm {'JOIN wt USING (frame_id) ' if weighted else ''}WHERE v IS NOT NULL GROUP BY 1, 2, 3)"
    return f""", it AS (SELECT session, y, x, 0 AS i, a, w, a AS b, list_median(a) AS m, {_SD.format('a')} AS s, 0 AS phase, CAST(NULL AS DOUBLE) AS r, CAST(0 AS BIGINT) AS lo, CAST(0 AS BIGINT) AS hi FROM {source}
UNION ALL SELECT session, y, x, i + 1, CASE WHEN phase = 1 THEN na ELSE a END, CASE WHEN phase = 1 THEN nw ELSE w END, CASE WHEN phase = 1 THEN na ELSE nb END, CASE WHEN phase = 1 THEN list_median(na) ELSE m END, CASE WHEN phase = 1 THEN {_SD.format('na')} ELSE ns END,
  CASE WHEN phase = 0 THEN CASE WHEN nb <> b AND abs(ns - s) > 5e-4 * s THEN 0 ELSE 1 END ELSE CASE WHEN len(na) < len(a) AND len(na) > 1 THEN 0 ELSE 2 END END,
  CASE WHEN phase = 1 THEN {value} ELSE r END, CASE WHEN phase = 1 THEN lo + len(list_filter(a, lambda v: v < m - {low} * s)) ELSE lo END, CASE WHEN phase = 1 THEN hi + len(list_filter(a, lambda v: v > m + {high} * s)) ELSE hi END
FROM (SELECT *, 1.134 * {_SD.format('nb')} AS ns FROM (SELECT *, {clip} AS nb, {kept} AS na, {kept_w} AS nw FROM it WHERE phase < 2)))
SELECT session, y, x, round(r, 6) AS v, lo AS n_low, hi AS n_high FROM it WHERE phase = 2"""


@query(PX.replace("WITH ", "WITH RECURSIVE ", 1) + _winsor_sql(2.75, 2.75))
def stack_winsor(spark, sf_dir):
    return _stacked(spark, sf_dir, stack.StackMode.WINSOR_SIGMA)


@query(PX.replace("WITH ", "WITH RECURSIVE ", 1) + ", wt AS (SELECT frame_id, exposure AS w FROM fm)" + _winsor_sql(2.75, 2.75, True))
def stack_winsor_weighted(spark, sf_dir):
    return _weighted(spark, sf_dir, stack.Weighting.EXPOSURE, stack.StackMode.WINSOR_SIGMA)


def _line_sql(low: float, high: float) -> str:
    """One row a pass: the sorted set, its line against ranks from 0, the mean absolute residual, and what the pass drops."""
    n = "len(a)"
    slope = f"list_sum(list_transform(a, lambda v, i: (i - 1 - mx) * (v - my))) / ({n} + 1) / nullif(list_sum(list_transform(a, lambda v, i: (i - 1 - mx) ** 2)) / {n}, 0)"
    return f""", it AS (SELECT session, y, x, 0 AS i, a, CAST(NULL AS DOUBLE) AS r, CAST(0 AS BIGINT) AS lo, CAST(0 AS BIGINT) AS hi, FALSE AS done FROM ls0
UNION ALL SELECT session, y, x, i + 1, na, my, lo + nlo, hi + nhi, nlo + nhi = 0 OR len(na) < 3 FROM (
  SELECT *, list_filter(a, lambda v, i: f[i] - v <= {low} * s AND v - f[i] <= {high} * s) AS na, len(list_filter(a, lambda v, i: f[i] - v > {low} * s)) AS nlo, len(list_filter(a, lambda v, i: v - f[i] > {high} * s)) AS nhi FROM (
    SELECT *, list_sum(list_transform(a, lambda v, i: abs(v - f[i]))) / {n} AS s FROM (
      SELECT *, list_transform(a, lambda v, i: my + sl * (i - 1 - mx)) AS f FROM (
        SELECT *, coalesce({slope}, 0) AS sl FROM (SELECT *, ({n} - 1) / 2.0 AS mx, {_MEAN.format('a')} AS my FROM it WHERE NOT done))))))
SELECT session, y, x, round(r, 6) AS v, lo AS n_low, hi AS n_high FROM it WHERE done"""


@query(_LISTS + _line_sql(2.75, 2.75))
def stack_linear_fit(spark, sf_dir):
    return _stacked(spark, sf_dir, stack.StackMode.LINEAR_FIT)


@query(PX + """, b AS (SELECT session, y, x, frame_id % 4 AS batch, avg(v) AS v, count(v) AS n FROM pm GROUP BY 1, 2, 3, 4)
SELECT session, y, x, round(sum(v * n) / sum(CASE WHEN v IS NOT NULL THEN n END), 6) AS v, CAST(0 AS BIGINT) AS n_low, CAST(0 AS BIGINT) AS n_high FROM b GROUP BY 1, 2, 3""")
def stack_batches_two_level(spark, sf_dir):
    out = stack.stack_batches(V.px_missing(spark, sf_dir), 4, SESSION, stack.StackMode.MEAN, batch=F.col("frame_id") % 4)
    return _longs(_round(out, "v"), "n_low", "n_high")


@query()
def stack_clip_report(spark, sf_dir):
    done = stack.stack(V.px_missing(spark, sf_dir), stack.StackMode.MAD_SIGMA, SESSION, 2.0, 2.0)
    return _longs(done.groupBy("session").agg(F.sum("n_low").alias("clipped_low"), F.sum("n_high").alias("clipped_high")), "clipped_low", "clipped_high")


SQL["stack_clip_report"] = PX + _MAD.format("2.0").split("SELECT session, y, x, round(avg")[0] + """SELECT session, count(CASE WHEN v < m - 2.0 * s THEN 1 END) AS clipped_low, count(CASE WHEN v > m + 2.0 * s THEN 1 END) AS clipped_high
FROM pm JOIN b USING (session, y, x) GROUP BY 1"""


# ---- statistics


@query(PX + "SELECT frame_id, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std_dev FROM pm GROUP BY 1")
def stats_basic(spark, sf_dir):
    return _round(stats.basic(V.px_missing(spark, sf_dir), FRAME), "min", "max", "mean", "std_dev")


@query(PX + "SELECT frame_id, round(location, 6) AS location, round(scale, 6) AS scale FROM ls")
def stats_median_mad(spark, sf_dir):
    return _round(stats.median_mad(V.px(spark, sf_dir), FRAME), "location", "scale")


@query(PX + ", r AS (SELECT frame_id, v, row_number() OVER (PARTITION BY frame_id ORDER BY v) AS k FROM pm WHERE v IS NOT NULL) SELECT frame_id, v FROM r WHERE k = 10")
def stats_kth(spark, sf_dir):
    return stats.kth_smallest(V.px_missing(spark, sf_dir), FRAME, 10)


@query(PX + ", r AS (SELECT frame_id, v, row_number() OVER (PARTITION BY frame_id ORDER BY v) AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM pm WHERE v IS NOT NULL) SELECT frame_id, v FROM r WHERE k = n // 4 + 1")
def stats_first_quartile(spark, sf_dir):
    return stats.kth_smallest(V.px_missing(spark, sf_dir), FRAME)


_HIST = """, h AS (SELECT session, lo, hi, CAST(CASE WHEN hi > lo THEN floor((v - lo) * 63 / (hi - lo) + 0.5) ELSE 0 END AS INTEGER) AS bin, count(*) AS n
  FROM px JOIN (SELECT session, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1) USING (session) GROUP BY 1, 2, 3, 4),
pk AS (SELECT session, bin AS peak FROM (SELECT session, bin, row_number() OVER (PARTITION BY session ORDER BY n DESC, bin) AS r FROM h WHERE bin > 0 AND bin < 63) WHERE r = 1),
ma AS (SELECT session, lo, hi, peak, abs(bin - peak) AS d, sum(n) AS n FROM h JOIN pk USING (session) GROUP BY 1, 2, 3, 4, 5),
cu AS (SELECT *, sum(n) OVER (PARTITION BY session ORDER BY d) AS c, sum(n) OVER (PARTITION BY session) AS t FROM ma)
SELECT session, round(lo + peak * (hi - lo) / 63, 6) AS location, round((min(d) + 0.5) * (hi - lo) / 63, 6) AS scale FROM cu WHERE c >= 0.6827 * t GROUP BY session, lo, hi, peak"""


@query(PX + _HIST)
def stats_hist_locscale(spark, sf_dir):
    return _round(stats.histogram_location_scale(V.px(spark, sf_dir), ["session"], 64), "location", "scale")


@query(PX + "SELECT frame_id, round(noise, 6) AS noise FROM ns")
def stats_noise(spark, sf_dir):
    return _round(stats.noise(V.px(spark, sf_dir), FRAME), "noise")


@query(PX + """, r AS (SELECT frame_id, v, row_number() OVER (PARTITION BY frame_id ORDER BY v) - 1 AS k FROM pm WHERE v IS NOT NULL),
g AS (SELECT frame_id, regr_slope(v, k) * count(*) / (count(*) + 1) AS slope, avg(v) AS mv, avg(k) AS mk, count(*) AS n FROM r GROUP BY 1)
SELECT frame_id, round(slope, 6) AS slope, round(mv - slope * mk, 6) AS intercept, n FROM g""")
def linreg_rank(spark, sf_dir):
    return _round(stats.rank_regression(V.px_missing(spark, sf_dir), FRAME), "slope", "intercept")


_VALUES = PX.replace("WITH ", "WITH RECURSIVE ", 1) + ", va AS (SELECT frame_id, list(v ORDER BY v) AS a FROM px GROUP BY 1)"


_IKSS_SQL = """, it AS (SELECT frame_id, a, 0 AS i, CAST(1 AS DOUBLE) AS last, CAST(NULL AS DOUBLE) AS l, CAST(NULL AS DOUBLE) AS s, FALSE AS done FROM va
UNION ALL SELECT frame_id, CASE WHEN m IS NULL THEN a ELSE list_filter(a, lambda v: v >= m - 4 * bw AND v <= m + 4 * bw) END, i + 1, bw, m, CASE WHEN d = 0 OR bw = 0 THEN 0 ELSE 0.991 * bw END, d = 0 OR bw = 0 OR last - bw < bw * 1e-3 FROM (
  SELECT *, CASE WHEN d = 0 THEN 0 ELSE sqrt(len(a) * list_sum(list_transform(k, lambda e: e.d2 * (1 - e.u2) ** 4))) / abs(list_sum(list_transform(k, lambda e: (1 - e.u2) * (1 - 5 * e.u2)))) END AS bw FROM (
    SELECT *, list_filter(list_transform(a, lambda v: {'d2': (v - m) ** 2, 'u2': ((v - m) / (9 * nullif(d, 0))) ** 2}), lambda e: e.u2 < 1) AS k FROM (
      SELECT *, list_median(list_transform(a, lambda v: abs(v - m))) AS d FROM (SELECT *, list_median(a) AS m FROM it WHERE NOT done)))))
SELECT frame_id, round(l, 6) AS location, round(s, 6) AS scale FROM it WHERE done"""


@query(_VALUES + _IKSS_SQL)
def stats_ikss(spark, sf_dir):
    return _round(stats.location_scale(V.px(spark, sf_dir), FRAME, stats.Estimator.IKSS), "location", "scale")


def _qn_sql(a: str) -> str:
    """2.21914 times the (floor(pairs / 4) + 1)-th smallest distance of two values."""
    pairs = f"list_sort(flatten(list_transform({a}, lambda p, j: list_transform({a}[j + 1 :], lambda q: abs(q - p)))))"
    return f"CASE WHEN len({a}) < 2 THEN 0 ELSE 2.21914 * {pairs}[(len({a}) * (len({a}) - 1) // 2) // 4 + 1] END"


_CLIPPED_SQL = f""", it AS (SELECT frame_id, a, 0 AS i, list_median(a) AS l, {_qn_sql('a')} AS s, {_qn_sql('a')} AS whole, (list_max(a) - list_min(a)) / 65535 AS eps, FALSE AS done FROM va
UNION ALL SELECT frame_id, a, i + 1, CASE WHEN stop THEN l ELSE nl END, CASE WHEN stop THEN s ELSE ns END, whole, eps, stop OR i >= 9 FROM (
  SELECT *, len(ins) = 0 OR abs(nl - l) + abs(ns - s) <= eps AS stop FROM (
    SELECT *, list_median(ins) AS nl, 1.134 * ({_qn_sql('ins')}) AS ns FROM (SELECT *, list_filter(a, lambda v: abs(v - l) <= 2 * s) AS ins FROM it WHERE NOT done))))
SELECT frame_id, round(l, 6) AS location, round(whole, 6) AS scale FROM it WHERE done"""


@query(_VALUES + _CLIPPED_SQL)
def stats_clipped_median_qn(spark, sf_dir):
    return _round(stats.location_scale(V.px(spark, sf_dir), FRAME, stats.Estimator.CLIPPED_MEDIAN_QN), "location", "scale")


@query(_VALUES + """, it AS (SELECT frame_id, a FROM va
UNION ALL SELECT frame_id, a[i : i + k - 1] FROM (SELECT *, list_position(r, list_min(r)) AS i FROM (SELECT *, list_transform(a[k :], lambda v, j: v - a[j]) AS r FROM (SELECT *, (len(a) + 1) // 2 AS k FROM it WHERE len(a) > 2))))
SELECT frame_id, round(list_aggregate(a, 'avg'), 6) AS mode FROM it WHERE len(a) <= 2""")
def stats_half_sample_mode(spark, sf_dir):
    return _round(stats.half_sample_mode(V.px(spark, sf_dir), FRAME), "mode")


# ---- pixel maths

_OUT = "SELECT frame_id, y, x, round({0}, 6) AS v FROM "


def _px_out(df: DataFrame) -> DataFrame:
    return _round(df.select("frame_id", "y", "x", "v"), "v")


def _session_frame(spark, sf_dir, rank: int) -> DataFrame:
    """The rank-th lowest frame of each session."""
    p = V.px(spark, sf_dir)
    ids = p.groupBy("session").agg(F.sort_array(F.collect_set("frame_id"))[rank].alias("frame_id"))
    return p.join(ids, ["session", "frame_id"]).drop("frame_id")


@query(PX + """, i AS (SELECT session, list_sort(list(DISTINCT frame_id)) AS ids FROM px GROUP BY 1),
dk AS (SELECT px.session, y, x, v FROM px JOIN i ON px.session = i.session AND frame_id = ids[1]),
f0 AS (SELECT px.session, y, x, v FROM px JOIN i ON px.session = i.session AND frame_id = ids[2]),
fl AS (SELECT session, y, x, v - min(v) OVER (PARTITION BY session) + 1 AS f FROM f0),
fx AS (SELECT session, max(f) AS m FROM fl GROUP BY 1)
SELECT px.frame_id, y, x, round(CASE WHEN f > 0 THEN (px.v - coalesce(dk.v, 0)) * m / f ELSE px.v - coalesce(dk.v, 0) END, 6) AS v
FROM px LEFT JOIN dk USING (session, y, x) LEFT JOIN fl USING (session, y, x) LEFT JOIN fx USING (session)""")
def calibrate(spark, sf_dir):
    flat = _session_frame(spark, sf_dir, 1)
    low = flat.groupBy("session").agg(F.min("v").alias("lo"))
    flat = flat.join(low, "session").withColumn("v", F.col("v") - F.col("lo") + 1).drop("lo")
    return _px_out(pixelmath.calibrate(V.px(spark, sf_dir), _session_frame(spark, sf_dir, 0), flat, ("session", "ch", "y", "x")))


@query(PX + _OUT.format("v * 1.5 + 0.25") + "pm")
def scale_offset(spark, sf_dir):
    return _px_out(pixelmath.scale_offset(V.px_missing(spark, sf_dir), 1.5, 0.25))


@query(PX + _OUT.format("v") + "p1")
def norm_range(spark, sf_dir):
    return _px_out(V.px01(spark, sf_dir))


@query(PX + _OUT.format("CASE WHEN v > 0 THEN v ** (1 / 2.2) ELSE 0 END") + "p1")
def gamma(spark, sf_dir):
    return _px_out(pixelmath.gamma(V.px01(spark, sf_dir), 2.2))


def _ls1(spark, sf_dir):
    return stats.median_mad(V.px01(spark, sf_dir), FRAME)


@query(PX + ", q AS (SELECT p1.*, location + 1.0 * scale AS s FROM p1 JOIN ls1 USING (frame_id)) " + _OUT.format("CASE WHEN v > s AND v < 1 THEN s + ((v - s) / (1 - s)) ** (1 / 1.8) * (1 - s) ELSE v END") + "q")
def gamma_pp(spark, sf_dir):
    return _px_out(pixelmath.gamma_pp(V.px01(spark, sf_dir), 1.8, 1.0, _ls1(spark, sf_dir)))


@query(PX + ", q AS (SELECT p1.*, greatest((v - (location - 2 * scale)) / (1 - (location - 2 * scale)), 0) AS u FROM p1 JOIN ls1 USING (frame_id)) " + _OUT.format("CASE WHEN u > 1 THEN 1 WHEN u <= 0 THEN 0 ELSE (0.25 - 1) * u / ((2 * 0.25 - 1) * u - 0.25) END") + "q")
def midtones(spark, sf_dir):
    return _px_out(pixelmath.midtones(V.px01(spark, sf_dir), 0.25, 2.0, _ls1(spark, sf_dir)))


@query(PX + ", q AS (SELECT p1.*, location AS l, (0.2 - location) / (0.2 - 1) AS b FROM p1 JOIN ls1 USING (frame_id)) " + _OUT.format("CASE WHEN l > 0.2 THEN greatest((v - b) / (1 - b), 0) ELSE v END") + "q")
def scale_black(spark, sf_dir):
    return _px_out(pixelmath.scale_black(V.px01(spark, sf_dir), 0.2, _ls1(spark, sf_dir)))


def _stretch_sql(source: str, key: str, location: float, scale: float) -> str:
    """st: key, a (all values of a frame).  One row a round: values, their median and scaled MAD, the next step."""
    black = f"CASE WHEN {{0}} > {location} THEN ({location} - ({{0}})) / ({location} - 1) ELSE 0 END"
    after = f"abs(s * (1 / (1 + i / 100.0)) * m ** (1 / (1 + i / 100.0) - 1) / (1 - ({black.format('m ** (1 / (1 + i / 100.0))')})) - {scale})"
    low, high = f"m <= 1.01 * {location} AND s < {scale}", f"m > 0.99 * {location} AND s < {scale} AND abs(m - {location}) > 0.001 * {location}"
    measured = "SELECT {0}, a, i, m, 1.4826 * list_median(list_transform(a, lambda v: abs(v - m))) AS s FROM (SELECT {0}, a, i, list_median(a) AS m FROM {1})"
    chosen = f"SELECT *, CASE WHEN i >= 50 OR m <= 0 OR m >= 1 THEN 0 WHEN {low} THEN 1 + (list_position(gs, list_min(gs)) - 1) / 100.0 WHEN {high} THEN 1 ELSE 0 END AS g0, m <= 1.01 * {location} AS faint FROM (SELECT *, list_transform(range(0, 401), lambda i: {after}) AS gs FROM ({{0}}))"
    step = f"SELECT *, CASE WHEN faint AND g0 <= 1.01 THEN 0 ELSE g0 END AS g FROM ({chosen})"
    stepped = f"SELECT *, {black.format('m ** (1 / g)')} AS b FROM ({step}) WHERE g > 0"
    moved = f"SELECT {key}, list_transform(a, lambda v: CASE WHEN v > 0 THEN greatest((v ** (1 / g) - b) / (1 - b), 0) ELSE greatest(-b / (1 - b), 0) END) AS a, i + 1 AS i FROM ({stepped})"
    return f""", rs AS (SELECT {key}, a, 0 AS i FROM {source} UNION ALL ({moved.format(measured.format(key, 'rs'))})),
st AS (SELECT {key}, arg_max(a, i) AS a FROM rs GROUP BY 1) """


@query(PX.replace("WITH ", "WITH RECURSIVE ", 1) + _stretch_sql("(SELECT frame_id, list(v ORDER BY y, x) AS a FROM p1 GROUP BY 1)", "frame_id", 0.3, 0.2) + _OUT.format("a[y * 8 + x + 1]") + "p1 JOIN st USING (frame_id)")
def stretch(spark, sf_dir):
    return _px_out(pixelmath.stretch(V.px01(spark, sf_dir), 0.3, 0.2))


def _matched(spark, sf_dir, mode):
    pixels = V.px01(spark, sf_dir)
    ls = stats.median_mad(pixels, ["frame_id", "session"])
    ref = reference.by_median_location(ls, ("session",)).select("session", "frame_id").join(ls, ["session", "frame_id"]).select("session", F.col("location").alias("ref_location"), F.col("scale").alias("ref_scale"))
    return _px_out(pixelmath.match_histogram(pixels, mode, ls, ref, on=["session"]))


_REF = """, lz AS (SELECT ls1.*, session FROM ls1 JOIN (SELECT DISTINCT frame_id, session FROM px) USING (frame_id)),
mi AS (SELECT session, median(location) AS m FROM lz GROUP BY 1),
rf AS (SELECT session, location AS rl, scale AS rs FROM (SELECT lz.*, row_number() OVER (PARTITION BY session ORDER BY abs(location - m), frame_id) AS r FROM lz JOIN mi USING (session)) WHERE r = 1),
q AS (SELECT p1.frame_id, y, x, v, location AS l, scale AS s, rl, rs, (rl - location) / (rl - 1) AS b FROM p1 JOIN lz USING (frame_id) JOIN rf ON rf.session = lz.session) """


@query(PX + _REF + _OUT.format("CASE WHEN l <> 0 THEN v * rl / l ELSE v END") + "q")
def match_location(spark, sf_dir):
    return _matched(spark, sf_dir, 1)


@query(PX + _REF + _OUT.format("(v - l) * CASE WHEN s <> 0 THEN rs / s ELSE 1 END + rl") + "q")
def match_locscale(spark, sf_dir):
    return _matched(spark, sf_dir, 2)


@query(PX + _REF + _OUT.format("greatest((v - b) / (1 - b), 0)") + "q")
def match_black(spark, sf_dir):
    return _matched(spark, sf_dir, 3)


@query(PX + "SELECT px.frame_id, count(*) AS pixels FROM px JOIN fm USING (frame_id) WHERE n_stars >= 6 GROUP BY 1")
def filter_min_stars(spark, sf_dir):
    pixels = V.px(spark, sf_dir)
    return pixelmath.filter_frames(V.frame_meta(pixels), pixels, 6)[1].groupBy("frame_id").agg(F.count("*").alias("pixels"))


@query(PX + "SELECT session, frame_id, round(score, 6) AS score FROM (SELECT session, frame_id, CASE WHEN n_stars > 0 AND hfr > 0 THEN n_stars / hfr ELSE 0 END AS score, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN n_stars > 0 AND hfr > 0 THEN n_stars / hfr ELSE 0 END DESC, frame_id) AS r FROM fm) WHERE r = 1")
def select_ref_score(spark, sf_dir):
    return _round(reference.by_stars_hfr(V.frame_meta(V.px(spark, sf_dir)), ("session",)), "score")


@query(PX + ", mi AS (SELECT session, median(location) AS m FROM ls GROUP BY 1) SELECT session, frame_id, round(location, 6) AS location FROM (SELECT ls.*, row_number() OVER (PARTITION BY ls.session ORDER BY abs(location - m), frame_id) AS r FROM ls JOIN mi USING (session)) WHERE r = 1")
def select_ref_median_loc(spark, sf_dir):
    return _round(reference.by_median_location(V.frame_meta(V.px(spark, sf_dir)), ("session",)), "location")


@query(PX + "SELECT fm.frame_id, round(min(v), 6) AS min, round(avg(v), 6) AS mean, round(max(v), 6) AS max, round(any_value(location), 6) AS location, round(any_value(scale), 6) AS scale, any_value(n_stars) AS n_stars, CAST(any_value(hfr) AS DOUBLE) AS hfr FROM fm JOIN px USING (frame_id) GROUP BY 1")
def export_stats(spark, sf_dir):
    p = V.px(spark, sf_dir)
    frames = V.frame_meta(p).join(stats.basic(p, FRAME), "frame_id")
    return _round(reference.export_stats(frames), "min", "mean", "max", "location", "scale", "hfr")


# ---- stencils

_NINE = "(VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) o(dy, dx)"


@query(PX + f", m AS (SELECT a.frame_id, a.y, a.x, median(b.v) AS m FROM px a, {_NINE}, px b WHERE b.frame_id = a.frame_id AND b.y = a.y + dy AND b.x = a.x + dx AND a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY 1, 2, 3), " + """
q AS (SELECT px.frame_id, px.y, px.x, v, coalesce(m, v) AS m FROM px LEFT JOIN m USING (frame_id, y, x)),
s AS (SELECT frame_id, stddev_pop(v - m) AS s FROM q GROUP BY 1)
SELECT frame_id, y, x, round(CASE WHEN v - m < -3 * s OR v - m > 3 * s THEN m ELSE v END, 6) AS v, (v - m < -3 * s OR v - m > 3 * s) AS bad FROM q JOIN s USING (frame_id)""")
def badpixel_median3x3(spark, sf_dir):
    return _round(stencil.bad_pixels(V.px(spark, sf_dir), 3.0, 3.0).select("frame_id", "y", "x", "v", "bad"), "v")


def _bayer_sql(on: str, offsets: str) -> str:
    return PX + f""", m AS (SELECT a.frame_id, a.y, a.x, median(b.v) AS m FROM px a, (VALUES {offsets}) o(dy, dx), px b WHERE b.frame_id = a.frame_id AND b.y = a.y + dy AND b.x = a.x + dx AND {on.format('a')} GROUP BY 1, 2, 3),
s AS (SELECT frame_id, stddev_pop(v - m) AS s FROM px JOIN m USING (frame_id, y, x) GROUP BY 1)
SELECT px.frame_id, px.y, px.x, round(CASE WHEN v - m < -2 * s OR v - m > 2 * s THEN m ELSE v END, 6) AS v, coalesce(v - m < -2 * s OR v - m > 2 * s, FALSE) AS bad
FROM px LEFT JOIN m USING (frame_id, y, x) JOIN s ON s.frame_id = px.frame_id"""


@query(_bayer_sql("{0}.y % 2 = 0 AND {0}.x % 2 = 0", "(-2,-2),(-2,0),(-2,2),(0,-2),(0,0),(0,2),(2,-2),(2,0),(2,2)"))
def badpixel_bayer_r(spark, sf_dir):
    return _round(stencil.bad_pixels_bayer(V.px(spark, sf_dir), "R", "RGGB", 2.0, 2.0).select("frame_id", "y", "x", "v", "bad"), "v")


@query(_bayer_sql("({0}.y + {0}.x) % 2 = 1", "(0,0),(-1,-1),(-1,1),(1,-1),(1,1),(-2,0),(2,0),(0,-2),(0,2)"))
def badpixel_bayer_g(spark, sf_dir):
    return _round(stencil.bad_pixels_bayer(V.px(spark, sf_dir), "G", "RGGB", 2.0, 2.0).select("frame_id", "y", "x", "v", "bad"), "v")


@query(_bayer_sql("{0}.y % 2 = 0 AND {0}.x % 2 = 0", "(-2,-2),(-2,0),(-2,2),(0,-2),(0,0),(0,2),(2,-2),(2,0),(2,2)"))
def badpixel_bayer_b_bggr(spark, sf_dir):
    return _round(stencil.bad_pixels_bayer(V.px(spark, sf_dir), "B", "BGGR", 2.0, 2.0).select("frame_id", "y", "x", "v", "bad"), "v")


@query(_bayer_sql("{0}.y % 2 = 0 AND {0}.x % 2 = 1", "(-2,-2),(-2,0),(-2,2),(0,-2),(0,0),(0,2),(2,-2),(2,0),(2,2)"))
def badpixel_bayer_r_grbg(spark, sf_dir):
    return _round(stencil.bad_pixels_bayer(V.px(spark, sf_dir), "R", "GRBG", 2.0, 2.0).select("frame_id", "y", "x", "v", "bad"), "v")


@query(PX + "SELECT frame_id, CAST(y // 3 AS INTEGER) AS y, CAST(x // 3 AS INTEGER) AS x, round(avg(v), 6) AS v FROM pm WHERE y < 6 AND x < 6 GROUP BY 1, 2, 3")
def bin3x3(spark, sf_dir):
    return _px_out(stencil.bin_pixels(V.px_missing(spark, sf_dir), 3))


@query(PX + "SELECT frame_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(avg(v), 6) AS v FROM px GROUP BY 1, 2, 3")
def bin2x2(spark, sf_dir):
    return _px_out(stencil.bin_pixels(V.px(spark, sf_dir), 2))


def _debayer_sql(channel: str, xo: int = 0, yo: int = 0) -> str:
    """The four formulas of a 2 x 2 cell, its neighbours by lag and lead along rows and columns; e: this sample or, outside the frame, the cell's."""
    near, far = "2 / (2 + sqrt(2))", "sqrt(2) / (2 + sqrt(2))"
    cell = {
        "R": ("v", "(l + coalesce(r, l)) / 2", "(u + coalesce(d, u)) / 2", "(ul + coalesce(ur, ul) + coalesce(dl, ul) + coalesce(dr, ul)) / 4"),
        "G": (f"(r + d + coalesce(l, {near} * r + {far} * d) + coalesce(u, {far} * r + {near} * d)) / 4", "v", "v", f"(u + l + coalesce(r, {near} * u + {far} * l) + coalesce(d, {far} * u + {near} * l)) / 4"),
        "B": ("(dr + coalesce(dl, dr) + coalesce(ur, dr) + coalesce(ul, dr)) / 4", "(d + coalesce(u, d)) / 2", "(r + coalesce(l, r)) / 2", "v"),
    }[channel]
    h, w = (8 - yo) // 2 * 2, (8 - xo) // 2 * 2
    return PX + f""", ro AS (SELECT frame_id, y, x, v, lag(v) OVER o AS l, lead(v) OVER o AS r FROM px WINDOW o AS (PARTITION BY frame_id, y ORDER BY x)),
al AS (SELECT *, lag(v) OVER o AS u, lead(v) OVER o AS d, lag(l) OVER o AS ul, lag(r) OVER o AS ur, lead(l) OVER o AS dl, lead(r) OVER o AS dr FROM ro WINDOW o AS (PARTITION BY frame_id, x ORDER BY y)),
cu AS (SELECT * REPLACE (y - {yo} AS y, x - {xo} AS x) FROM al WHERE y >= {yo} AND x >= {xo} AND y < {yo + h} AND x < {xo + w})
SELECT frame_id, y, x, round(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN {cell[0]} WHEN y % 2 = 0 THEN {cell[1]} WHEN x % 2 = 0 THEN {cell[2]} ELSE {cell[3]} END, 6) AS v FROM cu"""


def _debayered(channel: str, cfa: str):
    return lambda spark, sf_dir: _px_out(stencil.debayer(V.px(spark, sf_dir), channel, cfa))


for _cfa, (_xo, _yo) in stencil.CFA.items():
    for _c in "RGB":
        query(_debayer_sql(_c, _xo, _yo), f"debayer_{_c.lower()}" if _cfa == "RGGB" else f"debayer_{_c.lower()}_{_cfa.lower()}")(_debayered(_c, _cfa))


def _deband_sql(line: str, w: int = 4, percentile: int = 50, sigma: float = 3.0) -> str:
    h = w // 2
    return PX + f""", lo AS (SELECT px.frame_id, px.{line} AS i, v, row_number() OVER (PARTITION BY px.frame_id, px.{line} ORDER BY v) AS r, count(*) OVER (PARTITION BY px.frame_id, px.{line}) AS n
  FROM px JOIN ls USING (frame_id) WHERE v <= location + {sigma} * scale),
lv AS (SELECT frame_id, i, v AS level FROM lo WHERE r = greatest(CAST(floor(n * {percentile} / 100.0) AS BIGINT), 1)),
ar AS (SELECT frame_id, list(level ORDER BY i) AS a FROM lv GROUP BY 1),
wi AS (SELECT lv.frame_id, i, level, a, greatest(0, least(i - {h}, len(a) - {w})) AS s, i - {h} - greatest(0, least(i - {h}, len(a) - {w})) AS g FROM lv JOIN ar USING (frame_id)),
ha AS (SELECT *, list_slice(a, s + 1, s + {w}) AS part, list_median(list_slice(a, s + 1, s + {h})) AS l, list_median(list_slice(a, s + {h} + 1, s + {w})) AS r FROM wi),
sm AS (SELECT frame_id, i, level, list_median(list_concat(
    CASE WHEN g < 0 THEN list_slice(part, 1, {w} - abs(g)) ELSE list_slice(part, abs(g) + 1, {w}) END,
    list_transform(range(1, CAST(abs(g) AS BIGINT) + 1), lambda j: (l + r) / 2 + sign(g) * (r - l) / {h} * ({h} + j)))) AS m FROM ha)
SELECT px.frame_id, px.y, px.x, round(v * CASE WHEN level <> 0 THEN m / level ELSE 1 END, 6) AS v FROM px JOIN sm ON sm.frame_id = px.frame_id AND sm.i = px.{line}"""


def _deband(spark, sf_dir, vertical):
    p = V.px(spark, sf_dir)
    return _px_out(stencil.deband(p, stats.median_mad(p, ["frame_id", "ch"]), 50, 4, 3.0, vertical))


@query(_deband_sql("y"))
def deband_h(spark, sf_dir):
    return _deband(spark, sf_dir, False)


@query(_deband_sql("x"))
def deband_v(spark, sf_dir):
    return _deband(spark, sf_dir, True)


def _blur_sql(name: str = "bl") -> str:
    """Three taps: a normal curve of sigma 1 over [-0.5, 0.5] and [0.5, 1.5] (0.0668 beyond 1.5 is over 1 percent, 0.0062 beyond 2.5 isn't), normalised."""
    side, centre = 0.24173033745712885, 0.38292492254802624
    values = ", ".join(f"({o}, {t / (centre + 2 * side)!r}e0)" for o, t in ((-1, side), (0, centre), (1, side)))
    mirror = "CASE WHEN {0} < 0 THEN -({0}) - 1 WHEN {0} >= 8 THEN 15 - ({0}) ELSE {0} END"
    return f""", k(o, t) AS (VALUES {values}),
b1 AS (SELECT a.frame_id, a.y, a.x, sum(t * b.v) AS v FROM px a, k, px b WHERE b.frame_id = a.frame_id AND b.y = a.y AND b.x = {mirror.format('a.x + o')} GROUP BY 1, 2, 3),
{name} AS (SELECT a.frame_id, a.y, a.x, sum(t * b.v) AS v FROM b1 a, k, b1 b WHERE b.frame_id = a.frame_id AND b.x = a.x AND b.y = {mirror.format('a.y + o')} GROUP BY 1, 2, 3) """


@query(PX + _blur_sql() + _OUT.format("v") + "bl")
def gauss_blur(spark, sf_dir):
    return _px_out(stencil.gaussian_blur(V.px(spark, sf_dir), 1.0))


@query(PX + _blur_sql() + "SELECT px.frame_id, px.y, px.x, round(CASE WHEN px.v < location + 0.5 * scale THEN px.v ELSE least(greatest(px.v + (px.v - bl.v) * 1.5, lo), hi) END, 6) AS v FROM px JOIN bl USING (frame_id, y, x) JOIN ls USING (frame_id) JOIN sp USING (frame_id)")
def unsharp_mask(spark, sf_dir):
    p = V.px(spark, sf_dir)
    by = ["frame_id", "ch"]
    limits = stats.median_mad(p, by).join(stats.basic(p, by), by)
    return _px_out(stencil.unsharp_mask(p, limits, 1.0, 1.5, 0.5))


@query(PX + """, q AS (SELECT frame_id, y, x, 0.98 * x + 0.02 * y + 0.3 AS sx, -0.02 * x + 1.01 * y - 0.2 AS sy FROM px),
g AS (SELECT *, CAST(floor(sx) AS INTEGER) AS ix, CAST(floor(sy) AS INTEGER) AS iy, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM q),
n AS (SELECT frame_id, y, x, v, lead(v) OVER (PARTITION BY frame_id, y ORDER BY x) AS r FROM px),
s AS (SELECT frame_id, y, x, v, r, lead(v) OVER o AS d, lead(r) OVER o AS dr FROM n WINDOW o AS (PARTITION BY frame_id, x ORDER BY y))
SELECT g.frame_id, g.y, g.x, round((1 - fy) * ((1 - fx) * s.v + fx * r) + fy * ((1 - fx) * d + fx * dr), 6) AS v FROM g LEFT JOIN s ON s.frame_id = g.frame_id AND s.y = g.iy AND s.x = g.ix""")
def project_bilinear(spark, sf_dir):
    p = V.px(spark, sf_dir)
    inverse = align.invert((0.98, 0.02, 0.3, -0.02, 1.01, -0.2))
    t = p.select("frame_id").distinct().select("frame_id", F.lit(8).alias("width"), F.lit(8).alias("height"), *[F.lit(v).alias(k) for k, v in zip("abcdef", inverse)])
    return _px_out(stencil.project(p, t))


# ---- background

_CELLS = """, c AS (SELECT frame_id, CAST(y // 4 AS INTEGER) AS cy, CAST(x // 4 AS INTEGER) AS cx, v FROM px),
m AS (SELECT frame_id, cy, cx, median(v) AS m FROM c GROUP BY 1, 2, 3),
d AS (SELECT c.*, m FROM c JOIN m USING (frame_id, cy, cx)),
s AS (SELECT frame_id, cy, cx, median(abs(v - m)) AS s FROM d GROUP BY 1, 2, 3),
ce AS (SELECT frame_id, cy, cx, coalesce(median(CASE WHEN v < m + 1.5 * 1.4826 * s THEN v END), any_value(m)) AS v FROM d JOIN s USING (frame_id, cy, cx) GROUP BY 1, 2, 3) """


@query(PX + _CELLS + "SELECT frame_id, cy, cx, round(v, 6) AS v FROM ce")
def background_cells(spark, sf_dir):
    return _round(background.cells(V.px(spark, sf_dir), 4).select("frame_id", "cy", "cx", "v"), "v")


def _background_sql() -> str:
    a, b = 0.6826894921370859, 0.15730535589982697  # weights of a normal curve of sigma 0.5 over [-0.5, 0.5] and [0.5, 1.5]
    return PX + _CELLS + f""", sm AS (SELECT p.frame_id, p.cy, p.cx, sum(q.v * CASE WHEN p.cy = q.cy THEN {a!r} ELSE {b!r} END * CASE WHEN p.cx = q.cx THEN {a!r} ELSE {b!r} END)
    / sum(CASE WHEN p.cy = q.cy THEN {a!r} ELSE {b!r} END * CASE WHEN p.cx = q.cx THEN {a!r} ELSE {b!r} END) AS v
  FROM ce p JOIN ce q USING (frame_id) GROUP BY 1, 2, 3),
w AS (SELECT frame_id, max(CASE WHEN cy = 0 AND cx = 0 THEN v END) AS v00, max(CASE WHEN cy = 0 AND cx = 1 THEN v END) AS v01, max(CASE WHEN cy = 1 AND cx = 0 THEN v END) AS v10, max(CASE WHEN cy = 1 AND cx = 1 THEN v END) AS v11 FROM sm GROUP BY 1),
f AS (SELECT px.frame_id, y, x, v, (y + 0.5) / 4.0 - 0.5 AS fy, (x + 0.5) / 4.0 - 0.5 AS fx, v00, v01, v10, v11 FROM px JOIN w USING (frame_id))
SELECT frame_id, y, x, round(v - ((v00 + (v01 - v00) * fx) + ((v10 + (v11 - v10) * fx) - (v00 + (v01 - v00) * fx)) * fy), 6) AS v FROM f"""


@query(_background_sql())
def background_subtract(spark, sf_dir):
    p = V.px(spark, sf_dir)
    return _px_out(background.subtract(p, background.finished(background.cells(p, 4))))


# ---- stars and alignment


@query(PX + """, b AS (SELECT px.frame_id, y, x, v FROM px JOIN ls USING (frame_id) WHERE v > location + 0.5 * scale),
n AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY frame_id, y ORDER BY x) <= 1 THEN 0 ELSE 1 END AS n FROM b),
r AS (SELECT *, sum(n) OVER (PARTITION BY frame_id, y ORDER BY x) AS run FROM n)
SELECT frame_id, y, x, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, y, run ORDER BY v DESC, x) AS k FROM r) WHERE k = 1""")
def bright_pixels_runs(spark, sf_dir):
    p = V.px(spark, sf_dir)
    return _px_out(stars.bright_runs(p, stats.median_mad(p, ["frame_id", "ch"]), 0.5, 1))


@query(PX + """, c AS (SELECT frame_id, y AS sy, x AS sx FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY v DESC, y, x) AS r FROM px) WHERE r = 1),
q AS (SELECT px.frame_id, greatest(v - location, 0) AS v, sqrt((y - sy) ** 2 + (x - sx) ** 2) AS d FROM px JOIN c USING (frame_id) JOIN ls USING (frame_id) WHERE (y - sy) ** 2 + (x - sx) ** 2 <= 9)
SELECT frame_id, round(sum(d * v) / nullif(sum(v), 0), 6) AS hfr, round(sum(v), 6) AS mass FROM q GROUP BY 1""")
def star_hfr(spark, sf_dir):
    p = V.px(spark, sf_dir)
    top = p.groupBy("frame_id").agg(F.max(F.struct("v", (-F.col("y")).alias("my"), (-F.col("x")).alias("mx"))).alias("b"))
    centres = top.select("frame_id", F.lit(1).alias("star"), (-F.col("b.my")).alias("y"), (-F.col("b.mx")).alias("x"))
    return _round(stars.half_flux_radius(p, centres, stats.median_mad(p, FRAME), 3).drop("star"), "hfr", "mass")


_TOP = """WITH st AS (SELECT l_suppkey AS frame_id, CAST(l_partkey AS DOUBLE) AS x, CAST(l_orderkey AS DOUBLE) AS y, l_extendedprice AS mass, l_quantity / 10 AS hfr,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_partkey, l_orderkey, l_quantity, l_linenumber, l_discount, l_tax) AS INTEGER) AS "rank" FROM lineitem),
tk AS (SELECT * FROM st WHERE "rank" <= {0})
"""


@query(_TOP.format(10) + 'SELECT frame_id, "rank", x, y, mass, round(hfr, 6) AS hfr FROM tk')
def brightest_topk(spark, sf_dir):
    return _round(V.bright_stars(spark, sf_dir, 10).select("frame_id", "rank", "x", "y", "mass", "hfr"), "hfr")


_TRI = """, pr AS (SELECT p.frame_id, p."rank" AS a, q."rank" AS b, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS ab FROM tk p JOIN tk q ON p.frame_id = q.frame_id AND p."rank" <> q."rank"),
tr AS (SELECT * FROM (SELECT pr.frame_id, a, b, r."rank" AS c, ab, sqrt((ax - r.x) ** 2 + (ay - r.y) ** 2) AS ac, sqrt((bx - r.x) ** 2 + (by_ - r.y) ** 2) AS bc FROM pr JOIN tk r ON r.frame_id = pr.frame_id AND r."rank" <> a AND r."rank" <> b) WHERE ab < ac AND ac < bc)
"""


@query(_TOP.format(6) + _TRI + "SELECT frame_id, a, b, c, round(ab, 6) AS ab, round(ac, 6) AS ac, round(bc, 6) AS bc FROM tr")
def triangles(spark, sf_dir):
    return _round(align.triangles(V.bright_stars(spark, sf_dir, 6)), "ab", "ac", "bc")


@query(_TOP.format(6) + _TRI + """, rf AS (SELECT * FROM tr WHERE frame_id = (SELECT min(frame_id) FROM tr)),
m AS (SELECT t.frame_id, t.a, t.b, t.c, r.a AS ra, r.b AS rb, r.c AS rc, (t.ab - r.ab) ** 2 + (t.ac - r.ac) ** 2 + (t.bc - r.bc) ** 2 AS d2 FROM tr t, rf r)
SELECT frame_id, a, b, c, ra, rb, rc, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, a, b, c ORDER BY d2, ra, rb, rc) AS r FROM m) WHERE r = 1""")
def nn_triangle_match(spark, sf_dir):
    t = align.triangles(V.bright_stars(spark, sf_dir, 6))
    first = t.agg(F.min("frame_id").alias("frame_id"))
    return _round(align.nearest_triangle(t, t.join(F.broadcast(first), "frame_id", "left_semi")), "d2")  # first is one row


_STARS = _TOP.split(",\ntk AS")[0]


@query(_STARS + """, rf AS (SELECT * FROM st WHERE frame_id = (SELECT min(frame_id) FROM st)),
m AS (SELECT t.frame_id, t."rank" AS star, r."rank" AS ref, (t.x - r.x) ** 2 + (t.y - r.y) ** 2 AS d2 FROM st t JOIN rf r ON (t.x - r.x) ** 2 + (t.y - r.y) ** 2 < 250000)
SELECT frame_id, star, ref, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, star ORDER BY d2, ref) AS r FROM m) WHERE r = 1""")
def nn_star_match(spark, sf_dir):
    s = V.bright_stars(spark, sf_dir)
    first = V.star_cat(spark, sf_dir).agg(F.min("frame_id").alias("frame_id"))
    ref = s.join(F.broadcast(first), "frame_id", "left_semi").select(F.col("rank").alias("ref"), "x", "y")  # first is one row
    return _round(align.nearest_star(s.select("frame_id", F.col("rank").alias("star"), "x", "y"), ref, 500.0, ("frame_id",)), "d2")


@query("""WITH m AS (SELECT l_suppkey AS frame_id, l_quantity AS x, l_tax * 100 AS y, 2 * l_quantity + l_discount * 10 + 3 AS u, l_quantity * 0.5 - l_tax * 70 + l_linenumber AS v FROM lineitem),
g AS (SELECT frame_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, covar_pop(x, x) AS sxx, covar_pop(y, y) AS syy, covar_pop(x, y) AS sxy, covar_pop(x, u) AS sxu, covar_pop(y, u) AS syu, covar_pop(x, v) AS sxv, covar_pop(y, v) AS syv FROM m GROUP BY 1),
h AS (SELECT *, sxx * syy - sxy * sxy AS det FROM g),
a AS (SELECT *, (sxu * syy - syu * sxy) / det AS a, (syu * sxx - sxu * sxy) / det AS b, (sxv * syy - syv * sxy) / det AS d, (syv * sxx - sxv * sxy) / det AS e FROM h)
SELECT frame_id, round(a, 6) AS a, round(b, 6) AS b, round(mu - a * mx - b * my, 6) AS c, round(d, 6) AS d, round(e, 6) AS e, round(mv - d * mx - e * my, 6) AS f, n FROM a""")
def affine_ols(spark, sf_dir):
    m = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("frame_id"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"), (2 * F.col("l_quantity") + F.col("l_discount") * 10 + 3).alias("u"), (F.col("l_quantity") * 0.5 - F.col("l_tax") * 70 + F.col("l_linenumber")).alias("v"))
    return _round(align.affine_least_squares(m).drop("rms"), *"abcdef")


@query("""WITH RECURSIVE st AS (SELECT l_suppkey AS frame_id, CAST(l_partkey AS DOUBLE) AS x, CAST(l_orderkey AS DOUBLE) AS y, l_extendedprice AS mass,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey) AS r FROM lineitem),
it AS (SELECT frame_id, x, y, mass, r, [{'x': x, 'y': y}] AS near, TRUE AS kept FROM st WHERE r = 1
UNION ALL SELECT frame_id, x, y, mass, r, CASE WHEN free THEN list_append(near, {'x': x, 'y': y}) ELSE near END, free FROM (
  SELECT st.*, near, len(list_filter(near, lambda k: floor((st.x - k.x) ** 2 + (st.y - k.y) ** 2 + 0.5) <= 160000)) = 0 AS free FROM it JOIN st ON st.frame_id = it.frame_id AND st.r = it.r + 1))
SELECT frame_id, x, y, mass FROM it WHERE kept""")
def overlap_filter(spark, sf_dir):
    return stars.overlap_filter(V.star_cat(spark, sf_dir).select("frame_id", "x", "y", "mass"), 400.0)


@query()
def star_detect(spark, sf_dir):
    p = V.px(spark, sf_dir)
    found = stars.detect(p, stats.median_mad(p, FRAME), 2, 1.5, 0.0)
    return _round(found, "value", "x", "y", "mass", "hfr")


@query(_STARS + """, q AS (SELECT frame_id, "rank", least(greatest(x + hfr * 4 * dx, 0), 8191) AS px, least(greatest(y + hfr * 4 * dy, 0), 65535) AS py FROM st,
  (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) o(dy, dx))
SELECT frame_id, CAST(floor(py / (65536.0 / 64)) AS INTEGER) AS cy, CAST(floor(px / (8192.0 / 8)) AS INTEGER) AS cx, count(DISTINCT "rank") AS n_stars FROM q GROUP BY 1, 2, 3""")
def star_binning_cells(spark, sf_dir):
    s = V.star_cat(spark, sf_dir)
    sizes = s.select("frame_id").distinct().select("frame_id", F.lit(8192).alias("width"), F.lit(65536).alias("height"))
    return stars.cell_binning(s, sizes, 1024)


# ---- colour

RGB = PX + """, dealt AS (SELECT session, frame_id, row_number() OVER (PARTITION BY session ORDER BY frame_id) - 1 AS r, count(*) OVER (PARTITION BY session) AS n FROM (SELECT DISTINCT session, frame_id FROM px)),
cp AS (SELECT CAST(px.session AS BIGINT) * 1000000 + r // 3 AS image, CAST(r % 3 AS INTEGER) AS ch, y, x, v FROM px JOIN dealt USING (session, frame_id) WHERE r < n - n % 3),
cs AS (SELECT image, min(v) AS lo, max(v) AS hi FROM cp GROUP BY 1),
rgb AS (SELECT image, y, x, max(CASE WHEN ch = 0 THEN (v - lo) / (hi - lo) END) AS c0, max(CASE WHEN ch = 1 THEN (v - lo) / (hi - lo) END) AS c1, max(CASE WHEN ch = 2 THEN (v - lo) / (hi - lo) END) AS c2 FROM cp JOIN cs USING (image) GROUP BY 1, 2, 3)
"""
_COLOUR = "SELECT image, y, x, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2 FROM "
BY = ("image",)


def _rgb(spark, sf_dir):
    return color.rgb_combine(V.rgb_px(V.px(spark, sf_dir)), BY)


def _colour_out(df):
    return _round(df.select("image", "y", "x", "c0", "c1", "c2"), "c0", "c1", "c2")


@query(RGB + _COLOUR + "rgb")
def rgb_combine(spark, sf_dir):
    return _colour_out(_rgb(spark, sf_dir))


_DARK = """, bm AS (SELECT image, y // 2 AS by_, x // 2 AS bx, avg(c0) AS m0, avg(c1) AS m1, avg(c2) AS m2 FROM rgb WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 GROUP BY 1, 2, 3),
dk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY (m0 + m1 + m2) / 3, by_, bx) AS r FROM bm) WHERE r = 1) """


@query(RGB + _DARK + "SELECT image, CAST(by_ AS BIGINT) AS \"by\", CAST(bx AS BIGINT) AS bx, round(m0, 6) AS m0, round(m1, 6) AS m1, round(m2, 6) AS m2 FROM dk")
def rgb_darkest_block(spark, sf_dir):
    return _longs(_round(color.darkest_block(_rgb(spark, sf_dir), 2, 0.2, BY), "m0", "m1", "m2"), "by", "bx")


@query(RGB + _DARK + """, hi AS (SELECT image, max(c0) AS s0, max(c1) AS s1, max(c2) AS s2 FROM rgb GROUP BY 1),
j AS (SELECT rgb.image, y, x, c0, c1, c2, m0, m1, m2, s0, s1, s2, (m0 + m1 + m2) / 3 AS lm, (s0 + s1 + s2) / 3 AS hm FROM rgb JOIN dk USING (image) JOIN hi USING (image)),
o AS (SELECT image, y, x, (hm - lm) / (s0 - m0) * c0 + lm - (hm - lm) / (s0 - m0) * m0 AS c0, (hm - lm) / (s1 - m1) * c1 + lm - (hm - lm) / (s1 - m1) * m1 AS c1, (hm - lm) / (s2 - m2) * c2 + lm - (hm - lm) / (s2 - m2) * m2 AS c2 FROM j)
SELECT image, y, x, round(least(greatest(c0, 0), 1), 6) AS c0, round(least(greatest(c1, 0), 1), 6) AS c1, round(least(greatest(c2, 0), 1), 6) AS c2 FROM o""")
def rgb_balance_affine(spark, sf_dir):
    rgb = _rgb(spark, sf_dir)
    top = rgb.groupBy("image").agg(*[F.max(c).alias(f"s{i}") for i, c in enumerate(color.CHANNELS)])
    return _colour_out(color.balance(rgb, color.darkest_block(rgb, 2, 0.2, BY), top, by=BY))


def _hsl(spark, sf_dir):
    """The colour frame read as hue (scaled to degrees), saturation and lightness."""
    return _rgb(spark, sf_dir).withColumn("c0", F.col("c0") * 360)


_HSL = """, hs AS (SELECT image, y, x, c0 * 360 AS c0, c1, c2 FROM rgb),
hm AS (SELECT image, median(c2) AS m FROM hs GROUP BY 1),
hl AS (SELECT hs.image, any_value(m) AS m, 1.4826 * median(abs(c2 - m)) AS s FROM hs JOIN hm USING (image) GROUP BY 1),
hj AS (SELECT hs.*, m, s FROM hs JOIN hl USING (image)) """


def _hsl_ls(hsl):
    return stats.median_mad(hsl.select("image", F.col("c2").alias("v")), ["image"])


@query(RGB + _HSL + "SELECT image, y, x, round(c0, 6) AS c0, round(CASE WHEN c2 < m + 0.25 * s THEN 0 WHEN c2 >= m + 1.0 * s THEN c1 ELSE c1 * (c2 - (m + 0.25 * s)) / ((m + 1.0 * s) - (m + 0.25 * s)) END, 6) AS c1, round(c2, 6) AS c2 FROM hj")
def hsl_neutralize(spark, sf_dir):
    h = _hsl(spark, sf_dir)
    return _colour_out(color.neutralize_background(h, 0.25, 1.0, _hsl_ls(h), BY))


@query(RGB + _HSL + "SELECT image, y, x, round(c0, 6) AS c0, round(CASE WHEN c2 >= m + 0.75 * s THEN CASE WHEN c1 > 0 THEN c1 ** (1 / 1.75) ELSE 0 END ELSE c1 END, 6) AS c1, round(c2, 6) AS c2 FROM hj")
def hsl_sat_gamma(spark, sf_dir):
    h = _hsl(spark, sf_dir)
    return _colour_out(color.saturation_gamma(h, 1.75, 0.75, _hsl_ls(h), BY))


@query(RGB + _HSL + "SELECT image, y, x, round(c0, 6) AS c0, round(CASE WHEN c0 > 295 OR c0 < 40 THEN least(greatest(c1 * 1.4, 0), 1) ELSE c1 END, 6) AS c1, round(c2, 6) AS c2 FROM hj")
def hsl_selective_sat(spark, sf_dir):
    return _colour_out(color.selective_saturation(_hsl(spark, sf_dir), 295, 40, 1.4))


@query(RGB + _HSL + "SELECT image, y, x, round(CASE WHEN c0 > 100 AND c0 < 190 AND c2 >= m + 0.5 * s THEN c0 - 30 ELSE c0 END, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2 FROM hj")
def hsl_rotate_hue(spark, sf_dir):
    h = _hsl(spark, sf_dir)
    return _colour_out(color.rotate_hue(h, 100, 190, -30, 0.5, _hsl_ls(h), BY))


@query(RGB + _COLOUR.replace("round(c2, 6)", "round(c2 * 0.9 + 0.05, 6)") + "rgb")
def hsl_scale_offset_channel(spark, sf_dir):
    return _colour_out(color.scale_offset_channel(_rgb(spark, sf_dir), 2, 0.9, 0.05))


@query(RGB + ", lu AS (SELECT image, y, x, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS l FROM cp WHERE ch = 1 WINDOW w AS (PARTITION BY image)) SELECT image, y, x, round(c0, 6) AS c0, round(c1, 6) AS c1, round(CASE WHEN l > 0.0088564516790356308 THEN 1.16 * cbrt(l) - 0.16 ELSE l * 9.032962962962963 END, 6) AS c2 FROM rgb JOIN lu USING (image, y, x)")
def hsl_apply_lum(spark, sf_dir):
    luminance = V.rgb_px(V.px(spark, sf_dir)).where("ch = 1").drop("ch")
    return _colour_out(color.apply_luminance(_rgb(spark, sf_dir), luminance, ("image", "y", "x")))


@query(RGB + _COLOUR.replace("round(c2, 6)", "round(CASE WHEN c2 > 0 THEN c2 ** (1 / 1.6) ELSE 0 END, 6)") + "rgb")
def hsl_gamma(spark, sf_dir):
    return _colour_out(color.on_lightness(_rgb(spark, sf_dir), pixelmath.gamma, 1.6))


@query(RGB + _HSL + "SELECT image, y, x, round(c0, 6) AS c0, round(c1, 6) AS c1, round(CASE WHEN u > 1 THEN 1 WHEN u <= 0 THEN 0 ELSE (0.3 - 1) * u / ((2 * 0.3 - 1) * u - 0.3) END, 6) AS c2 FROM (SELECT *, greatest((c2 - (m - 2 * s)) / (1 - (m - 2 * s)), 0) AS u FROM hj)")
def hsl_midtones(spark, sf_dir):
    h = _hsl(spark, sf_dir)
    return _colour_out(color.on_lightness(h, pixelmath.midtones, 0.3, 2.0, _hsl_ls(h), ["image"]))


@query(RGB + _HSL + "SELECT image, y, x, round(c0, 6) AS c0, round(c1, 6) AS c1, round(CASE WHEN c2 > m + s AND c2 < 1 THEN m + s + ((c2 - (m + s)) / (1 - (m + s))) ** (1 / 1.5) * (1 - (m + s)) ELSE c2 END, 6) AS c2 FROM hj")
def hsl_gamma_pp(spark, sf_dir):
    h = _hsl(spark, sf_dir)
    return _colour_out(color.on_lightness(h, pixelmath.gamma_pp, 1.5, 1.0, _hsl_ls(h), ["image"]))


_L02 = 1.16 * 0.2 ** (1 / 3) - 0.16


@query(RGB + _HSL + f"SELECT image, y, x, round(c0, 6) AS c0, round(c1, 6) AS c1, round(CASE WHEN m > {_L02!r} THEN greatest((c2 - b) / (1 - b), 0) ELSE c2 END, 6) AS c2 FROM (SELECT *, ({_L02!r} - m) / ({_L02!r} - 1) AS b FROM hj)")
def hsl_scale_black(spark, sf_dir):
    h = _hsl(spark, sf_dir)
    return _colour_out(color.hsl_scale_black(h, 0.2, _hsl_ls(h), ["image"]))


def _hsluv_sql(name: str, source: str) -> str:
    """CTEs that take linear RGB (image, y, x, c0, c1, c2) of `source` to HSLuv, by the published definition."""
    return f""", {name}1 AS (SELECT image, y, x, 0.41239079926595948 * c0 + 0.35758433938387796 * c1 + 0.18048078840183429 * c2 AS gx,
  0.21263900587151036 * c0 + 0.71516867876775593 * c1 + 0.072192315360733715 * c2 AS gy, 0.019330818715591851 * c0 + 0.11919477979462599 * c1 + 0.95053215224966058 * c2 AS gz FROM {source}),
{name}2 AS (SELECT *, CASE WHEN gy > 0.0088564516790356308 THEN 1.16 * cbrt(gy) - 0.16 ELSE gy * 9.032962962962963 END AS l, gx + 15 * gy + 3 * gz AS d FROM {name}1),
{name}3 AS (SELECT *, CASE WHEN d > 0 THEN 13 * l * (4 * gx / d - 0.19783000664283681) ELSE 0 END AS u, CASE WHEN d > 0 THEN 13 * l * (9 * gy / d - 0.46831999493879100) ELSE 0 END AS w FROM {name}2),
{name}4 AS (SELECT image, y, x, l, sqrt(u * u + w * w) AS c, CASE WHEN atan2(w, u) < 0 THEN degrees(atan2(w, u)) + 360 ELSE degrees(atan2(w, u)) END AS h,
  CASE WHEN (100 * l + 16) ** 3 / 1560896 > 0.0088564516790356308 THEN (100 * l + 16) ** 3 / 1560896 ELSE 100 * l / 903.2962962962963 END AS q FROM {name}3),
{name}5 AS (SELECT {name}4.*, (284517 * m1 - 94839 * m3) * q AS t1, (838422 * m3 + 769860 * m2 + 731718 * m1) * 100 * l * q - 769860 * e * 100 * l AS t2, (632260 * m3 - 126452 * m2) * q + 126452 * e AS bt
  FROM {name}4, (VALUES (3.240969941904521e0, -1.537383177570093e0, -0.498610760293e0), (-0.96924363628087e0, 1.87596750150772e0, 0.041555057407175e0), (0.055630079696993e0, -0.20397695888897e0, 1.056971514242878e0)) b(m1, m2, m3), (VALUES (0), (1)) o(e)),
{name}6 AS (SELECT image, y, x, l, c, h, (t2 / nullif(bt, 0)) / nullif(sin(radians(h)) - (t1 / nullif(bt, 0)) * cos(radians(h)), 0) AS r FROM {name}5),
{name} AS (SELECT image, y, x, any_value(h) AS c0, CASE WHEN any_value(l) > 0.9999999 OR any_value(l) < 1e-8 THEN 0 ELSE any_value(c) / (min(CASE WHEN r >= 0 THEN r END) / 100) END AS c1, any_value(l) AS c2 FROM {name}6 GROUP BY 1, 2, 3) """


@query(RGB + _hsluv_sql("uv", "rgb") + _COLOUR + "uv")
def rgb_to_hsluv(spark, sf_dir):
    return _colour_out(color.rgb_to_hsluv(_rgb(spark, sf_dir)))


@query(RGB + _COLOUR + "rgb")
def hsluv_round_trip(spark, sf_dir):
    return _colour_out(color.hsluv_to_rgb(color.rgb_to_hsluv(_rgb(spark, sf_dir))))


@query(RGB + ", sc AS (SELECT image, y, x, c0, 0.5 * least(c1, (c0 + c2) / 2) + 0.5 * c1 AS c1, c2 FROM rgb) " + _hsluv_sql("uv", "rgb") + _hsluv_sql("sv", "sc") + "SELECT image, y, x, round(sv.c0, 6) AS c0, round(sv.c1, 6) AS c1, round(uv.c2, 6) AS c2 FROM sv JOIN uv USING (image, y, x)")
def hsl_scnr(spark, sf_dir):
    return _colour_out(color.scnr(color.rgb_to_hsluv(_rgb(spark, sf_dir)), 0.5))


@query(RGB.replace("WITH ", "WITH RECURSIVE ", 1) + _HSL + _stretch_sql("(SELECT image, list(c2 ORDER BY y, x) AS a FROM hs GROUP BY 1)", "image", 0.3, 0.2) + "SELECT image, y, x, round(c0, 6) AS c0, round(c1, 6) AS c1, round(a[y * 8 + x + 1], 6) AS c2 FROM hs JOIN st USING (image)")
def hsl_stretch(spark, sf_dir):
    return _colour_out(color.on_lightness(_hsl(spark, sf_dir), pixelmath.stretch, 0.3, 0.2, ["image"]))


# ---- operators as wholes, and files


@query(PX + """, h AS (SELECT p1.frame_id, lo, hi, CAST(floor((v - lo) * 255 / (hi - lo)) AS INTEGER) AS bin, count(*) AS n FROM p1 JOIN (SELECT frame_id, min(v) AS lo, max(v) AS hi FROM p1 GROUP BY 1) USING (frame_id) GROUP BY 1, 2, 3, 4),
c AS (SELECT *, sum(n) OVER (PARTITION BY frame_id ORDER BY bin) AS up, sum(n) OVER (PARTITION BY frame_id ORDER BY bin DESC) AS down FROM h),
b AS (SELECT frame_id, lo + (min(CASE WHEN up > 6 THEN bin END) + 0.5) * (hi - lo) / 255 AS b, lo + (max(CASE WHEN down > 3 THEN bin END) + 0.5) * (hi - lo) / 255 AS w FROM c GROUP BY frame_id, lo, hi)
SELECT frame_id, y, x, round(least(greatest((v - b) / (w - b), 0), 1), 6) AS v FROM p1 JOIN b USING (frame_id)""")
def black_white(spark, sf_dir):
    return _px_out(pixelmath.black_white(V.px01(spark, sf_dir), 10.0, 5.0, bins=256))


@query(PX + ", q AS (SELECT p1.*, (CASE WHEN v < location - 2 * scale THEN 0 ELSE v END - (location - 2 * scale)) / (1 - (location - 2 * scale)) AS u FROM p1 JOIN ls1 USING (frame_id)) " + _OUT.format("(0.25 - 1) * u / ((2 * 0.25 - 1) * u - 0.25)") + "q")
def midtones_strict(spark, sf_dir):
    return _px_out(pixelmath.midtones(V.px01(spark, sf_dir), 0.25, 2.0, _ls1(spark, sf_dir), strict_compat=True))


@query(PX + "SELECT session, CAST(CASE WHEN hi > lo THEN floor((v - lo) * 63 / (hi - lo) + 0.5) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM pm JOIN (SELECT session, min(v) AS lo, max(v) AS hi FROM pm GROUP BY 1) USING (session) WHERE v IS NOT NULL GROUP BY 1, 2")
def stats_histogram(spark, sf_dir):
    return stats.histogram(V.px_missing(spark, sf_dir), ["session"], 64).select("session", "bin", "n")


_PERCEPTUAL = """, s AS (SELECT session, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1),
h AS (SELECT session, lo, hi, CAST(floor(((v - lo) / (hi - lo)) ** (1 / 2.4) * 63) AS INTEGER) AS bin, count(*) AS n FROM px JOIN s USING (session) GROUP BY 1, 2, 3, 4),
p AS (SELECT session, lo, hi, bin, n FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, bin) AS r FROM h) WHERE r = 1) """


@query(PX + _PERCEPTUAL + "SELECT p.session, round(p.lo + ((p.bin + 0.5) / 63) ** 2.4 * (p.hi - p.lo), 6) AS x, round((p.n + coalesce(h.n, 0)) / 2, 6) AS y FROM p LEFT JOIN h ON h.session = p.session AND h.bin = p.bin + 1")
def stats_perceptual_peak(spark, sf_dir):
    counts = stats.perceptual_histogram(V.px(spark, sf_dir), ["session"], 64)
    return _round(stats.histogram_peak(counts, ["session"], 64, True), "x", "y")


@query()
def stats_gaussian_mode(spark, sf_dir):
    return _round(stats.gaussian_mode(stats.histogram(V.px(spark, sf_dir), ["session"], 64, 0.0), ["session"], 64), "mode", "std_dev")


@query(PX + "SELECT px.frame_id, round(sqrt(avg((v - location) ** 2)), 6) AS std_dev, round(1.4826 * median(abs(v - location)), 6) AS mad FROM px JOIN ls USING (frame_id) WHERE v BETWEEN -0.1 AND 0.15 GROUP BY 1")
def stats_bounded(spark, sf_dir):
    p = V.px(spark, sf_dir)
    return _round(stats.bounded(p, FRAME, stats.median_mad(p, FRAME), -0.1, 0.15), "std_dev", "mad")


@query(PX + """, i AS (SELECT px.frame_id, v FROM px JOIN ls USING (frame_id) WHERE abs(v - location) <= 1.5 * scale), im AS (SELECT frame_id, median(v) AS m FROM i GROUP BY 1)
SELECT frame_id, round(any_value(m), 6) AS location, round(1.4826 * median(abs(v - m)), 6) AS scale FROM i JOIN im USING (frame_id) GROUP BY 1""")
def stats_clipped_median_mad(spark, sf_dir):
    return _round(stats.sigma_clipped_median_mad(V.px(spark, sf_dir), FRAME, 1.5), "location", "scale")


#: Two stars a frame of px, of sizes and masses that follow from the frame's number.
_SKY = ", sky AS (SELECT frame_id, (frame_id * 7 + k * 5) % 8 AS x, (frame_id * 3 + k * 4) % 8 AS y, 0.6 + (frame_id + k) % 3 * 0.4 AS hfr, 1.0 + (frame_id + k) % 5 AS mass FROM (SELECT DISTINCT frame_id FROM px), (VALUES (0), (1)) t(k)) "


def _sky(pixels: DataFrame, key: str = "frame_id") -> DataFrame:
    f, k = F.col(key), F.col("k")
    two = pixels.select(key).distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return two.select(key, ((f * 7 + k * 5) % 8).cast("double").alias("x"), ((f * 3 + k * 4) % 8).cast("double").alias("y"), (0.6 + (f + k) % 3 * 0.4).alias("hfr"), (1.0 + (f + k) % 5).cast("double").alias("mass"))


@query(PX + _SKY + "SELECT px.frame_id, px.y, px.x, round(sum(mass / (pi() * (hfr * 2) ** 2)), 6) AS v FROM px JOIN sky s ON s.frame_id = px.frame_id AND (px.x - s.x) ** 2 + (px.y - s.y) ** 2 <= (hfr * 2) ** 2 GROUP BY 1, 2, 3")
def star_mask(spark, sf_dir):
    p = V.px(spark, sf_dir)
    sizes = p.groupBy("frame_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return _px_out(stencil.star_mask(_sky(p), sizes, 2.0))


def _starry_background_sql() -> str:
    """Cells without stars' discs, the brightest one cleared, missing ones filled by the median of the others that are known (a 2 x 2 grid's cells are all neighbours)."""
    near, far = 0.6826894921370859, 0.15730535589982697  # weights of a normal curve of sigma 0.5 over [-0.5, 0.5] and [0.5, 1.5]
    return PX + _SKY + f""", fr AS (SELECT px.frame_id, px.y, px.x, px.v FROM px WHERE NOT EXISTS (SELECT 1 FROM sky s WHERE s.frame_id = px.frame_id AND (px.x - s.x) ** 2 + (px.y - s.y) ** 2 <= (s.hfr * 2) ** 2)),
c AS (SELECT frame_id, y // 4 AS cy, x // 4 AS cx, v FROM fr),
m AS (SELECT frame_id, cy, cx, median(v) AS m FROM c GROUP BY 1, 2, 3),
d AS (SELECT c.*, m FROM c JOIN m USING (frame_id, cy, cx)),
s AS (SELECT frame_id, cy, cx, median(abs(v - m)) AS s FROM d GROUP BY 1, 2, 3),
ce AS (SELECT frame_id, cy, cx, coalesce(median(CASE WHEN v < m + 1.5 * 1.4826 * s THEN v END), any_value(m)) AS v FROM d JOIN s USING (frame_id, cy, cx) GROUP BY 1, 2, 3),
kn AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY frame_id) > 1 AND v >= max(v) OVER (PARTITION BY frame_id) THEN NULL ELSE v END AS k FROM ce),
al AS (SELECT f.frame_id, g.cy, g.cx, k FROM (SELECT DISTINCT frame_id FROM px) f, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(cy, cx) LEFT JOIN kn ON kn.frame_id = f.frame_id AND kn.cy = g.cy AND kn.cx = g.cx),
fi AS (SELECT frame_id, cy, cx, coalesce(k, median(k) OVER (PARTITION BY frame_id), 0) AS v FROM al),
sm AS (SELECT p.frame_id, p.cy, p.cx, sum(q.v * CASE WHEN p.cy = q.cy THEN {near} ELSE {far} END * CASE WHEN p.cx = q.cx THEN {near} ELSE {far} END) / (({near} + {far}) ** 2) AS v FROM fi p JOIN fi q USING (frame_id) GROUP BY 1, 2, 3),
w AS (SELECT frame_id, max(CASE WHEN cy = 0 AND cx = 0 THEN v END) AS v00, max(CASE WHEN cy = 0 AND cx = 1 THEN v END) AS v01, max(CASE WHEN cy = 1 AND cx = 0 THEN v END) AS v10, max(CASE WHEN cy = 1 AND cx = 1 THEN v END) AS v11 FROM sm GROUP BY 1),
f AS (SELECT px.frame_id, y, x, v, (y + 0.5) / 4.0 - 0.5 AS fy, (x + 0.5) / 4.0 - 0.5 AS fx, v00, v01, v10, v11 FROM px JOIN w USING (frame_id))
SELECT frame_id, y, x, round(v - ((v00 + (v01 - v00) * fx) + ((v10 + (v11 - v10) * fx) - (v00 + (v01 - v00) * fx)) * fy), 6) AS v FROM f"""


@query(_starry_background_sql())
def background_without_stars(spark, sf_dir):
    p = V.px(spark, sf_dir)
    return _px_out(background.subtract(p, background.finished(background.cells(p, 4, 1.5, _sky(p), 2.0), 1)))


@query(PX + ", n AS (SELECT session, count(DISTINCT frame_id) AS n FROM px GROUP BY 1) SELECT session, CASE WHEN n >= 25 THEN 5 WHEN n >= 15 THEN 3 WHEN n >= 6 THEN 2 ELSE 1 END AS mode FROM n")
def stack_auto_mode(spark, sf_dir):
    n = V.px(spark, sf_dir).groupBy("session").agg(F.countDistinct("frame_id").alias("n"))
    return n.select("session", F.udf(lambda k: int(stack.auto_mode(k)), "int")("n").alias("mode"))  # one row a session


@query("""WITH RECURSIVE st AS (SELECT l_suppkey AS frame_id, CAST(l_partkey AS DOUBLE) AS x, CAST(l_orderkey AS DOUBLE) AS y, l_extendedprice AS mass,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey) AS r FROM lineitem),
it AS (SELECT frame_id, x, y, mass, r, [{'x': x, 'y': y}] AS near, TRUE AS kept FROM st WHERE r = 1
UNION ALL SELECT frame_id, x, y, mass, r, CASE WHEN free THEN list_append(near, {'x': x, 'y': y}) ELSE near END, free FROM (
  SELECT st.*, near, len(list_filter(near, lambda k: floor((st.x - k.x) ** 2 + (st.y - k.y) ** 2 + 0.5) <= 4000000)) = 0 AS free FROM it JOIN st ON st.frame_id = it.frame_id AND st.r = it.r + 1 WHERE len(near) < 8))
SELECT frame_id, x, y, mass FROM it WHERE kept""")
def brightest_distant(spark, sf_dir):
    return stars.brightest_distant(V.star_cat(spark, sf_dir).select("frame_id", "x", "y", "mass"), 8, 2000.0)


#: The transform of a frame onto the reference: a small turn, a small stretch and a shift, by its number.
_TURN = {"a": "1.0 + (frame_id % 5) * 0.01", "b": "(frame_id % 7) * 0.02", "c": "(frame_id % 11) * 30.0", "d": "-(frame_id % 7) * 0.02", "e": "1.0 - (frame_id % 3) * 0.01", "f": "(frame_id % 13) * -20.0"}


@query("WITH fr AS (SELECT DISTINCT l_suppkey AS frame_id FROM lineitem) SELECT frame_id, " + ", ".join(f"round(CAST({v} AS DOUBLE), 4) AS {k}" for k, v in _TURN.items()) + " FROM fr")
def align_frames(spark, sf_dir):
    """Every frame holds the 60 brightest stars of the first one, moved; aligning finds the moves."""
    cat = V.bright_stars(spark, sf_dir, 60)
    first = cat.agg(F.min("frame_id").alias("frame_id"))
    ref = cat.join(F.broadcast(first), "frame_id", "left_semi").select("x", "y", "mass")  # first is one row
    t = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("int").alias("frame_id")).distinct().select("frame_id", *[F.expr(v).cast("double").alias(k) for k, v in _TURN.items()])
    u, w, det = F.col("x") - F.col("c"), F.col("y") - F.col("f"), F.col("a") * F.col("e") - F.col("b") * F.col("d")
    moved = t.crossJoin(F.broadcast(ref)).select("frame_id", ((F.col("e") * u - F.col("b") * w) / det).alias("x"), ((F.col("a") * w - F.col("d") * u) / det).alias("y"), "mass")  # 60 rows
    sizes = t.select("frame_id", F.lit(600).alias("width"))
    found = align.align(moved, sizes, ref, 600, 600, k=20)
    return _longs(found.select("frame_id", *[F.round(k, 4).alias(k) for k in "abcdef"]), "frame_id")


@query(PX + "SELECT frame_id, y, x, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) AS v FROM px")
def fits_round_trip(spark, sf_dir):
    files = fits.images(V.px(spark, sf_dir)).select("frame_id", F.lit("frame.fits").alias("path"), "content")
    return _longs(_px_out(fits.samples(files)), "frame_id")


@query(PX + "SELECT frame_id, y, x, round_even(least(greatest((CAST(CAST(v AS FLOAT) AS DOUBLE) + 0.5) / 1.5, 0), 1) * 65535, 0) AS v FROM px")
def tiff_round_trip(spark, sf_dir):
    files = fits.images(V.px(spark, sf_dir), None, lambda data, exposure: tiff.encode(data, -0.5, 1.0)).select("frame_id", F.lit("frame.tif").alias("path"), "content")
    return _longs(fits.samples(files).select("frame_id", "y", "x", F.col("v").cast("double").alias("v")), "frame_id")


@query(PX + _SKY + """, b AS (SELECT sky.*, row_number() OVER (PARTITION BY frame_id ORDER BY mass DESC, x, y) AS r FROM sky)
SELECT frame_id, 0 AS line_no, 'Index,Value,X,Y,Mass,HFR' AS line FROM b WHERE r = 1
UNION ALL SELECT frame_id, r, concat_ws(',', CAST(CAST(y * 8 + x AS INTEGER) AS VARCHAR), CAST(mass AS DECIMAL(9, 1)), CAST(x AS DECIMAL(9, 1)), CAST(y AS DECIMAL(9, 1)), CAST(mass AS DECIMAL(9, 1)), CAST(hfr AS DECIMAL(9, 1))) FROM b""")
def star_csv(spark, sf_dir):
    found = stars.brightest(_sky(V.px(spark, sf_dir)), None)
    cells = found.select("frame_id", "rank", (F.col("y") * 8 + F.col("x")).cast("int").alias("idx"), F.col("mass").alias("value"), "x", "y", "mass", F.round("hfr", 1).alias("hfr"))
    return _longs(stars.csv_lines(cells), "line_no")


@query(RGB + _COLOUR.replace("round(c0, 6)", "round(c0 + 0.1, 6)").replace("round(c2, 6)", "round(c2 - 0.2, 6)") + "rgb")
def rgb_offset(spark, sf_dir):
    return _colour_out(color.offset_rgb(_rgb(spark, sf_dir), 0.1, 0.0, -0.2))


@query(RGB + _COLOUR.replace("round(c0, 6)", "round(least(c0 * 1.3, 1), 6)").replace("round(c1, 6)", "round(least(c1 * 0.8, 1), 6)").replace("round(c2, 6)", "round(least(c2 * 2, 1), 6)") + "rgb")
def rgb_scale(spark, sf_dir):
    return _colour_out(color.scale_rgb(_rgb(spark, sf_dir), 1.3, 0.8, 2.0))


@query(RGB + ", lm AS (SELECT image, median(c2) AS m, min(c2) AS lo, max(c2) AS hi FROM rgb GROUP BY 1), lq AS (SELECT image, any_value(m) AS m, any_value(lo) AS lo, any_value(hi) AS hi, 1.4826 * median(abs(c2 - m)) AS s FROM rgb JOIN lm USING (image) GROUP BY 1)"
       + _blur_sql().replace("px a, k, px b", "rgb a, k, rgb b").replace("frame_id", "image").replace("t * b.v) AS v FROM rgb", "t * b.c2) AS v FROM rgb")
       + "SELECT rgb.image, rgb.y, rgb.x, round(c0, 6) AS c0, round(c1, 6) AS c1, round(CASE WHEN c2 < m + 0.5 * s THEN c2 ELSE least(greatest(c2 + (c2 - bl.v) * 1.5, lo), hi) END, 6) AS c2 FROM rgb JOIN bl USING (image, y, x) JOIN lq USING (image)")
def hsl_unsharp_mask(spark, sf_dir):
    h = _rgb(spark, sf_dir)
    light = h.select("image", F.col("c2").alias("v"))
    limits = stats.median_mad(light, ["image"]).join(stats.basic(light, ["image"]), "image")
    return _colour_out(color.on_lightness(h, stencil.unsharp_mask, limits, 1.0, 1.5, 0.5, BY))


def _balance_sql(source: str, low: str, high: str, name: str) -> str:
    """Channels of `source` so that the m0..m2 of `low` and the s0..s2 of `high` become their means, clamped to [0, 1]."""
    one = lambda i: f"least(greatest((hm - lm) / (s{i} - m{i}) * c{i} + lm - (hm - lm) / (s{i} - m{i}) * m{i}, 0), 1) AS c{i}"
    return f", {name} AS (SELECT image, y, x, {one(0)}, {one(1)}, {one(2)} FROM (SELECT q.*, m0, m1, m2, s0, s1, s2, (m0 + m1 + m2) / 3 AS lm, (s0 + s1 + s2) / 3 AS hm FROM {source} q JOIN {low} USING (image) JOIN {high} USING (image)))"


@query(RGB + ", cm AS (SELECT image, median(c0) AS m0, median(c1) AS m1, median(c2) AS m2 FROM rgb GROUP BY 1), ch AS (SELECT image, any_value(m0) + 3 * 1.4826 * median(abs(c0 - m0)) AS s0, any_value(m1) + 3 * 1.4826 * median(abs(c1 - m1)) AS s1, any_value(m2) + 3 * 1.4826 * median(abs(c2 - m2)) AS s2 FROM rgb JOIN cm USING (image) GROUP BY 1)"
       + _balance_sql("rgb", "cm", "ch", "b1") + _DARK.replace("FROM rgb", "FROM b1")
       + """, sky AS (SELECT image, (image * 7 + k * 5) % 8 AS sx, (image * 3 + k * 4) % 8 AS sy, 0.75 * (0.6 + (image + k) % 3 * 0.4) AS r FROM (SELECT DISTINCT image FROM rgb), (VALUES (0), (1)) t(k)),
tp AS (SELECT image, max(c0) AS t0, max(c1) AS t1, max(c2) AS t2 FROM b1 GROUP BY 1),
sc AS (SELECT image, avg(c0) AS s0, avg(c1) AS s1, avg(c2) AS s2 FROM b1 JOIN tp USING (image) JOIN sky USING (image) WHERE (x - sx) ** 2 + (y - sy) ** 2 <= r * r AND c0 < 0.9 * t0 AND c1 < 0.9 * t1 AND c2 < 0.9 * t2 GROUP BY 1) """
       + _balance_sql("b1", "dk", "sc", "b2") + " " + _COLOUR + "b2")
def rgb_balance_stars(spark, sf_dir):
    rgb = _rgb(spark, sf_dir)
    ls = stats.median_mad(color.planar(rgb), ["image", "ch"])
    return _colour_out(color.rgb_balance(rgb, ls, _sky(rgb, "image"), 2, 0.2, 0.0, 0.0, by=BY))


# ---- frames as tiles of arrays (3 x 3 samples here, so that 8 x 8 frames have nine tiles)


def _tiles(spark, sf_dir):
    return planes.from_pixels(V.px_missing(spark, sf_dir), 3)


@query(PX + _OUT.format("v") + "pm")
def tiles_round_trip(spark, sf_dir):
    return _longs(_px_out(planes.to_pixels(_tiles(spark, sf_dir), 3)), "frame_id")


@query(PX + _OUT.format("CAST(CAST(v * 1.5 + 0.25 AS FLOAT) AS DOUBLE)") + "pm")
def tiles_scale_offset(spark, sf_dir):
    return _longs(_px_out(planes.to_pixels(planes.mapped(_tiles(spark, sf_dir), lambda v: v.astype(float) * 1.5 + 0.25), 3)), "frame_id")


@query(PX + _blur_sql() + _OUT.format("CAST(CAST(v AS FLOAT) AS DOUBLE)") + "bl")
def tiles_gauss_blur(spark, sf_dir):
    taps = stencil.gaussian_kernel(1.0)
    t = planes.from_pixels(V.px(spark, sf_dir), 3)
    return _longs(_px_out(planes.to_pixels(planes.stencil(t, lambda a, y0, x0, h, w: stencil.blurred(a, y0, x0, h, w, taps), 1, 3), 3)), "frame_id")


@query(PX + "SELECT frame_id, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std_dev FROM pm GROUP BY 1")
def tiles_statistics(spark, sf_dir):
    return _longs(_round(planes.statistics(_tiles(spark, sf_dir)).drop("n"), "min", "max", "mean", "std_dev"), "frame_id")


@query(PX + ", g AS (SELECT y, x, v FROM pm), a AS (SELECT y, x, median(v) AS m FROM g GROUP BY 1, 2), b AS (SELECT y, x, any_value(m) AS m, 1.4826 * median(abs(v - m)) AS s FROM g JOIN a USING (y, x) GROUP BY 1, 2) SELECT y, x, round(CAST(CAST(avg(CASE WHEN v >= m - 2 * s AND v <= m + 2 * s THEN v END) AS FLOAT) AS DOUBLE), 6) AS v FROM g JOIN b USING (y, x) GROUP BY 1, 2")
def tiles_stack_mad_sigma(spark, sf_dir):
    t = _tiles(spark, sf_dir)
    done = planes.stacked(t, stack.StackMode.MAD_SIGMA, t.select("frame_id").distinct().count(), 2.0, 2.0, 3)
    return _round(planes.to_pixels(done.withColumn("frame_id", F.lit(0)), 3).select("y", "x", "v"), "v")


# ---- what streams run, over whole tables


@query(PX + "SELECT session, y, x, round(sum(v * exposure) / sum(CASE WHEN v IS NOT NULL THEN exposure END), 6) AS v, count(v) AS frames FROM pm JOIN (SELECT frame_id, exposure FROM fm) USING (frame_id) GROUP BY 1, 2, 3")
def stack_incremental(spark, sf_dir):
    exposed = V.px_missing(spark, sf_dir).withColumn("exposure", 30.0 + 10 * (F.col("frame_id") % 4))
    return _round(incremental.incremental_stack(exposed, SESSION, "exposure"), "v")


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, round(avg(value), 6) AS v, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_levels(spark, sf_dir):
    out = incremental.windowed_levels(V.table(spark, sf_dir, "events"))
    return _round(out.withColumn("start", F.unix_timestamp("start")), "v")


# ---- event signal


@query("""WITH e AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, value FROM events),
k AS (SELECT list_sort(list(DISTINCT event_type)) AS kinds FROM e),
s AS (SELECT event_type, h - (SELECT min(h) FROM e) AS x, avg(value) AS v FROM e GROUP BY 1, 2),
r AS (SELECT CAST(list_position((SELECT kinds FROM k), event_type) - 1 AS INTEGER) AS y, x, v FROM s),
m AS (SELECT y, median(v) AS m FROM r GROUP BY 1)
SELECT y, round(any_value(m), 6) AS location, round(1.4826 * median(abs(v - m)), 6) AS scale FROM r JOIN m USING (y) GROUP BY 1""")
def signal_location_scale(spark, sf_dir):
    return _round(stats.median_mad(V.signal(spark, sf_dir), ["y"]), "location", "scale")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
