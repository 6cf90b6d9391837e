"""Robust estimators over small groups, vectorised in numpy.

Kernels take a matrix with one group per row, missing values NaN, and work on all rows at
once; rows drop out of the loop as they settle.
"""

from __future__ import annotations

import numpy as np

MAD_TO_SIGMA = 1.4826
#: Constants of the published estimators: Qn consistency, clipped-scale correction, IKSS scale.
QN, CLIPPED, IKSS = 2.21914, 1.134, 0.991


def as_matrix(lists) -> np.ndarray:
    """A ragged sequence of number sequences as a matrix padded with NaN."""
    sizes = np.array([0 if x is None else len(x) for x in lists], np.int64)
    out = np.full((len(sizes), int(sizes.max()) if len(sizes) else 0), np.nan)
    for row, x in zip(out, lists):
        if x is not None and len(x):
            row[: len(x)] = np.asarray(x, np.float64)
    return out


def _quiet(f):
    def inner(*a, **k):
        with np.errstate(all="ignore"):
            import warnings

            with warnings.catch_warnings():
                warnings.simplefilter("ignore", RuntimeWarning)
                return f(*a, **k)

    return inner


@_quiet
def median_of_rows(m: np.ndarray) -> np.ndarray:
    """Median of each row, NaN left out; NaN for a row of nothing else."""
    a = np.sort(m, axis=1)  # NaN sort last
    n = (~np.isnan(a)).sum(axis=1)
    at = lambda k: np.take_along_axis(a, np.maximum(k, 0)[:, None], axis=1)[:, 0]
    return (at((n - 1) // 2) + at(n // 2)) / 2 if m.shape[1] else np.full(len(m), np.nan)


@_quiet
def mad_sigma(m: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean of the values within median -low/+high scaled MADs, and how many fell below and above."""
    median = np.nanmedian(m, axis=1, keepdims=True)
    spread = MAD_TO_SIGMA * np.nanmedian(np.abs(m - median), axis=1, keepdims=True)
    below, above = m < median - low * spread, m > median + high * spread
    return np.nanmean(np.where(below | above, np.nan, m), axis=1), below.sum(axis=1), above.sum(axis=1)


def _mean(m: np.ndarray, w: np.ndarray | None) -> np.ndarray:
    if w is None:
        return np.nanmean(m, axis=1)
    ok = ~np.isnan(m)
    return np.where(ok, m * w, 0).sum(axis=1) / np.where(ok, w, 0).sum(axis=1)


@_quiet
def sigma_clip(m: np.ndarray, low: float, high: float, w: np.ndarray | None = None, winsor: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Iterative clipping at median -low/+high standard deviations.

    Each pass drops values strictly outside and ends when none was dropped or at most one is
    left.  Without weights the result is the mean of the set that the last pass began with,
    with weights the weighted mean of the set it left.  With winsor=True the standard
    deviation comes from values pulled in to median +- 1.5 sigma until sigma settles.
    """
    m = m.copy()
    out = np.full(len(m), np.nan)
    n_low, n_high = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64)
    live = np.flatnonzero((~np.isnan(m)).any(axis=1))
    while len(live):
        a = m[live]
        median = np.nanmedian(a, axis=1, keepdims=True)
        sigma = _winsorised(a, median) if winsor else np.nanstd(a, axis=1, keepdims=True)
        below, above = a < median - low * sigma, a > median + high * sigma
        b = np.where(below | above, np.nan, a)
        m[live] = b
        out[live] = np.nanmean(a, axis=1) if w is None else _mean(b, w[live])
        n_low[live] += below.sum(axis=1)
        n_high[live] += above.sum(axis=1)
        live = live[((below | above).any(axis=1)) & ((~np.isnan(b)).sum(axis=1) > 1)]
    return out, n_low, n_high


def _winsorised(a: np.ndarray, median: np.ndarray) -> np.ndarray:
    a = a.copy()
    sigma = np.nanstd(a, axis=1, keepdims=True)
    live = np.arange(len(a))
    while len(live):  # each pass that goes on has pulled a value in, and sigma shrinks or settles
        lo, hi = median[live] - 1.5 * sigma[live], median[live] + 1.5 * sigma[live]
        b = np.clip(a[live], lo, hi)
        changed = ((b != a[live]) & ~np.isnan(b)).any(axis=1)
        a[live] = b
        new = CLIPPED * np.nanstd(b, axis=1, keepdims=True)
        settled = (np.abs(new - sigma[live]) <= 5e-4 * sigma[live])[:, 0]
        sigma[live] = new
        live = live[changed & ~settled]
    return sigma


@_quiet
def linear_fit(m: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clipping about a line through the sorted values; the result is the mean at the last fit.

    The slope uses the covariance over n + 1; sigma is the mean absolute residual.  Passes end when
    none was dropped or fewer than three values are left.
    """
    a = np.sort(m, axis=1)
    out = np.full(len(a), np.nan)
    n_low, n_high = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    live = np.flatnonzero(~np.isnan(a[:, 0])) if a.shape[1] else np.zeros(0, np.int64)
    while len(live):
        b = a[live]
        ok = ~np.isnan(b)
        n = ok.sum(axis=1, keepdims=True).astype(float)
        x = np.where(ok, np.arange(b.shape[1]), 0.0)
        y = np.where(ok, b, 0.0)
        mx, my = x.sum(axis=1, keepdims=True) / n, y.sum(axis=1, keepdims=True) / n
        cov = np.where(ok, (x - mx) * (y - my), 0).sum(axis=1, keepdims=True) / (n + 1)
        var = np.where(ok, (x - mx) ** 2, 0).sum(axis=1, keepdims=True) / n
        slope = np.where(var > 0, cov / var, 0.0)
        fit = my + slope * (x - mx)
        sigma = np.where(ok, np.abs(b - fit), 0).sum(axis=1, keepdims=True) / n
        below, above = ok & (fit - b > low * sigma), ok & (b - fit > high * sigma)
        out[live] = my[:, 0]
        n_low[live] += below.sum(axis=1)
        n_high[live] += above.sum(axis=1)
        c = np.sort(np.where(below | above, np.nan, b), axis=1)
        a[live] = c
        live = live[(below | above).any(axis=1) & ((~np.isnan(c)).sum(axis=1) >= 3)]
    return out, n_low, n_high


@_quiet
def biweight_midvariance(v: np.ndarray, median: float, mad: float) -> float:
    """Square root of the biweight midvariance with tuning constant 9 (raw MAD)."""
    if mad == 0:
        return 0.0
    u = (v - median) / (9 * mad)
    d, k = (v - median)[np.abs(u) < 1], u[np.abs(u) < 1] ** 2
    down = ((1 - k) * (1 - 5 * k)).sum()
    return float(np.sqrt(len(v) * (d**2 * (1 - k) ** 4).sum()) / abs(down)) if down else 0.0


def ikss(v: np.ndarray, epsilon: float = 1e-3) -> tuple[float, float]:
    """Iterative k-sigma location and scale: keep median +- 4 s, s from the biweight midvariance, until s settles."""
    v = np.sort(v[~np.isnan(v)])
    last = 1.0
    while len(v):
        median = float(np.median(v))
        mad = float(np.median(np.abs(v - median)))
        if mad == 0:
            return median, 0.0
        s = biweight_midvariance(v, median, mad)
        if s == 0:
            return median, 0.0
        if last - s < s * epsilon:
            return median, IKSS * s
        last = s
        v = v[(v >= median - 4 * s) & (v <= median + 4 * s)]
    return float("nan"), float("nan")


def fitted_normal(x: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Mean and standard deviation of the normal curve nearest to counts at x, by damped Gauss-Newton steps from the moments about the peak."""
    if not counts.sum():
        return float("nan"), float("nan")
    mu = float(x[counts.argmax()])
    sigma = float(np.sqrt((counts * (x - mu) ** 2).sum() / counts.sum())) or float(np.diff(x).mean() if len(x) > 1 else 1.0)
    p, damp = np.array([counts.max(), mu, sigma]), 1e-3
    curve = lambda q: q[0] * np.exp(-0.5 * ((x - q[1]) / q[2]) ** 2)
    error = float(((counts - curve(p)) ** 2).sum())
    for _ in range(rounds):
        u = (x - p[1]) / p[2]
        e = np.exp(-0.5 * u * u)
        j = np.stack([e, p[0] * e * u / p[2], p[0] * e * u * u / p[2]], 1)
        a = j.T @ j
        step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-300), j.T @ (counts - p[0] * e), rcond=None)[0]
        q = p + step
        new = float(((counts - curve(q)) ** 2).sum()) if q[2] > 0 else np.inf
        if new <= error:
            done = error - new <= 1e-14 * error
            p, error, damp = q, new, damp / 5
            if done:
                break
        else:
            damp *= 5
            if damp > 1e12:
                break
    return float(p[1]), float(p[2])


def qn(v: np.ndarray, seed: int = 1, pairs: int = 131_072) -> float:
    """Rousseeuw and Croux's Qn; all pairs for small groups, a seeded sample of pairs for others."""
    n = len(v)
    if n < 2:
        return 0.0
    if n * (n - 1) // 2 <= pairs:
        i, j = np.triu_indices(n, 1)
    else:
        r = np.random.Generator(np.random.PCG64(seed))
        i = r.integers(1, n, pairs)
        j = (r.random(pairs) * i).astype(np.int64)
    d = np.abs(v[i] - v[j])
    return QN * float(np.partition(d, len(d) // 4)[len(d) // 4])


def clipped_median_qn(v: np.ndarray, seed: int = 1) -> tuple[float, float]:
    """Location: median clipped at 2 sigma until it settles; scale: Qn of all values."""
    v = v[~np.isnan(v)]
    if not len(v):
        return float("nan"), float("nan")
    epsilon = (v.max() - v.min()) / 65535
    location, scale = float(np.median(v)), qn(v, seed)
    whole = scale
    for _ in range(10):
        inside = v[np.abs(v - location) <= 2 * scale]
        if not len(inside):
            break
        new, s = float(np.median(inside)), CLIPPED * qn(inside, seed)
        if abs(new - location) + abs(s - scale) <= epsilon:
            break
        location, scale = new, s
    return location, whole
