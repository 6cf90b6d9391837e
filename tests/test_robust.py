import numpy as np
import pytest

from frameloom.functions import robust


def brute_sigma(v, low, high, w=None):
    v = [float(x) for x in v if x == x]
    w = None if w is None else list(w)
    lo_n = hi_n = 0
    while True:
        med, mean, sd = np.median(v), np.mean(v), np.std(v)
        keep = [med - low * sd <= x <= med + high * sd for x in v]
        lo_n += sum(x < med - low * sd for x in v)
        hi_n += sum(x > med + high * sd for x in v)
        left = [x for x, k in zip(v, keep) if k]
        wl = None if w is None else [x for x, k in zip(w, keep) if k]
        if w is not None:
            mean = np.dot(left, wl) / sum(wl)
        if len(left) == len(v) or len(left) <= 1:
            return mean, lo_n, hi_n
        v, w = left, wl


@pytest.mark.parametrize("seed", range(4))
def test_sigma_clip_against_brute_force(seed):
    r = np.random.default_rng(seed)
    m = r.normal(size=(40, 31))
    m[:, :3] += r.choice([0, 20, -15], size=(40, 3))
    m[r.random(m.shape) < 0.1] = np.nan
    v, lo, hi = robust.sigma_clip(m, 2.0, 2.5)
    for row, a, b, c in zip(m, v, lo, hi):
        want = brute_sigma(row, 2.0, 2.5)
        assert (b, c) == want[1:] and a == pytest.approx(want[0])


def test_weighted_sigma_clip_uses_the_set_that_is_left():
    m = np.array([[1.0, 1.1, 0.9, 1.05, 0.95, 1.0, 9.0]])
    w = np.array([[1.0, 2, 3, 4, 5, 6, 7]])
    v, lo, hi = robust.sigma_clip(m, 2.0, 2.0, w)
    want = brute_sigma(m[0], 2.0, 2.0, w[0])
    assert v[0] == pytest.approx(want[0]) and hi[0] == want[2] >= 1


@pytest.mark.parametrize("f", [robust.sigma_clip, robust.linear_fit, robust.mad_sigma])
def test_kernels_on_edge_cases(f):
    m = np.array([[np.nan] * 4, [2.0, 2.0, 2.0, 2.0], [1.0, np.nan, np.nan, np.nan], [1.0, 1.0, 1.0, 100.0]])
    v, lo, hi = f(m, 2.75, 2.75)
    assert np.isnan(v[0]) and v[1] == 2 and v[2] == 1
    assert lo[1] == hi[1] == 0


def test_winsor_rejects_a_gross_outlier():
    m = np.concatenate([np.random.default_rng(1).normal(size=(5, 30)), np.full((5, 1), 50.0)], axis=1)
    v, lo, hi = robust.sigma_clip(m, 2.75, 2.75, winsor=True)
    assert (hi >= 1).all() and (np.abs(v) < 1).all()


def test_linear_fit_rejects_a_gross_outlier():
    m = np.concatenate([np.arange(30.0)[None, :] / 30, [[50.0]]], axis=1)
    v, lo, hi = robust.linear_fit(m, 2.75, 2.75)
    assert hi[0] >= 1 and v[0] < 1


def test_estimators_of_a_normal_sample():
    v = np.random.default_rng(3).normal(5, 2, 20_000)
    for location, scale in (robust.ikss(v), robust.clipped_median_qn(v)):
        assert location == pytest.approx(5, abs=0.1) and scale == pytest.approx(2, abs=0.1)
    assert robust.ikss(np.array([3.0, 3.0, 3.0])) == (3.0, 0.0)


def test_fitted_normal_finds_the_curve_and_no_nearer_one_is_close():
    x = np.linspace(-3, 5, 200)
    mean, spread = robust.fitted_normal(x, 40 * np.exp(-0.5 * ((x - 0.7) / 0.9) ** 2))
    assert mean == pytest.approx(0.7, abs=1e-6) and spread == pytest.approx(0.9, abs=1e-6)
    r = np.random.default_rng(0)
    counts = np.histogram(r.normal(1, 0.5, 3000), bins=np.append(x, 5.04))[0].astype(float)
    mean, spread = robust.fitted_normal(x, counts)

    def error(m, s):
        e = np.exp(-0.5 * ((x - m) / s) ** 2)
        a = (e * counts).sum() / (e * e).sum()  # the best height
        return ((counts - a * e) ** 2).sum()

    assert all(error(mean, spread) <= error(mean + a, spread + b) for a in np.linspace(-0.2, 0.2, 41) for b in np.linspace(-0.2, 0.2, 41))
    assert np.isnan(robust.fitted_normal(x, np.zeros(200))).all()
