"""Tail scans and slice fits against independent fits."""

import math

import numpy as np
import pytest

from firn.operators.histogram import Axis
from firn.operators.tails import fit_slices, gaussian_fit, tail_scan


def test_scan_recovers_the_laws(spark):
    axis = Axis(40, 0.0, 20.0)
    laws = {"e": lambda x: 5000 * math.exp(-0.4 * x), "p": lambda x: 9000 * x**-2.5}
    rows = [(k, b, f((b - 0.5) * axis.width)) for k, f in laws.items() for b in range(0, 42) if b > 0 or k == "e"]
    hist = spark.createDataFrame([*rows, ("e", 3, 0.0)], "k string, bin int, content double").filter("k = 'p' or bin <> 3 or content = 0")
    got = {(r["k"], r["model"], r["start"]): r for r in tail_scan(hist, axis, 12.0, ["k"]).collect()}
    assert all(0 <= s < 20 for _, _, s in got) and ("e", "exponential", 1.0) not in got
    for start in (0.5, 5.0, 15.0):
        e, p = got["e", "exponential", start], got["p", "power", start]
        assert math.isclose(e["slope"], -0.4, rel_tol=1e-8) and math.isclose(math.exp(e["intercept"]), 5000, rel_tol=1e-8) and e["good"]
        assert math.isclose(p["slope"], -2.5, rel_tol=1e-8) and math.isclose(math.exp(p["intercept"]), 9000, rel_tol=1e-7) and p["good"]
        assert math.isclose(e["above"], 5000 / 0.4 * math.exp(-0.4 * 12) / 0.5, rel_tol=1e-7)
        assert math.isclose(p["above"], 9000 / 1.5 * 12**-1.5 / 0.5, rel_tol=1e-7)
    assert not got["e", "power", 0.5]["good"]
    assert got["e", "exponential", 19.5]["slope"] is None and got["e", "exponential", 19.0]["reduced_chi"] is None


def test_scan_equals_polyfit(spark):
    axis, draw = Axis(30, 0.0, 30.0), np.random.default_rng(4)
    content = draw.poisson(400 * np.exp(-0.2 * (np.arange(30) + 0.5)))
    hist = spark.createDataFrame([(int(b + 1), float(c)) for b, c in enumerate(content)], "bin int, content double")
    got = {(r["model"], r["start"]): r for r in tail_scan(hist, axis, 20.0).collect()}
    x = np.arange(30) + 0.5
    for start in (0, 7, 14):
        use = (np.arange(30) >= start) & (content > 0)
        for model, place in (("exponential", x), ("power", np.log(x))):
            slope, intercept = np.polyfit(place[use], np.log(content[use]), 1, w=np.sqrt(content[use]))
            chi = (content[use] * (np.log(content[use]) - slope * place[use] - intercept) ** 2).sum() / (use.sum() - 2)
            r = got[model, float(start)]
            assert np.allclose([r["slope"], r["intercept"], r["reduced_chi"]], [slope, intercept, chi], rtol=1e-6)


def test_slices_equal_an_independent_search(spark):
    axis, draw = Axis(50, -10.0, 10.0), np.random.default_rng(6)
    rows, truth = [], {}
    for slice_, (mean, width, n) in enumerate([(0.0, 1.0, 4000), (3.5, 0.4, 500), (-2.0, 3.0, 9000), (1.0, 0.05, 300)], 1):
        counts, _ = np.histogram(draw.normal(mean, width, n), 50, (-10, 10))
        truth[slice_] = counts
        rows += [(slice_, b + 1, float(c)) for b, c in enumerate(counts)] + [(slice_, 0, 77.0), (slice_, 51, 88.0)]
    hist = spark.createDataFrame(rows, "bin_x int, bin_y int, content double")
    got = {r["bin_x"]: r for r in fit_slices(hist, axis).collect()}
    assert [got[s]["converged"] for s in (1, 2, 3, 4)] == [True, True, True, False]
    x = np.arange(50) * 0.4 - 9.8
    for s in (1, 2, 3):
        c = truth[s][truth[s] > 0]
        at = x[truth[s] > 0]

        def chi(h, m, w, at=at, c=c):
            return float((((c - h * np.exp(-0.5 * ((at - m) / w) ** 2)) ** 2) / c).sum())

        best = (got[s]["height"], got[s]["mean"], got[s]["width"])
        least = chi(*best)
        assert math.isclose(least / (len(c) - 3), got[s]["reduced_chi"], rel_tol=1e-9)
        # A search by shrinking steps from elsewhere ends at the same place.
        p, step = np.array([c.max() * 0.8, at[c.argmax()] + 0.3, got[s]["width"] * 1.3]), np.array([c.max() * 0.1, 0.2, 0.2])
        for _ in range(4000):
            moves = [p + step * d for d in np.vstack((np.eye(3), -np.eye(3)))]
            q = min(moves, key=lambda v: chi(*v))
            p, step = (q, step) if chi(*q) < chi(*p) else (p, step / 2)
        assert chi(*p) >= least * (1 - 1e-6)


@pytest.mark.parametrize("content", [[5.0], [3.0, 9.0], [0.5] * 7])
def test_few_bins(content):
    height, mean, width, _, converged = gaussian_fit(np.arange(len(content), dtype=float), np.array(content))
    assert height > 0 and np.isfinite([mean, width]).all() and (len(content) >= 3 or not converged)
