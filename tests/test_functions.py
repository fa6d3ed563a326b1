"""Row-local functions against numpy and closed forms."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from firn.functions import angles, geodesy, names, scores, spectral, waveform
from firn.functions.fitting import fit_pairs
from firn.functions.rayleigh import fit_windows
from firn.operators import imaging
from firn.sources import readers


@pytest.fixture(scope="module")
def sines(spark):
    t = 0.1 * np.arange(256)
    y1, y2 = 3.3 * np.sin(0.7 * t + math.pi / 2), 1.6 * np.sin(1.8 * t)
    return spark.createDataFrame([(t.tolist(), y1.tolist(), y2.tolist())], "x array<double>, a array<double>, b array<double>"), y1, y2


def test_power_normalisations_match_the_wave(sines):
    df, y, _ = sines
    total = float((y**2).sum())
    row = df.select(*[waveform.total(spectral.power_spectrum(F.col("a"), 0.1, n)).alias(n) for n in ("sum", "average", "time_integral")]).first()
    assert abs(row["sum"] - total) < 1e-10
    assert abs(row["average"] - total / 256) < 1e-10
    assert abs(row["time_integral"] - 0.1 * total) < 1e-10


def test_inverse_and_autocorrelation(sines):
    df, y, _ = sines
    unit = waveform.normalised(F.col("a"), waveform.mean(F.col("a")), waveform.rms(F.col("a")))
    row = df.select(
        spectral.inverse(spectral.forward(F.col("a")), 256).alias("back"), spectral.cross_correlate(unit, unit).alias("auto"),
        spectral.inverse(spectral.zero_pad_spectrum(spectral.forward(F.col("a")), 256, 1024), 1024).alias("fine"),
    ).first()
    np.testing.assert_allclose(row["back"], y, atol=1e-12)
    assert abs(row["auto"][0] - 1) < 1e-12 and max(row["auto"]) == row["auto"][0]
    np.testing.assert_allclose(row["fine"][::4], y, atol=0.05)


def test_akima_passes_through_knots_and_is_zero_outside(spark):
    x = [0.0, 1.0, 2.0, 4.0, 5.0]
    y = [0.0, 1.0, 4.0, 16.0, 25.0]
    df = spark.createDataFrame([(x, y)], "x array<double>, y array<double>")
    got = df.select(spectral.resample_akima(F.col("x"), F.col("y"), -1.0, 1.0, 8).alias("v")).first()["v"]
    np.testing.assert_allclose([got[i] for i in (1, 2, 3, 5, 6)], y)
    assert got[0] == 0 and got[7] == 0


def test_narrowest_window_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for _ in range(20):
        t, v = np.arange(40) * 0.5, rng.normal(size=40)
        sums = np.concatenate([[0], np.cumsum(v[:-1] ** 2 * 0.5)])
        want.append(min(t[j] - t[i] for i in range(40) for j in range(i + 1, 40) if sums[j] - sums[i] >= 0.6 * sums[-1]))
        rows.append((t.tolist(), v.tolist()))
    df = spark.createDataFrame(rows, "x array<double>, y array<double>")
    got = df.select(spectral.narrowest_window(F.col("x"), F.col("y"), 0.6).alias("w")).toPandas()["w"]
    np.testing.assert_allclose([w["end"] - w["begin"] for w in got], want)


def test_impulsivity_limits(spark):
    spike, flat = [0.0] * 50 + [1.0] + [0.0] * 50, [1.0] * 101
    df = spark.createDataFrame([(1, spike), (2, flat)], "i int, e array<double>")
    got = {r["i"]: r["m"] for r in df.select("i", spectral.impulsivity(F.col("e")).alias("m")).collect()}
    assert got[1] == 1.0 and abs(got[2]) < 0.02


def test_traced_direction_is_seen_where_it_came_from(spark):
    rows = [(-100.0 + 7 * i, -85.0 + i, 37000.0, 12.0 * i, -6.5 - 0.5 * i, (40.0 * i) % 360) for i in range(9)]
    df = spark.createDataFrame(rows, "longitude double, latitude double, altitude double, heading double, theta double, phi double")
    payload = {c: F.col(c) for c in ("longitude", "latitude", "altitude", "heading")}
    hit = df.withColumn("h", geodesy.trace_to_surface(payload, F.col("theta"), F.col("phi")))
    seen = geodesy.view_angles(payload, {"longitude": F.col("h.longitude"), "latitude": F.col("h.latitude"), "altitude": F.lit(0.0)})
    for r in hit.withColumn("v", seen).collect():
        assert abs(r["v"]["theta"] - r["theta"]) < 1e-7
        assert abs((r["v"]["phi"] - r["phi"] + 180) % 360 - 180) < 1e-7
        assert abs(r["v"]["distance"] - r["h"]["distance"]) < 1e-3
    up = df.withColumn("h", geodesy.trace_to_surface(payload, F.lit(2.0), F.col("phi"))).filter(F.col("h.longitude").isNotNull())
    assert up.count() == 0


def test_pair_fit_recovers_a_common_source():
    from firn.functions.fitting import _residuals

    lon, lat = np.array([30.0]), np.array([-80.0])
    base = dict(alt=np.array([37000.0]), heading=np.array([0.0]), theta=np.zeros(1), phi=np.zeros(1), sigma_theta=np.ones(1), sigma_phi=np.ones(1))
    events = []
    for dlon, dlat in ((8.0, 1.5), (-10.0, 2.0)):
        e = dict(base, lon=lon + dlon, lat=lat + dlat)
        r = _residuals(e, lon, lat)
        e["theta"], e["phi"] = r[0], r[1]
        e["sigma_theta"], e["sigma_phi"] = np.array([0.25]), np.array([0.5])
        events.append(e)
    ll, flon, flat, converged = fit_pairs(events[0], events[1], lon + 1.0, lat - 0.2)
    assert converged[0] and ll[0] < 1e-6 and abs(flon[0] - 30.0) < 1e-3 and abs(flat[0] + 80.0) < 1e-3


def test_rayleigh_fit_of_rayleigh_numbers():
    rng = np.random.default_rng(2)
    scale, chi, ndf = fit_windows(rng.rayleigh(3.0, (5, 4000)))
    np.testing.assert_allclose(scale, 3.0, rtol=0.05)
    assert (chi / ndf < 4).all()


def test_names():
    assert names.branchify("((mc.weight > 0)*mc.weight + 1*(mc.weight==0))") == "weight"
    assert names.branchify("floor(Iteration$/5)") == "pol"
    assert names.branchify("sum.highestPeak().dPhiMC()") == "highestPeak_dPhiMC"
    assert names.branchify("flags.topPower[0]") == "flags_topPower_0"
    assert names.branchify(names.window_gradient_text("coherent_filtered")) == "coherent_filtered_fracPowerWindowGradient"


def test_delta_angle_edges(spark):
    values = [0.0, 180.0, -180.0, 180.1, 540.0, 1619.0, 1620.0, -1620.0, -1621.0]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    got = [r[0] for r in df.select(angles.delta_angle(F.col("d"))).collect()]
    assert got[:5] == [0.0, 180.0, -180.0, pytest.approx(-179.9), -180.0]
    assert got[5] == pytest.approx(179.0) and got[6] is None and got[7] == -180.0 and got[8] is None


def test_antenna_pairs_of_three_rings(spark):
    ants = spark.range(48).select(F.col("id").cast("int").alias("ant"))
    pairs = imaging.antenna_pairs(ants)
    assert pairs.count() == 336 and pairs.distinct().count() == 336


def test_quadratic_peak(spark):
    x = np.arange(12) * 0.25
    m = 5 - (x[:, None] - 1.4) ** 2 - 2 * (x[None, :] - 1.6) ** 2
    df = spark.createDataFrame([(m.ravel().tolist(),)], "m array<double>")
    q = df.select(imaging.quadratic_peak(F.col("m"), 12, 12).alias("q")).first()["q"]
    assert (round(q["value"], 6), round(q["d_phi"], 6), round(q["d_theta"], 6)) == (5.0, 1.4, 1.6)


def test_settings_and_weights():
    found = readers.settings("[A]\nx=1 # note\nx=2\n[B]\ny = z\nno pair here\n")
    assert found == {"A": {"x": "1"}, "B": {"y": "z"}}
    xml = '<M><V><Variable VarIndex="0" Expression="a"/><Variable VarIndex="1" Expression="b/c"/></V><W><Coefficient Index="0" Value="0.5"/><Coefficient Index="1" Value="2"/><Coefficient Index="2" Value="-1"/></W></M>'
    d = readers.discriminant_xml(xml)
    assert d.intercept == 0.5 and d.terms == [(2.0, "a"), (-1.0, "b/c")]
    assert d.text() == "0.500000+(2.000000*a)+(-1.000000*b/c)"


def test_score_text_round_trip(spark):
    df = spark.createDataFrame([(2.0, 4.0, 0.0)], "a double, b double, c double")
    assert df.select(scores.linear_score(0.5, [(2.0, "a"), (-1.0, "b/a")])).first()[0] == 2.5
    assert df.select(scores.linear_score(0.5, [(1.0, "b/c")])).first()[0] is None


def test_division_of_task():
    assert readers.division_of_task(352) == (352, 0, 1)
    assert readers.division_of_task(3527) == (352, 7, 10)
    assert readers.division_of_task(35242) == (352, 42, 100)
    assert pd.notna(readers.division_of_task(130)[0])


def test_geometry_of_many_rows_is_compiled(spark):
    """Traces and views run step by step, without interpreted lambdas, and give what the single expressions give."""
    from firn.operators.clustering import event_geometry, residuals

    rows = [(i, 7.0 * i - 170, -62.0 - i % 27, 36e3 + 90 * i, 31.0 * i, 2.0 if i % 9 == 8 else -4.0 - i % 40, 17.0 * i, 5.0 + i % 3) for i in range(50)]
    names = ("id", "payload_longitude", "payload_latitude", "payload_altitude", "payload_heading", "theta", "phi", "snr")
    df = spark.createDataFrame(rows, names)
    payload = {c: F.col(f"payload_{c}") for c in ("longitude", "latitude", "altitude", "heading")}
    made = event_geometry(df).filter("clusterable")
    centres = made.select("id", "longitude", F.col("latitude").alias("latitude"), F.lit(100.0).alias("altitude"))
    moved = residuals(made, centres, ["id"])
    for steps in (event_geometry(df), made, moved):
        assert "lambda" not in steps._jdf.queryExecution().optimizedPlan().toString()
    hit = df.withColumn("_h", geodesy.trace_to_surface(payload, F.col("theta"), F.col("phi"))).filter("_h.longitude is not null")
    want = {r["id"]: tuple(r["_h"]) for r in hit.collect()}
    assert {r["id"]: (r["longitude"], r["latitude"], r["distance_m"]) for r in made.collect()} == want and 30 < len(want) < 50
    seen = made.withColumn("_v", geodesy.view_angles(payload, {"longitude": F.col("longitude"), "latitude": F.col("latitude"), "altitude": F.lit(100.0)}))
    turned = {r["id"]: r["d_theta"] for r in moved.collect()}
    assert turned == {r["id"]: r["_v"]["theta"] - r["theta"] for r in seen.collect()}


def test_waveforms_are_handed_over_in_slices():
    rng = np.random.default_rng(3)
    rows = [None if k % 97 == 0 else rng.normal(size=64 if k % 5 else 32) for k in range(3000)]
    sizes = []

    def doubled(m):
        sizes.append(len(m))
        return 2 * m

    got = spectral.stacked(doubled, pa.array(rows, pa.list_(pa.float64()))).to_pylist()
    assert max(sizes) <= spectral.SLICE
    for g, w in zip(got, rows):
        assert (g is None) == (w is None) and (w is None or np.array_equal(g, 2 * w))


def test_peaks_are_found_where_the_map_is_made(spark):
    geometry = spark.range(16).select(F.col("id").cast("int").alias("ant"), F.lit(2.0).alias("r"), (F.col("id") % 2 * 0.5).alias("z"), (F.col("id") * 22.5).alias("phi"))
    rng = np.random.default_rng(4)
    rows = [(event, ant, rng.normal(size=64).tolist()) for event in range(150) for ant in range(16)]
    channels = spark.createDataFrame(rows, "event long, ant int, y array<double>").coalesce(1)
    phi, theta = [k * 2.5 - 11.25 for k in range(imaging.COARSE_PHI_BINS)], imaging.coarse_theta_edges()[:-1]
    made = imaging.event_peaks(channels, geometry, ["event"], 0.5, phi, theta, 3)
    # One task's step from waveforms to peaks: no map is sent from one Python step to another.
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Python" not in plan.replace("MapInArrow", "")
    maps = {r["event"]: np.array(r["map"], float) for r in imaging.event_maps(channels, geometry, ["event"], 0.5).collect()}
    found = {r["event"]: r["peaks"] for r in made.collect()}
    assert sorted(found) == sorted(maps) == list(range(150))
    for event, peaks in found.items():
        first = np.unravel_index(np.nanargmax(maps[event]), (len(phi), len(theta)))
        if 0 < first[1] < len(theta) - 1:
            assert (peaks[0]["phi"], peaks[0]["theta"], peaks[0]["value"]) == (phi[first[0]], theta[first[1]], maps[event].max())
