"""Cluster invariants and summaries."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from firn.functions.compare import rounded
from firn.operators import clustering as cl
from firn.operators import histogram as h
from firn.operators import joins
from firn.operators import learn
from firn.operators.joins import friend_join, near_moving_path, overlay_fields
from firn.plans.programs import cluster_events, extend_clusters


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(11)
    xy = np.concatenate([rng.normal(0, 1, (60, 2)), rng.uniform(-60, 60, (60, 2))])
    pdf = pd.DataFrame({"id": np.arange(120), "x": xy[:, 0], "y": xy[:, 1], "sigma": rng.choice([0.5, 1.0, 2.0], 120)})
    return spark.createDataFrame(pdf), pdf


def test_clusters_grow_with_threshold(points):
    df, _ = points
    labels = cl.threshold_clusters(df, F.col("sigma"), [1, 9, 100], 1.0).toPandas().pivot(index="id", columns="z", values="label")
    assert (labels.le(labels.index, axis=0)).all().all()
    for tight, loose in ((0, 1), (1, 2)):
        assert labels.groupby(tight)[loose].nunique().max() == 1
        assert labels[loose].nunique() <= labels[tight].nunique()


def test_known_sites_merge_through_shared_events(spark):
    events = spark.createDataFrame([(0, 1, 0.0, 0.0, 6.0), (0, 2, 10.0, 0.0, 6.0), (0, 3, 100.0, 0.0, 6.0)], "z int, id bigint, x double, y double, rho double")
    sites = spark.createDataFrame([(5, 5.0, 0.0), (7, 14.0, 0.0), (9, 103.0, 0.0)], "id bigint, x double, y double")
    matches = cl.site_matches(events, sites, hot_rows=1)
    assert {(r["id"], r["site"]) for r in matches.collect()} == {(1, 5), (2, 5), (2, 7), (3, 9)}
    got = {r["id"]: (r["site"], r["nearest_site"]) for r in cl.assign_sites(matches).collect()}
    assert got == {1: (5, 5), 2: (5, 7), 3: (9, 9)}


def test_site_search_is_dealt_out_over_tasks(spark):
    events = spark.range(0, 4000, 1, 1).selectExpr("0 AS z", "id", "CAST(id % 7 AS DOUBLE) AS x", "0.0D AS y", "2.0D AS rho")
    sites = spark.range(1, 2).selectExpr("id", "3.0D AS x", "0.0D AS y")
    met = cl.site_matches(events, sites)
    assert met.select(F.spark_partition_id().alias("p")).distinct().count() == 8
    assert met.count() == events.filter("abs(x - 3) <= 2").count()


def test_rounded_equals_round(spark):
    rng = np.random.default_rng(2)
    values = [*rng.uniform(-50, 50, 3000), *(rng.integers(-(10**8), 10**8, 3000) / 1e6 + 5e-7), 0.0, -0.0, -1e-9, 1e300, 123456789.1234565]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "v double")
    both = df.select(rounded(F.col("v"), 6).alias("a"), F.round("v", 6).alias("b"))
    assert both.filter("not (a <=> b)").count() == 0


def test_program_outputs_agree(points, spark):
    df, pdf = points
    sites = spark.createDataFrame([(0, 0.0, 0.0), (1, 500.0, 500.0)], "id bigint, x double, y double")
    out = cluster_events(df, sites, [1, 9], 1.0, simulated=df.filter("id < 5"), horizon=10.0)
    counts = out["clusters"].groupBy("z").agg(F.sum("n").alias("n")).collect()
    assert {r["n"] for r in counts} == {len(pdf)}
    known = out["clusters"].filter("known").toPandas()
    assert (known["cluster"] == -1).all() and len(known) == 2
    assert out["simulated"].filter("cluster IS NULL").count() == 0
    whole = extend_clusters(df.filter("id < 60"), df.filter("id >= 60"), thresholds=[1, 9], surface=1.0)["events"]
    alone = cluster_events(df, None, [1, 9], 1.0)["events"]
    assert whole.exceptAll(alone).count() == 0


def test_background_estimate(spark):
    rows = [(0, True, 1)] * 4 + [(0, True, 2)] * 3 + [(0, False, 2)] * 2 + [(0, False, 5)] + [(0, True, 150)]
    sizes = spark.createDataFrame([(z, i, k, n) for i, (z, k, n) in enumerate(rows)], "z int, cluster bigint, known boolean, n bigint")
    got = {r["max_small"]: r for r in cl.background_estimate(cl.multiplicity(sizes), [2, 5]).collect()}
    assert (got[2]["tau"], got[2]["background"]) == (3.0, 4 / 3)
    assert got[5]["tau"] == 2.0


def test_histogram_keeps_every_weight(spark):
    df = spark.createDataFrame([(float(x), 0.5) for x in range(-5, 30)] + [(float("nan"), 0.5)], "x double, w double")
    got = h.hist1d(df, F.col("x"), h.Axis(4, 0.0, 20.0), F.col("w")).toPandas().set_index("bin")
    assert got["content"].sum() == 18.0
    assert got.loc[0, "entries"] == 5 and got.loc[5, "entries"] == 11


def test_fisher_direction(spark):
    rng = np.random.default_rng(4)
    s = rng.multivariate_normal([1.0, 2.0], [[1.0, 0.3], [0.3, 2.0]], 4000)
    b = rng.multivariate_normal([0.0, 0.0], [[1.0, 0.3], [0.3, 2.0]], 4000)
    made = [spark.createDataFrame(pd.DataFrame({"a": v[:, 0], "b": v[:, 1]})) for v in (s, b)]
    d = learn.train(*made, {"a": F.col("a"), "b": F.col("b")})
    within = (np.cov(s.T, bias=True) + np.cov(b.T, bias=True)) / 2
    want = np.linalg.solve(within, s.mean(0) - b.mean(0)) / 2
    np.testing.assert_allclose([w for w, _ in d.terms], want, rtol=1e-8)
    means = [m.select(F.avg(d.score())).first()[0] for m in made]
    assert means[0] == pytest.approx(-means[1])


def test_overlap_minimisation_improves(spark):
    rng = np.random.default_rng(6)
    s = spark.createDataFrame(pd.DataFrame({"a": rng.normal(2, 1, 500), "b": rng.normal(2, 1, 500), "weight": 1.0}))
    b = spark.createDataFrame(pd.DataFrame({"a": rng.normal(0, 1, 500), "b": rng.normal(0, 1, 500), "weight": 1.0}))
    start = learn._overlaps(s, b, ["a", "b"], [[1.0, 0.0]])[0]
    _, merit = learn.minimise_overlap(s, b, ["a", "b"], [1.0, 0.0], rounds=2)
    assert merit < start


def test_friend_mismatch_raises(spark):
    events = spark.createDataFrame([(1, 10), (1, 11)], "run int, eventNumber bigint")
    friend = spark.createDataFrame([(1, 10, 5.0), (1, 12, 6.0)], "run2 int, eventNumber2 bigint, v double")
    with pytest.raises(ValueError):
        friend_join(events, friend, ["run2", "eventNumber2"], verify=True)
    assert friend_join(events, friend, ["run2", "eventNumber2"]).count() == events.count()


def test_overlay_replaces_only_named_fields(spark):
    df = spark.createDataFrame([(1, (1, 2)), (2, (3, 4))], "eventNumber bigint, flags struct<a:int,b:int>")
    new = spark.createDataFrame([(2, 9)], "eventNumber bigint, a int")
    got = {r["eventNumber"]: tuple(r["flags"]) for r in overlay_fields(df, new, ["eventNumber"], "flags", ["a"]).collect()}
    assert got == {1: (1, 2), 2: (9, 4)}


def test_moving_path(spark):
    events = spark.createDataFrame([(1, 5.0, 50.0, 0.0), (2, 25.0, 0.0, 0.0)], "id bigint, t double, x double, y double")
    path = spark.createDataFrame([("p", 0.0, 10.0, 0.0, 100.0, 0.0, 0.0)], "path string, t0 double, t1 double, x0 double, x1 double, y0 double, y1 double")
    assert [(r["id"], r["distance"]) for r in near_moving_path(events, path, 1.0, 3.0, hot_rows=1).collect()] == [(1, 0.0)]


def test_moving_path_meets_only_bands_it_passes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    t, x = rng.uniform(0, 100, 300), np.concatenate([rng.uniform(0, 200, 298), [np.nan, np.inf]])
    events = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "t": t, "x": x, "y": np.zeros(300)}))
    # Slow paths and one that passes far more bands in a bucket than are listed.
    moves = [(i, t0, t0 + 30.0, v, v + 3.0) for i, (t0, v) in enumerate(zip(rng.uniform(0, 70, 40).tolist(), rng.uniform(0, 200, 40).tolist()))] + [(40, 0.0, 100.0, -1e7, 1e7)]
    paths = spark.createDataFrame([(p, a, b, u, 0.0, v, 0.0) for p, a, b, u, v in moves], "path long, t0 double, t1 double, x0 double, y0 double, x1 double, y1 double")
    want = {(i, p) for i in range(300) for p, a, b, u, v in moves if a <= t[i] < b and abs(x[i] - (u + (t[i] - a) / (b - a) * (v - u))) <= 0.5}
    met = []
    join = joins.salted_join
    monkeypatch.setattr(joins, "salted_join", lambda *a, **k: met.append(join(*a, **k)) or met[-1])
    assert {(r["id"], r["path"]) for r in near_moving_path(events, paths, 0.5, 10.0).collect()} == want and len(want) > 5
    assert sum(m.filter("path < 40").count() for m in met) < 600


def test_seed_is_nearest_the_mean_of_the_fullest_cell(points):
    df, pdf = points
    cell = np.floor(pdf[["x", "y"]] / 10).apply(tuple, axis=1)
    counts = cell.value_counts()
    best = sorted(c for c in counts.index if counts[c] == counts.max())[0]
    inside = pdf[cell == best]
    d = np.hypot(inside["x"] - inside["x"].mean(), inside["y"] - inside["y"].mean())
    got = cl.seed(df, 10.0).first()
    assert (got["seed"], got["in_cell"]) == (inside.loc[d.idxmin(), "id"], len(inside))
