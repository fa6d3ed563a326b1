"""Ordered operators on one heavy key with tiny blocks, against pandas."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from firn.operators import joins, monitor, ordered, series

SIZE = 8


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    key = np.where(rng.random(400) < 0.6, "hot", rng.choice(list("abcdef"), 400))
    pdf = pd.DataFrame({"k": key, "t": rng.permutation(400).astype("int64"), "y": rng.uniform(0, 360, 400).round(3)})
    wide = spark.createDataFrame(pdf).repartition(5)
    return wide, pdf.sort_values(["k", "t"]).reset_index(drop=True)


def same(got, want, column):
    merged = got.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    assert np.array_equal(merged[["k", "t"]].to_numpy(), want[["k", "t"]].to_numpy())
    np.testing.assert_allclose(merged[column].to_numpy(float), want[column].to_numpy(float), atol=1e-8)


def test_positions_are_dense_and_ordered(data):
    df, pdf = data
    got = ordered.place(df, ["k", "t"]).toPandas().sort_values("_g")
    assert got["_g"].tolist() == list(range(len(pdf)))
    assert got["t"].tolist() == pdf["t"].tolist()


def test_unwrap(data):
    df, pdf = data
    want = pdf.assign(unwrapped=pdf.groupby("k")["y"].transform(lambda s: np.unwrap(s, period=360.0)))
    same(series.unwrap(df, ["k"], ["t"], "y", 360.0, size=SIZE), want, "unwrapped")


def test_rolling_mean(data):
    df, pdf = data
    want = pdf.assign(rolling_mean=pdf.groupby("k")["y"].transform(lambda s: s.rolling(5, min_periods=1).mean()))
    same(series.rolling_mean(df, ["k"], ["t"], "y", 5, size=SIZE), want, "rolling_mean")


def test_numbering_and_gaps(data):
    df, pdf = data
    same(series.numbered(df, ["k"], ["t"], size=SIZE), pdf.assign(rn=pdf.groupby("k").cumcount() + 1), "rn")
    same(series.gaps(df, ["k"], ["t"], "t", size=SIZE), pdf.assign(step=pdf.groupby("k")["t"].diff()), "step")


def test_nearest_known_both_ways(data):
    df, pdf = data
    known = pdf["y"].where(pdf["t"] % 7 == 0)
    placed = ordered.place(df.withColumn("v", F.when(F.col("t") % 7 == 0, F.col("y"))), ["k", "t"])
    same(ordered.nearest_known(placed, ["k"], "v", "b", size=SIZE), pdf.assign(b=known.groupby(pdf["k"]).ffill()), "b")
    same(ordered.nearest_known(placed, ["k"], "v", "f", forward=True, size=SIZE), pdf.assign(f=known.groupby(pdf["k"]).bfill()), "f")


def test_interpolation_and_range(spark):
    knots = spark.createDataFrame([(0.0, 350.0), (10.0, 20.0), (20.0, 60.0)], "t double, v double")
    probes = spark.createDataFrame([(1, -1.0), (2, 0.0), (3, 5.0), (4, 15.0), (5, 20.0), (6, 21.0)], "id int, t double")
    got = {r["id"]: r["interpolated"] for r in joins.interpolate_at(probes, knots, [], "t", "v", ["id"], wrap=360.0, size=2).collect()}
    assert got[1] is None and got[6] is None
    assert [round(got[i], 9) for i in (2, 3, 4, 5)] == [350.0, 5.0, 40.0, 60.0]


def test_rolling_fit_does_not_depend_on_block_size(data):
    df, pdf = data
    small = monitor.rolling_fit(df, ["k"], ["t"], "y", rows=6, size=SIZE).toPandas()
    large = monitor.rolling_fit(df, ["k"], ["t"], "y", rows=6).toPandas()
    cols = ["scale", "chi_square", "ndf", "mean_power", "window_rows"]
    a, b = (x.sort_values(["k", "t"])[cols].to_numpy(float) for x in (small, large))
    np.testing.assert_allclose(a, b)
    want = pdf.groupby("k")["y"].transform(lambda s: (s**2).rolling(6, min_periods=1).mean()).to_numpy()
    np.testing.assert_allclose(small.sort_values(["k", "t"])["mean_power"].to_numpy(), want)


def test_division_remainder_goes_last(spark):
    got = series.divide(spark.range(23), ["id"], 5).groupBy("division").count().toPandas().set_index("division")["count"]
    assert got.sort_index().tolist() == [4, 4, 4, 4, 7]


@pytest.mark.parametrize("size", [8, 64])
def test_null_keys_and_nan_do_not_depend_on_the_block_size(spark, size):
    rows = [(None, i, 1.0) for i in range(20)] + [("a", i, float("nan") if i == 3 else float("inf") if i == 9 else 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, i int, y double")
    placed = ordered.place(df, ["k", "i"])
    numbered = ordered.number(placed, ["k"], size=size).filter("k is null").agg({"rn": "max"}).head()[0]
    assert numbered == 20
    sums = ordered.rolling_sums(placed, ["k"], 4, {"s": F.col("y")}, size=size).filter("k = 'a'").collect()
    got = {r["i"]: r["s"] for r in sums}
    assert [i for i in sorted(got) if got[i] != got[i]] == [3, 4, 5, 6]
    assert [i for i in sorted(got) if got[i] == float("inf")] == [9, 10, 11, 12]
    assert all(got[i] == 4.0 for i in (7, 8, 13, 19))
