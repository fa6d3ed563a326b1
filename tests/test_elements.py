"""Element cuts on small nested fixtures."""

import pytest

from pyspark.sql import functions as F

from firn.functions.scores import event_weight
from firn.operators.cutflow import cut_flow
from firn.operators.cuts import Catalogue, nested_cuts
from firn.operators.elements import any_pass, best_element, first_survivor, kth_best, linear_elements
from firn.functions.compare import gt, lt

SCHEMA = "id int, peak array<array<struct<value:double,theta:double>>>"


@pytest.fixture(scope="module")
def rows(spark):
    def grid(*values):
        flat = [(float(v), float(t)) for v, t in values]
        return [flat[:5], flat[5:]]

    a = [(0.1 * i, -1.0) for i in range(10)]
    split = list(a)
    split[0], split[3] = (9.0, 1.0), (0.0, -5.0)
    tie = [(1.0, -1.0)] * 10
    tie[2] = tie[7] = (5.0, -1.0)
    bad = [(float("nan"), -1.0)] * 10
    return spark.createDataFrame([(1, grid(*split)), (2, grid(*tie)), (3, grid(*bad))], SCHEMA)


def test_cuts_met_by_different_elements_do_not_pass(rows):
    e = linear_elements(["peak"], 5)
    high, deep = (lambda x: gt(x["peak"]["value"], 8.0)), (lambda x: lt(x["peak"]["theta"], -4.0))
    got = rows.filter(any_pass(e, [high])).select("id").collect()
    assert [r["id"] for r in got] == [1]
    assert rows.filter(any_pass(e, [deep])).count() == 1
    assert rows.filter(any_pass(e, [high, deep])).count() == 0


def test_ties_project_the_first(rows):
    e = linear_elements(["peak"], 5)
    highest = nested_cuts(e)["highestPeak"]
    got = {r["id"]: r for r in rows.select("id", first_survivor(e, [highest]).alias("f"), best_element(e, lambda x: x["peak"]["value"]).alias("b"), kth_best(e, lambda x: x["peak"]["value"], 1).alias("k")).collect()}
    assert (got[2]["f"]["i"], got[2]["b"]["i"], got[2]["k"]["i"]) == (2, 2, 7)
    assert (got[2]["f"]["pol"], got[2]["f"]["ind"]) == (0, 2)


def test_nan_never_passes_a_comparison_or_its_reverse(rows):
    e = linear_elements(["peak"], 5)
    bad = rows.filter("id = 3")
    assert bad.filter(any_pass(e, [lambda x: gt(x["peak"]["value"], 0.0)])).count() == 0
    assert bad.filter(any_pass(e, [lambda x: lt(x["peak"]["value"], 0.0)])).count() == 0


def test_weights(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (-1.0,)], "w double")
    assert [r[0] for r in df.select(event_weight(F.col("w"))).collect()] == [1.0, 0.3, 0.0]


def test_cut_algebra(spark):
    c = Catalogue()
    c.row("a", lambda: F.col("id") > 3)
    c.row("b", lambda: F.col("id") < 7)
    df = spark.range(10)
    assert df.filter((c["a"] & c["b"]).column).count() == 3
    assert df.filter((~c["a"]).column).count() == 4
    assert df.filter((c["a"] | c["b"]).column).count() == 10
    c.row("a", lambda: F.col("id") > 8)
    assert df.filter(c["a"].column).count() == 1
    assert (c["a"] & ~c["b"]).name == "a && !(b)"


def test_cut_flow_sequence_never_rises(spark):
    cuts = [(str(k), F.col("id") % (k + 2) != 0) for k in range(5)]
    table = cut_flow(spark.range(1000), cuts, preselect=False).orderBy("cut_index").collect()
    seq = [r["in_sequence"] for r in table]
    assert seq == sorted(seq, reverse=True)
    assert all(r["in_sequence"] <= r["if_only"] for r in table)
    assert table[-1]["in_sequence"] <= min(r["if_not"] for r in table)


def test_cuts_reach_the_parquet_reader(spark, tmp_path):
    from firn.functions.compare import gt, half_open, where
    from firn.operators.elements import skim

    rows = [(1, 5.0, 1419320000), (0, float("nan"), 1), (2, None, 1419320001)]
    spark.createDataFrame(rows, "isRF int, x double, realTime long").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))

    def pushed(found):
        plan = found._jdf.queryExecution().executedPlan().toString()
        return plan[plan.index("PushedFilters") :]

    quiet = half_open(F.col("realTime"), 1419320000, 1420250000)
    assert "GreaterThan(isRF,0)" in pushed(where(df, gt(F.col("isRF"), 0)))
    assert "GreaterThanOrEqual(realTime,1419320000)" in pushed(where(df, quiet)) and "LessThan(realTime,1420250000)" in pushed(where(df, quiet))
    assert "GreaterThan(isRF,0)" in pushed(skim(df, F.array(), [gt(F.col("isRF"), 0), quiet], []))
    assert where(df, gt(F.col("x"), 0)).count() == 1 and df.filter(~gt(F.col("x"), 0)).count() == 2


def test_map_rows_leaves_unseen_bins_null(spark):
    from firn.operators.imaging import map_rows

    cells = spark.createDataFrame([(1, 0, 1, 5.0), (1, 2, 0, 7.0), (2, 0, 0, 1.0), (2, 2, 1, 2.0)], "event int, phi_bin int, theta_bin int, value double")
    got = {r["event"]: r["map"] for r in map_rows(cells, ["event"], 3, 2).collect()}
    assert got == {1: [None, 5.0, None, None, 7.0, None], 2: [1.0, None, None, None, None, 2.0]}


def test_normalise_keeps_rows_of_a_null_key(spark):
    from firn.operators.series import normalise

    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, y double")
    assert sorted(r["normalised"] for r in normalise(df, ["k"], "y").collect()) == [-1.0, 0.0, 1.0]
