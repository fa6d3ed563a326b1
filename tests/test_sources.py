"""Sources, sinks and streaming on temporary folders."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from firn.operators.monitor import rolling_fit
from firn.plans import programs
from firn.plans.nested import summaries_from_vectors
from firn.plans.registry import table
from firn.sources import readers, schema, sinks
from firn.streaming.monitor import history, monitor, noise_stream

FOLDER = "/root/testdata/sf0.001"


def test_skim_write_read_merge(spark, tmp_path):
    made = summaries_from_vectors(table(spark, FOLDER, "embeddings"))
    kept = programs.reduce(made, "calibration", str(tmp_path / "skim"))
    back = spark.read.parquet(str(tmp_path / "skim"))
    assert back.count() == kept.count() > 0
    assert readers.run_range(back, 131, 131).count() == back.filter("run = 131").count()
    flat = programs.thermal_table(made, path=str(tmp_path / "thermal"))
    assert flat.count() == made.count()
    side = {"duringHiCal": F.lit(0), "hiCalPhi": F.lit(0.0)}
    sinks.write(programs.side_table(flat, side, "run2", "eventNumber2"), str(tmp_path / "hiCal"))
    sinks.write(programs.side_table(flat, {"depth": F.lit(1.0)}, "run3", "eventNumber3"), str(tmp_path / "surface"))
    joined = readers.thermal(spark, str(tmp_path / "thermal"))
    assert joined.count() == made.count() and {"duringHiCal", "depth"} <= set(joined.columns)
    sinks.merge_indexed(str(tmp_path / "merged"), flat.filter("run < 134"), flat.filter("run >= 134"))
    assert spark.read.parquet(str(tmp_path / "merged")).count() == flat.count()
    ids = flat.select("run", "eventNumber").limit(7)
    sinks.sub_run(str(tmp_path / "sub"), ids, {"thermal": flat, "summary": made})
    assert spark.read.parquet(str(tmp_path / "sub/thermal")).count() == 7
    sinks.flag_table(str(tmp_path / "flags"), made)
    sinks.overwrite_flags(str(tmp_path / "fresh"), made, spark.read.parquet(str(tmp_path / "flags")))
    assert spark.read.parquet(str(tmp_path / "fresh")).count() == made.count()
    sinks.provenance(spark, str(tmp_path / "merged"), {"a": 1}, "test")
    assert '"a": 1' in spark.read.text(str(tmp_path / "merged.provenance")).first()[0]


def test_clustering_sink(spark, tmp_path):
    events = spark.createDataFrame([(1, 0)], "id bigint, z int")
    clusters = spark.createDataFrame([(0, 1, 5), (1, 1, 6)], "z int, cluster bigint, n bigint")
    sinks.clustering(str(tmp_path / "c"), events, clusters, events)
    e, c = readers.clustered(spark, str(tmp_path / "c"))
    assert e.count() == 1 and c.filter("z = 1").first()["n"] == 6


def test_names_and_newest(spark, tmp_path):
    early = sinks.output_name("bin/make", ["a", 3], str(tmp_path), datetime(2020, 1, 2, 3, 4, 5))
    late = sinks.output_name("bin/make", ["a", 3], str(tmp_path), datetime(2021, 1, 2, 3, 4, 5))
    assert early.endswith("make_a_3_2020-01-02_03-04-05")
    for p in (late, early):
        spark.range(1).write.parquet(p)
    assert readers.newest(spark, f"{tmp_path}/make_*").endswith("2021-01-02_03-04-05")
    assert readers.newest(spark, f"{tmp_path}/none_*") is None


def test_geometry(spark, tmp_path):
    (tmp_path / "g.txt").write_text("0  0.1 0.2 -0.5 1.5\n1 0 0 0.5 2\n")
    nominal = spark.createDataFrame([(0, 1.0, 2.0, 0.1), (1, 1.0, 2.0, 6.1)], "ant int, r double, z double, phi double")
    got = {r["ant"]: r for r in readers.corrected_geometry(nominal, readers.geometry_text(spark, str(tmp_path / "g.txt"))).collect()}
    assert got[0]["phi"] == pytest.approx(0.1 - 0.5 + 2 * np.pi) and got[1]["phi"] == pytest.approx(6.6 - 2 * np.pi)
    assert got[0]["dt"] == 1.5


def test_sites_two_class_and_sentinels(spark, tmp_path):
    (tmp_path / "s.csv").write_text("name,latitude,longitude,altitude\nA,-80,10,-999\nB,-81,11,200\n")
    assert [r["altitude"] for r in readers.sites(spark, str(tmp_path / "s.csv")).orderBy("name").collect()] == [None, 200.0]
    spark.range(3).write.parquet(str(tmp_path / "sig"))
    spark.range(2).write.parquet(str(tmp_path / "bak"))
    both = readers.two_class(spark, str(tmp_path / "sig"), str(tmp_path / "bak"))
    assert {r["label"]: r["count"] for r in both.groupBy("label").count().collect()} == {1: 3, 0: 2}
    wrapped = spark.createDataFrame([(-1, 1.0), (5, 0.0)], "eventNumber int, pol float")
    assert [tuple(r) for r in schema.restore_types(wrapped).collect()] == [(4294967295, 1), (5, 0)]


def test_synthetic_noise_is_repeatable_and_normal(spark):
    a = readers.synthetic_waveforms(spark, 20, 3, 100, seed=5)
    b = readers.synthetic_waveforms(spark, 20, 3, 100, seed=5).repartition(3)
    assert a.exceptAll(b).count() == 0
    v = np.concatenate(a.toPandas()["v"].to_numpy())
    assert abs(v.mean()) < 0.05 and abs(v.std() - 1) < 0.05


def test_declared_summary_schema_parses(spark):
    assert len(spark.createDataFrame([], schema.SUMMARY).schema) == 15


def stream_rows(folder, chunks):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"channel": rng.choice(["0_1_5", "1_2_7"], 240), "eventNumber": np.arange(240), "amplitude": rng.rayleigh(2.0, 240)})
    for i, part in enumerate(np.array_split(pdf, chunks)):
        part.to_parquet(f"{folder}/part-{i}.parquet")
    return pdf


def test_streaming_monitor_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    pdf = stream_rows(folder, 4)
    stream = spark.readStream.schema("channel string, eventNumber bigint, amplitude double").option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = monitor(stream, F.col("amplitude") > 0, rows=50).writeStream.format("memory").queryName("mon").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "ck")
    ).start()
    q.processAllAvailable()
    q.stop()
    live = spark.table("mon").toPandas().sort_values(["channel", "eventNumber"])
    batch = rolling_fit(spark.createDataFrame(pdf), ["channel"], ["eventNumber"], "amplitude", rows=50).toPandas().sort_values(["channel", "eventNumber"])
    assert len(live) == 240
    for c in ("scale", "chi_square", "ndf", "mean_power", "window_rows", "log10_prob"):
        np.testing.assert_allclose(live[c].to_numpy(float), batch[c].to_numpy(float))


def test_noise_stream_and_history(spark, tmp_path):
    folder = tmp_path / "n"
    folder.mkdir()
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(60), unit="s")
    pd.DataFrame({"ts": t.astype("datetime64[us]"), "ant": 1, "rms": np.arange(60.0)}).to_parquet(folder / "a.parquet")
    stream = spark.readStream.schema("ts timestamp_ntz, ant bigint, rms double").parquet(str(folder))
    q = noise_stream(stream, "ts", ["ant"], "rms", 10, "0 seconds").writeStream.format("memory").queryName("noise").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [r["noise"] for r in spark.table("noise").orderBy("start").collect()] == [4.5 + 10 * k for k in range(6)]
    rows = spark.range(100).select(F.col("id").alias("eventNumber"))
    assert history(rows, 80, rows=10, margin=5).count() == 15


def test_horizon_grid(spark):
    grid = programs.horizon_grid(spark, (30000.0, 40000.0), (-10.0, 0.0), steps=16)
    assert grid.count() == 256
    assert 0 < grid.filter("distance IS NULL").count() < 256
