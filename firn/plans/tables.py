"""Joins, set operations, look-ups and quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from firn.operators import joins, quality
from firn.plans.registry import query, table
from firn.sources.readers import extent, input_bytes, rebuilt_event_number

KEY = ["run", "eventNumber"]


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        (130 + F.col("o_custkey") % 310).alias("run"), F.col("o_orderkey").alias("eventNumber"), "o_totalprice", "o_orderstatus"
    )


_O = "(SELECT 130 + o_custkey % 310 AS run, o_orderkey AS \"eventNumber\", o_totalprice, o_orderstatus FROM orders)"


@query(
    "friend_join",
    f'SELECT o.run, o."eventNumber", o.o_totalprice, f.lines, f.top FROM {_O} o LEFT JOIN'
    ' (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS lines, max(l_extendedprice) AS top FROM lineitem GROUP BY 1) f ON f.l_orderkey = o."eventNumber"',
)
def _friend_join(spark, folder):
    """Per-order side table joined by id; orders without lines stay."""
    friend = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("eventNumber2")).agg(
        F.count("*").alias("lines"), F.max("l_extendedprice").alias("top")
    )
    joined = joins.friend_join(_orders(spark, folder), friend, ["eventNumber2"], ["eventNumber"])
    return joined.select("run", "eventNumber", "o_totalprice", "lines", "top")


@query(
    "overlay_join",
    f'SELECT o.run, o."eventNumber", coalesce(f.s, o.o_orderstatus) AS status FROM {_O} o LEFT JOIN'
    " (SELECT l_orderkey, max(l_returnflag) AS s FROM lineitem WHERE l_discount >= 0.1 GROUP BY 1) f ON f.l_orderkey = o.\"eventNumber\"",
)
def _overlay_join(spark, folder):
    """Status replaced where the overlay table has the event."""
    fresh = table(spark, folder, "lineitem").filter(F.col("l_discount") >= 0.1).groupBy(F.col("l_orderkey").alias("eventNumber")).agg(
        F.max("l_returnflag").alias("status")
    )
    base = _orders(spark, folder).select("run", "eventNumber", F.col("o_orderstatus").alias("status"))
    return joins.overlay(base, fresh, ["eventNumber"], ["status"])


@query("semi_join", 'SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)')
def _semi_join(spark, folder):
    ids = table(spark, folder, "lineitem").filter(F.col("l_quantity") > 49).select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.only_ids(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ids, ["o_orderkey"])


@query("anti_join", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _anti_join(spark, folder):
    ids = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.without_ids(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ids, ["o_orderkey"])


@query(
    "union_all",
    "SELECT source, run, CAST(count(*) AS BIGINT) AS n, round(sum(v), 2) AS v FROM (SELECT 'c' AS source, c_nationkey AS run, c_acctbal AS v FROM customer"
    " UNION ALL SELECT 's', s_nationkey, s_acctbal FROM supplier) GROUP BY 1, 2",
)
def _union_all(spark, folder):
    c = table(spark, folder, "customer").select(F.lit("c").alias("source"), F.col("c_nationkey").alias("run"), F.col("c_acctbal").alias("v"))
    s = table(spark, folder, "supplier").select(F.lit("s").alias("source"), F.col("s_nationkey").alias("run"), F.col("s_acctbal").alias("v"))
    return joins.merge_runs(c, s).groupBy("source", "run").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("v"))


@query("id_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (7, 77, 777)")
def _id_lookup(spark, folder):
    """Rows by event number: a pushed-down filter served by row-group statistics."""
    return table(spark, folder, "orders").filter(F.col("o_orderkey").isin(7, 77, 777)).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "summary_extent",
    'SELECT CAST(count(*) AS BIGINT) AS rows, min(event_id) AS "first_eventNumber", max(event_id) AS "last_eventNumber",'
    ' arg_min(CAST(floor(epoch(ts)) AS BIGINT), event_id) AS "first_realTime", arg_max(CAST(floor(epoch(ts)) AS BIGINT), event_id) AS "last_realTime" FROM events',
)
def _summary_extent(spark, folder):
    df = table(spark, folder, "events").select(F.col("event_id").alias("eventNumber"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("realTime"))
    return extent(df)


@query("input_bytes")
def _input_bytes(spark, folder):
    """Files, bytes and bytes per row of the line table."""
    return input_bytes(table(spark, folder, "lineitem"))


@query(
    "rebuilt_ids",
    "SELECT o_orderkey, CAST(floor(CAST(o_orderkey * 37 AS DOUBLE) / 10000) AS BIGINT) * 10000 + (o_orderkey * 37) % 10000 AS event FROM orders",
)
def _rebuilt_ids(spark, folder):
    full = F.col("o_orderkey") * 37
    return table(spark, folder, "orders").select("o_orderkey", rebuilt_event_number(full, full % 10000).alias("event"))


@query(
    "channel_quality",
    "WITH c AS (SELECT l_orderkey, l_partkey % 16 AS sector, l_extendedprice / 25 AS v FROM lineitem),"
    " g AS (SELECT l_orderkey, CAST(count(*) FILTER (WHERE v > 400) AS BIGINT) AS above_blast, CAST(count(*) FILTER (WHERE v > 1500) AS BIGINT) AS above_saturation,"
    " CAST(count(DISTINCT sector) FILTER (WHERE v > 400) AS BIGINT) AS sectors_above FROM c GROUP BY 1)"
    " SELECT *, CASE WHEN above_blast >= 6 OR sectors_above >= 5 THEN 1 WHEN above_saturation >= 2 THEN 2 ELSE 0 END AS quality FROM g",
)
def _channel_quality(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_partkey") % 16).alias("sector"), (F.col("l_extendedprice") / 25).alias("v"))
    return quality.channel_quality(df, "l_orderkey", F.col("sector"), F.col("v"), counts=(6, 5, 2))


@query(
    "saturation",
    "SELECT l_orderkey, max(l_extendedprice / 20) AS max_volts, min(-l_quantity * 45) AS min_volts, round(max(abs(l_extendedprice / 20 - l_quantity * 45)), 6) AS asym_volts,"
    " max(l_extendedprice / 20) <= 2000 AND min(-l_quantity * 45) >= -2000 AND max(abs(l_extendedprice / 20 - l_quantity * 45)) <= 500 AS passes FROM lineitem GROUP BY 1",
)
def _saturation(spark, folder):
    high, low = F.col("l_extendedprice") / 20, -F.col("l_quantity") * 45
    out = quality.saturation(table(spark, folder, "lineitem"), "l_orderkey", high, low)
    return out.withColumn("asym_volts", F.round("asym_volts", 6))


_CH = (
    "(SELECT l_orderkey, l_linenumber % 2 AS pol, l_partkey % 3 AS ring, CAST(l_suppkey % 4 AS INT) AS sector, l_extendedprice AS p2p FROM lineitem)"
)


def _channels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") % 2).alias("pol"), (F.col("l_partkey") % 3).alias("ring"),
        (F.col("l_suppkey") % 4).cast("int").alias("sector"), F.col("l_extendedprice").alias("p2p"),
    )


@query(
    "ratio_to_ref",
    f"WITH s AS (SELECT l_orderkey, pol, sector, max(CASE WHEN ring = 0 THEN p2p END) AS top, max(CASE WHEN ring > 0 THEN p2p END) AS low, max(CASE WHEN ring = 2 THEN p2p END) AS bottom FROM {_CH} GROUP BY 1, 2, 3),"
    " b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, pol ORDER BY low DESC, sector) AS rn, CAST(count(*) FILTER (WHERE bottom > top) OVER (PARTITION BY l_orderkey, pol) AS BIGINT) AS sectors_exceeding FROM s WHERE low IS NOT NULL)"
    " SELECT l_orderkey, pol, round(CASE WHEN top > 0 THEN low / top ELSE -1 END, 9) AS ratio, sector, low AS max_p2p, sectors_exceeding, CASE WHEN top > 0 THEN low / top ELSE -1 END > 2.8 AS blast FROM b WHERE rn = 1",
)
def _ratio_to_ref(spark, folder):
    """Loudest lower channel against the top channel of its sector, per event and polarisation."""
    out = quality.bottom_to_top(_channels(spark, folder), "l_orderkey")
    return out.withColumn("ratio", F.round("ratio", 9))


@query(
    "blast_events",
    f"WITH s AS (SELECT l_orderkey, pol, sector, max(CASE WHEN ring = 0 THEN p2p END) AS top, max(CASE WHEN ring > 0 THEN p2p END) AS low FROM {_CH} GROUP BY 1, 2, 3),"
    " b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, pol ORDER BY low DESC, sector) AS rn FROM s WHERE low IS NOT NULL)"
    " SELECT l_orderkey, bool_or(CASE WHEN top > 0 THEN low / top ELSE -1 END > 2.8) AS is_blast, round(max(CASE WHEN top > 0 THEN low / top ELSE -1 END), 9) AS max_ratio FROM b WHERE rn = 1 GROUP BY 1",
)
def _blast_events(spark, folder):
    out = quality.blast_events(quality.bottom_to_top(_channels(spark, folder), "l_orderkey"), "l_orderkey")
    return out.withColumn("max_ratio", F.round("max_ratio", 9))


@query(
    "salted_join",
    "SELECT n_name AS nation, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1",
)
def _salted_join(spark, folder):
    """Equi-join with keys over 50 rows split over several tasks."""
    big = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), "c_acctbal")
    small = table(spark, folder, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nation"))
    joined = joins.salted_join(big, small, ["k"], hot_rows=50)
    return joined.groupBy("nation").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
