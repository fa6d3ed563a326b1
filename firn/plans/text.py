"""Queries for names, bits, angles and delays."""

from __future__ import annotations

from pyspark.sql import functions as F

from firn.functions import angles, names
from firn.operators.imaging import sector_gap
from firn.plans.registry import query, table


def _sql_replace(expr: str) -> str:
    for old, new in names.REPLACEMENTS:
        expr = f"replace({expr}, '{old}', '{new}')"
    return f"trim({expr}, '_')"


_TEXTS = (
    "CASE p_partkey % 4 WHEN 0 THEN 'sum.' || replace(p_brand, '#', '[') || '].' || lower(p_type) || '() >= ' || p_size"
    " WHEN 1 THEN 'TMath::Abs(' || lower(p_type) || '[][].phi - ' || p_size || ')/5'"
    " WHEN 2 THEN CASE p_size % 3 WHEN 0 THEN 'floor(Iteration$/5)' WHEN 1 THEN '(Iteration$ % 5)' ELSE '((mc.weight > 0)*mc.weight + 1*(mc.weight==0))' END"
    " ELSE 'FFTtools::wrap(' || replace(p_name, ' ', '_') || ' - wais_phi, ' || p_size || ', 0)' END"
)
_ALIAS_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.ALIASES.items())


@query(
    "branchify",
    f"WITH t AS (SELECT p_partkey, {_TEXTS} AS text FROM part), m AS (SELECT p_partkey, text, {_sql_replace('text')} AS plain FROM t)"
    f" SELECT p_partkey, text, CASE plain {_ALIAS_SQL} ELSE plain END AS name FROM m",
)
def _branchify(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", F.expr(_TEXTS).alias("text"))
    return df.withColumn("name", names.branchify_column(F.col("text")))


@query(
    "ant_name",
    "SELECT p_partkey, CAST(p_partkey % 48 % 16 + 1 AS VARCHAR) || substr('TMB', CAST(p_partkey % 48 // 16 AS INT) + 1, 1)"
    " || CASE WHEN p_size % 2 = 0 THEN 'H' ELSE 'V' END AS name, 1 - p_size % 2 AS other FROM part",
)
def _ant_name(spark, folder):
    pol = F.col("p_size") % 2
    return table(spark, folder, "part").select(
        "p_partkey", names.antenna_name(F.col("p_partkey") % 48, pol).alias("name"), names.swap_polarisation(pol).alias("other")
    )


@query(
    "bits",
    "SELECT p_partkey, CAST(bit_count(CAST(p_partkey & 1023 AS BIGINT)) AS INT) AS low_bits, CAST((p_partkey >> 3) & 1 AS INT) AS third,"
    " (p_partkey & 10) <> 0 AS unbiased FROM part",
)
def _bits(spark, folder):
    mask = F.col("p_partkey")
    return table(spark, folder, "part").select(
        "p_partkey", names.bits_set(mask, 10).alias("low_bits"), names.bit_at(mask, 3).cast("int").alias("third"),
        names.min_bias(mask).alias("unbiased"),
    )


@query(
    "wrap_angle",
    "WITH d AS (SELECT c_custkey, c_acctbal / 4 AS d FROM customer UNION ALL SELECT -1 - c_custkey, CAST(180 * (c_custkey % 20 - 10) AS DOUBLE) FROM customer)"
    " SELECT c_custkey, round(CASE WHEN d >= 1620 OR d < -1620 THEN NULL WHEN d = 180 THEN 180.0 ELSE d - 360 * floor((d + 180) / 360) END, 6) AS folded,"
    " round(d - 360 * floor(d / 360), 6) AS positive FROM d",
)
def _wrap_angle(spark, folder):
    customer = table(spark, folder, "customer")
    d = customer.select("c_custkey", (F.col("c_acctbal") / 4).alias("d")).union(
        customer.select(-1 - F.col("c_custkey"), (180 * (F.col("c_custkey") % 20 - 10)).cast("double"))
    )
    return d.select(
        "c_custkey", F.round(angles.delta_angle(F.col("d")), 6).alias("folded"), F.round(angles.wrap_into(F.col("d"), 360.0), 6).alias("positive")
    )


_HORNER = " + ".join(f"{c:.5e} * pow(off, {p})" for p, c in angles.OFF_AXIS_POWERS.items())


@query(
    "plane_delay",
    "WITH g AS (SELECT c_custkey, 0.5 + c_nationkey * 0.1 AS r, c_nationkey * 0.2 - 2.0 AS z, c_nationkey * 14.4 AS ant,"
    " c_custkey % 360 AS phi, c_acctbal / 200 AS theta FROM customer), o AS (SELECT *, (ant - phi) - 360 * floor(((ant - phi) + 180) / 360) AS off FROM g)"
    " SELECT c_custkey, round(cos(radians(theta)) * (-z * tan(radians(theta)) - r * cos(radians(phi - ant))) * 1e9 / 299792458.0, 6) + 0.0 AS delay,"
    f" round({_HORNER}, 9) AS off_axis FROM o",
)
def _plane_delay(spark, folder):
    g = table(spark, folder, "customer").select(
        "c_custkey", (0.5 + F.col("c_nationkey") * 0.1).alias("r"), (F.col("c_nationkey") * 0.2 - 2.0).alias("z"),
        (F.col("c_nationkey") * 14.4).alias("ant"), (F.col("c_custkey") % 360).alias("phi"), (F.col("c_acctbal") / 200).alias("theta"),
    )
    off = angles.delta_angle(F.col("ant") - F.col("phi"))
    return g.select(
        "c_custkey",
        F.round(angles.plane_delay(F.col("z"), F.col("r"), F.col("ant"), F.col("phi"), F.col("theta")), 6).alias("delay"),
        F.round(angles.off_axis_delay(off), 9).alias("off_axis"),
    )


@query(
    "trigger_angle",
    "WITH d AS (SELECT p_partkey, k, (p_retailprice % 360 - k * 22.5) AS d FROM part, range(0, 16) AS r(k) WHERE (p_partkey * 37 >> k) & 1 = 1),"
    " f AS (SELECT p_partkey, d - 360 * floor((d + 180) / 360) AS a FROM d), n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(a), a) AS rn FROM f)"
    " SELECT p.p_partkey, round(n.a + 0.0, 6) AS nearest FROM part p LEFT JOIN n ON n.p_partkey = p.p_partkey AND rn = 1",
)
def _trigger_angle(spark, folder):
    peak, pattern = F.col("p_retailprice") % 360, F.col("p_partkey") * 37
    return table(spark, folder, "part").select("p_partkey", F.round(angles.nearest_set_sector(peak, pattern), 6).alias("nearest"))


@query(
    "circular_pairs",
    "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(least(abs(a.n_nationkey - b.n_nationkey), 25 - abs(a.n_nationkey - b.n_nationkey)) AS INT) AS gap"
    " FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND least(abs(a.n_nationkey - b.n_nationkey), 25 - abs(a.n_nationkey - b.n_nationkey)) <= 2",
)
def _circular_pairs(spark, folder):
    """Sectors at most two apart on a ring of 25: each lists its partners, then an equi-join."""
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("a"))
    listed = nation.withColumn("b", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda k: F.pmod(F.col("a") + k, F.lit(25)))))
    met = listed.join(nation.select(F.col("a").alias("b")), "b").filter(F.col("a") < F.col("b"))
    return met.select("a", "b", sector_gap(F.col("a"), F.col("b"), 25).cast("int").alias("gap"))


@query(
    "token_split",
    "SELECT p_partkey, CAST(len(string_split_regex(p_name || '_' || p_brand, '[ _#]')) AS INT) AS parts, string_split_regex(p_name || '_' || p_brand, '[ _#]')[1] AS first FROM part",
)
def _token_split(spark, folder):
    parts = F.split(F.concat("p_name", F.lit("_"), "p_brand"), "[ _#]")
    return table(spark, folder, "part").select("p_partkey", F.size(parts).alias("parts"), parts[0].alias("first"))
