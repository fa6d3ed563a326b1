"""Neighbour, clustering and geodesy queries.

Positions are derived from the tables: customers and suppliers get plane coordinates in
kilometres from their balance and number, order lines get viewing directions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from firn.functions import geodesy, scores
from firn.functions.compare import rounded
from firn.operators import clustering as cl
from firn.operators.ordered import place
from firn.operators.spatial import knn, link_components
from firn.plans.registry import query, table
from firn.session import materialize

_CX = "c_acctbal * 0.1"
_CY = "CAST((c_custkey * 7919) % 10007 AS DOUBLE) * 0.1"
_SX = "s_acctbal * 0.1"
_SY = "CAST((s_suppkey * 7919) % 10007 AS DOUBLE) * 0.1"
_CS = "CAST(1 + c_nationkey % 5 AS DOUBLE) * 0.4"
C_SQL = f"(SELECT c_custkey AS id, {_CX} AS x, {_CY} AS y, {_CS} AS sigma, c_nationkey FROM customer)"
S_SQL = f"(SELECT s_suppkey AS id, {_SX} AS x, {_SY} AS y FROM supplier)"
THRESHOLDS = [1, 4, 10, 40, 100]
SURFACE = 2.0
SITE_REACH = "greatest(2.0, sqrt(t) * sigma)"


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.expr(_CX).alias("x"), F.expr(_CY).alias("y"), F.expr(_CS).alias("sigma"), "c_nationkey"
    )


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(_SX).alias("x"), F.expr(_SY).alias("y"))


def _knn_sql(left: str, right: str, k: int, where: str = "true", limit: str = "true") -> str:
    return (
        "SELECT id, CAST(rn AS INT) AS rank, nb AS neighbour, round(sqrt(d2), 6) AS distance FROM (SELECT a.id, b.id AS nb, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,"
        " row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rn"
        f" FROM {left} a JOIN {right} b ON {where}) WHERE rn <= {k} AND {limit}"
    )


def _near(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


@query("knn", _knn_sql(C_SQL, S_SQL, 4))
def _knn(spark, folder):
    """Four nearest suppliers of every customer."""
    return _near(knn(customers(spark, folder), suppliers(spark, folder), 4))


@query("nn1", _knn_sql(C_SQL, C_SQL, 1, "a.id <> b.id"))
def _nn1(spark, folder):
    """Nearest other customer of every customer."""
    points = customers(spark, folder)
    return _near(knn(points, points, 1, exclude_self=True))


@query("nearest_site", _knn_sql(C_SQL, S_SQL, 1, "true", "d2 <= 75.0 * 75.0"))
def _nearest_site(spark, folder):
    """Nearest known site within the horizon."""
    return _near(knn(customers(spark, folder), suppliers(spark, folder), 1, max_distance=75.0))


@query("range_join", f"SELECT a.id, b.id AS site, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM {C_SQL} a JOIN {S_SQL} b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 30")
def _range_join(spark, folder):
    """Every known site within 30 km of each customer: cells, then the exact distance."""
    points = customers(spark, folder).select(F.lit(0).alias("z"), "id", "x", "y", F.lit(30.0).alias("rho"))
    out = cl.site_matches(points, suppliers(spark, folder))
    return out.select("id", "site", rounded(F.col("distance"), 6).alias("distance"))


def _levels(thresholds: list[int]) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"({i}, {float(t)}::DOUBLE)" for i, t in enumerate(thresholds)) + ") v(z, t))"


_LINKS = (
    f"p AS MATERIALIZED (SELECT id, x, y, z, greatest(2.0, sqrt(t) * sigma) AS rho FROM {C_SQL}, {_levels(THRESHOLDS)}),"
    " e AS MATERIALIZED (SELECT a.z, a.id AS src, b.id AS dst FROM p a JOIN p b ON a.z = b.z AND a.id <> b.id AND abs(a.x - b.x) <= 40"
    " AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= greatest(a.rho, b.rho) * greatest(a.rho, b.rho)),"
    " r AS (SELECT z, id, id AS label FROM p UNION SELECT e.z, e.dst AS id, r.label FROM r JOIN e ON e.z = r.z AND e.src = r.id AND r.label < e.dst),"
    " c AS (SELECT z, id, min(label) AS label FROM r GROUP BY 1, 2)"
)


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cl.threshold_clusters(customers(spark, folder), F.col("sigma"), THRESHOLDS, SURFACE)


@query("clusters", f"WITH RECURSIVE {_LINKS} SELECT CAST(z AS INT) AS z, id, label FROM c")
def _clusters_query(spark, folder):
    """Cluster label of every customer at five thresholds, in one run."""
    return _clusters(spark, folder)


@query(
    "clusters_by_nation",
    "WITH RECURSIVE p AS (SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS x FROM customer),"
    " e AS MATERIALIZED (SELECT a.nation, a.id AS src, b.id AS dst FROM p a JOIN p b ON a.nation = b.nation AND a.id <> b.id AND abs(a.x - b.x) <= 20),"
    " r AS (SELECT nation, id, id AS label FROM p UNION SELECT e.nation, e.dst, r.label FROM r JOIN e ON e.nation = r.nation AND e.src = r.id AND r.label < e.dst)"
    " SELECT nation, id, min(label) AS label FROM r GROUP BY 1, 2",
)
def _clusters_by_nation(spark, folder):
    """Customers of one nation linked when their balances differ by at most 20."""
    points = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"), F.lit(20.0).alias("rho")
    )
    return link_components(points, ["nation"])


@query(
    "centroid",
    f"WITH RECURSIVE {_LINKS} SELECT CAST(c.z AS INT) AS z, c.label, CAST(count(*) AS BIGINT) AS n, round(avg(q.x), 5) AS mean_x, round(avg(q.y), 5) AS mean_y FROM c JOIN {C_SQL} q ON q.id = c.id GROUP BY 1, 2",
)
def _centroid(spark, folder):
    joined = _clusters(spark, folder).join(customers(spark, folder), "id")
    out = cl.centroids(joined, ["z", "label"], ["x", "y"])
    return out.select("z", "label", "n", F.round("mean_x", 5).alias("mean_x"), F.round("mean_y", 5).alias("mean_y"))


@query(
    "cluster_join",
    f"WITH RECURSIVE {_LINKS}, s AS (SELECT z, label, count(*) AS n FROM c GROUP BY 1, 2) SELECT c.id, CAST(max(CASE WHEN c.z = 0 THEN s.n END) AS BIGINT) AS n_tight,"
    " CAST(max(CASE WHEN c.z = 4 THEN s.n END) AS BIGINT) AS n_loose FROM c JOIN s ON s.z = c.z AND s.label = c.label GROUP BY 1",
)
def _cluster_join(spark, folder):
    """Size of each event's cluster at the tightest and loosest threshold."""
    labels = materialize(_clusters(spark, folder), "labels")
    sizes = labels.groupBy("z", "label").agg(F.count("*").alias("n"))
    joined = labels.join(sizes, ["z", "label"])
    return joined.groupBy("id").agg(
        F.max(F.when(F.col("z") == 0, F.col("n"))).alias("n_tight"), F.max(F.when(F.col("z") == 4, F.col("n"))).alias("n_loose")
    )


_MATCH = (
    f"m AS MATERIALIZED (SELECT p.z, p.id, s.id AS site, sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2)) AS d FROM p JOIN {S_SQL} s ON sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2)) <= p.rho),"
    " se AS MATERIALIZED (SELECT DISTINCT a.z, a.site AS src, b.site AS dst FROM m a JOIN m b ON a.z = b.z AND a.id = b.id),"
    " sr AS (SELECT DISTINCT z, site, site AS label FROM m UNION SELECT se.z, se.dst, sr.label FROM sr JOIN se ON se.z = sr.z AND se.src = sr.site AND sr.label < se.dst),"
    " sc AS (SELECT z, site, min(label) AS merged FROM sr GROUP BY 1, 2)"
)


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    spread = cl.by_threshold(customers(spark, folder).drop("c_nationkey"), F.col("sigma"), THRESHOLDS, SURFACE)
    return materialize(cl.site_matches(spread, suppliers(spark, folder)), "matches")


@query("closure", f"WITH RECURSIVE {_LINKS}, {_MATCH} SELECT CAST(z AS INT) AS z, site, merged FROM sc")
def _closure(spark, folder):
    """Known sites merged when one event matches several of them."""
    return cl.merged_sites(_matches(spark, folder))


@query(
    "site_assign",
    f"WITH RECURSIVE {_LINKS}, {_MATCH}, n AS (SELECT z, id, site, d, row_number() OVER (PARTITION BY z, id ORDER BY d, site) AS rn FROM m)"
    " SELECT CAST(n.z AS INT) AS z, n.id, sc.merged AS site, n.site AS nearest_site, round(n.d, 6) AS distance FROM n JOIN sc ON sc.z = n.z AND sc.site = n.site WHERE rn = 1",
)
def _site_assign(spark, folder):
    return cl.assign_sites(_matches(spark, folder)).withColumn("distance", F.round("distance", 6))


_COMBINED = (
    f"WITH RECURSIVE {_LINKS}, {_MATCH}, n AS (SELECT z, id, site, row_number() OVER (PARTITION BY z, id ORDER BY d, site) AS rn FROM m),"
    " a AS (SELECT n.z, n.id, sc.merged FROM n JOIN sc ON sc.z = n.z AND sc.site = n.site WHERE rn = 1),"
    " k AS (SELECT c.z, c.label, min(a.merged) AS s FROM c LEFT JOIN a ON a.z = c.z AND a.id = c.id GROUP BY 1, 2),"
    " f AS (SELECT c.z, CASE WHEN k.s IS NOT NULL THEN -1 - k.s ELSE c.label END AS cluster, k.s IS NOT NULL AS known, count(*) AS n FROM c JOIN k ON k.z = c.z AND k.label = c.label GROUP BY 1, 2, 3),"
    " g AS (SELECT z, known, n, CASE WHEN n >= 100 THEN 100 WHEN n >= 10 THEN 10 ELSE n END AS size_group FROM f)"
)
_MULTI_SQL = (
    " SELECT CAST(z AS INT) AS z, CAST(size_group AS INT) AS size_group, CAST(count(*) FILTER (WHERE known) AS BIGINT) AS known_clusters, CAST(count(*) FILTER (WHERE NOT known) AS BIGINT) AS unknown_clusters,"
    " CAST(sum(CASE WHEN known THEN n ELSE 0 END) AS BIGINT) AS known_events, CAST(sum(CASE WHEN known THEN 0 ELSE n END) AS BIGINT) AS unknown_events FROM g GROUP BY 1, 2"
)


def _multiplicity_table(spark: SparkSession, folder: str) -> DataFrame:
    labels = materialize(_clusters(spark, folder), "labels")
    combined = cl.combined_clusters(customers(spark, folder), cl.assign_sites(_matches(spark, folder)), labels)
    return cl.multiplicity(combined.groupBy("z", "cluster", "known").agg(F.count("*").alias("n")))


@query("multiplicity", _COMBINED + _MULTI_SQL)
def _multiplicity(spark, folder):
    """Clusters and events per size group, split by known and unknown."""
    return _multiplicity_table(spark, folder)


_SMALL = "size_group >= 2 AND size_group <= max_small"


@query(
    "abcd",
    f"{_COMBINED}, t AS ({_MULTI_SQL}), s AS (SELECT z, CAST(max_small AS INT) AS max_small, CAST(sum(CASE WHEN {_SMALL} THEN known_clusters ELSE 0 END) AS BIGINT) AS known_small,"
    f" CAST(sum(CASE WHEN {_SMALL} THEN unknown_clusters ELSE 0 END) AS BIGINT) AS unknown_small, CAST(sum(CASE WHEN size_group = 1 THEN known_clusters ELSE 0 END) AS BIGINT) AS known_singlets"
    " FROM t, (SELECT unnest([3, 5, 10]) AS max_small) GROUP BY 1, 2)"
    " SELECT *, 2.0::DOUBLE * known_small / nullif(unknown_small, 0) AS tau, known_singlets / nullif(2.0::DOUBLE * known_small / nullif(unknown_small, 0), 0) AS background FROM s",
)
def _abcd(spark, folder):
    """Singlet background from known and unknown small clusters."""
    return cl.background_estimate(_multiplicity_table(spark, folder), [3, 5, 10])


_MC = f"(SELECT s_suppkey AS id, {_SX} + 0.3 AS x, {_SY} + 0.2 AS y, CAST(1 + s_nationkey % 5 AS DOUBLE) * 0.4 AS sigma, CAST(1 + s_nationkey AS DOUBLE) AS weight FROM supplier)"


def _simulated(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.expr(f"{_SX} + 0.3").alias("x"), F.expr(f"{_SY} + 0.2").alias("y"),
        F.expr("CAST(1 + s_nationkey % 5 AS DOUBLE) * 0.4").alias("sigma"), (1.0 + F.col("s_nationkey")).alias("weight"),
    )


_ATTACH = (
    f"nb AS (SELECT id, nb, sqrt(d2) AS d FROM (SELECT a.id, b.id AS nb, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,"
    f" row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rn FROM {_MC} a, {C_SQL} b) WHERE rn = 1 AND d2 <= 75.0 * 75.0),"
    f" att AS (SELECT v.z, s.id, s.weight, c.label AS cluster FROM {_MC} s CROSS JOIN {_levels(THRESHOLDS)} v LEFT JOIN nb ON nb.id = s.id AND nb.d <= greatest(2.0, sqrt(v.t) * s.sigma) LEFT JOIN c ON c.z = v.z AND c.id = nb.nb)"
)


def _attached(spark: SparkSession, folder: str) -> DataFrame:
    return cl.attach_simulated(
        _simulated(spark, folder), customers(spark, folder), _clusters(spark, folder), F.col("sigma"), THRESHOLDS, SURFACE, 75.0
    )


@query("attach_simulated", f"WITH RECURSIVE {_LINKS}, {_ATTACH} SELECT CAST(z AS INT) AS z, id, cluster FROM att")
def _attach(spark, folder):
    """Simulated events take the cluster of the nearest data event in reach."""
    return _attached(spark, folder)


@query(
    "mc_eff",
    f"WITH RECURSIVE {_LINKS}, {_ATTACH} SELECT CAST(z AS INT) AS z, round(sum(CASE WHEN cluster IS NULL THEN weight ELSE 0 END) / sum(weight), 6) AS unclustered FROM att GROUP BY 1",
)
def _mc_eff(spark, folder):
    """Weighted share of simulated events left unclustered, per threshold."""
    joined = _attached(spark, folder).join(_simulated(spark, folder).select("id", "weight"), "id")
    return cl.unclustered_fraction(joined, F.col("weight"), F.col("cluster").isNull()).withColumn("unclustered", F.round("unclustered", 6))


@query(
    "seed_pick",
    f"WITH g AS (SELECT *, floor(x / 60) AS cx, floor(y / 60) AS cy FROM {C_SQL}), k AS (SELECT cx, cy, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM g GROUP BY 1, 2 ORDER BY n DESC, cx, cy LIMIT 1)"
    " SELECT arg_min(id, d) AS seed, CAST(max(n) AS BIGINT) AS in_cell, round(min(d), 6) AS \"offset\" FROM (SELECT g.id, n, sqrt(pow(x - mx, 2) + pow(y - my, 2)) AS d FROM g JOIN k ON g.cx = k.cx AND g.cy = k.cy)",
)
def _seed_pick(spark, folder):
    """Row nearest the mean of the fullest cell."""
    return cl.seed(customers(spark, folder), 60.0).withColumn("offset", F.round("offset", 6))


@query("small_cluster_trials")
def _small_cluster_trials(spark, folder):
    """Singlet share of small random draws clustered on their own (a sampling test)."""
    return cl.small_cluster_trials(customers(spark, folder), [5, 10, 16], 4, F.col("sigma"), [4, 100], SURFACE)


_DIRECTIONS = {
    "order_line": "l_orderkey * 8 + l_linenumber",
    "payload_longitude": "CAST((l_partkey * 13) % 3600 AS DOUBLE) * 0.1 - 180.0",
    "payload_latitude": "-70.0 - CAST(l_suppkey % 150 AS DOUBLE) * 0.1",
    "payload_altitude": "37000.0 + l_quantity * 40.0",
    "payload_heading": "CAST(l_partkey % 360 AS DOUBLE)",
    "theta": "-4.0 - l_discount * 150.0",
    "phi": "CAST(l_suppkey * 17 % 360 AS DOUBLE)",
    "snr": "3.0 + l_quantity * 0.2",
}


def directions(spark: SparkSession, folder: str) -> DataFrame:
    """Viewing directions of all order lines, numbered in order because (order, line) pairs repeat."""
    rows = table(spark, folder, "lineitem").select(*[F.expr(e).alias(n) for n, e in _DIRECTIONS.items()])
    return place(rows, rows.columns).withColumnRenamed("_g", "id").drop("order_line")


@query("event_geometry")
def _event_geometry(spark, folder):
    """Ground position, plane coordinates, resolution and self-likelihood of every direction."""
    made = cl.event_geometry(directions(spark, folder))
    return made.select(
        "id", "clusterable", F.round("longitude", 5).alias("longitude"), F.round("latitude", 5).alias("latitude"), F.round("easting", 1).alias("easting"),
        F.round("northing", 1).alias("northing"), F.round("sigma_theta", 6).alias("sigma_theta"), F.round("self_ll", 6).alias("self_ll"),
    )


@query(
    "geodesy",
    "WITH p AS (SELECT c_custkey, CAST((c_custkey * 131) % 3600 AS DOUBLE) * 0.1 - 180.0 AS lon, -61.0 - CAST((c_custkey * 37) % 280 AS DOUBLE) * 0.1 AS lat, c_acctbal AS alt FROM customer),"
    " k AS (SELECT *, 6378137.0 AS a, (1 / 298.257223563) * (2 - 1 / 298.257223563) AS e2, radians(-lat) AS f FROM p),"
    " s AS (SELECT *, sqrt(e2) AS e, sin(radians(71.0)) AS s71 FROM k),"
    " t AS (SELECT *, tan(pi() / 4 - f / 2) / pow((1 - e * sin(f)) / (1 + e * sin(f)), e / 2) AS tf, tan(pi() / 4 - radians(71.0) / 2) / pow((1 - e * s71) / (1 + e * s71), e / 2) AS t71, a / sqrt(1 - e2 * sin(f) * sin(f)) AS nu FROM s),"
    " r AS (SELECT *, a * cos(radians(71.0)) / sqrt(1 - e2 * s71 * s71) * tf / t71 AS rho FROM t)"
    " SELECT c_custkey, round(rho * sin(radians(lon)), 3) + 0.0 AS easting, round(rho * cos(radians(lon)), 3) AS northing, round((nu + alt) * cos(radians(lat)) * cos(radians(lon)), 3) AS x,"
    " round((nu * (1 - e2) + alt) * sin(radians(lat)), 3) AS z, round(lon, 6) AS lon_back, round(lat, 6) AS lat_back, round(alt, 3) AS alt_back FROM r",
)
def _geodesy(spark, folder):
    """Projection and earth-centred coordinates, and both inverses."""
    p = table(spark, folder, "customer").select(
        "c_custkey", F.expr("CAST((c_custkey * 131) % 3600 AS DOUBLE) * 0.1 - 180.0").alias("lon"),
        F.expr("-61.0 - CAST((c_custkey * 37) % 280 AS DOUBLE) * 0.1").alias("lat"), F.col("c_acctbal").alias("alt"),
    )
    e, n = geodesy.easting_northing(F.col("lon"), F.col("lat"))
    x, y, z = geodesy.earth_centred(F.col("lon"), F.col("lat"), F.col("alt"))
    made = p.select("c_custkey", "lon", e.alias("e"), n.alias("n"), x.alias("x"), y.alias("y"), z.alias("z"))
    _, lat_back = geodesy.longitude_latitude(F.col("e"), F.col("n"))
    back = geodesy.from_earth_centred(F.col("x"), F.col("y"), F.col("z"))
    lon_back, alt_back = back["longitude"], back["altitude"]
    turned = F.when((lon_back > 179.9999) & (F.col("lon") < 0), lon_back - 360.0).otherwise(lon_back)
    return made.select(
        "c_custkey", F.round("e", 3).alias("easting"), F.round("n", 3).alias("northing"), F.round("x", 3).alias("x"), F.round("z", 3).alias("z"),
        F.round(turned, 6).alias("lon_back"), F.round(lat_back, 6).alias("lat_back"), F.round(alt_back, 3).alias("alt_back"),
    )


@query("pair_fit")
def _pair_fit(spark, folder):
    """Joint source position of each direction and its nearest neighbours."""
    events = materialize(cl.event_geometry(directions(spark, folder)), "events")
    return cl.fit_near_pairs(events, 2, scores.HORIZON_M)


@query("cluster_residuals")
def _cluster_residuals(spark, folder):
    """Angles between each direction and the centre of its 10-degree ground cell."""
    made = materialize(cl.event_geometry(directions(spark, folder)).filter("clusterable"), "events")
    x, y, z = geodesy.earth_centred(F.col("longitude"), F.col("latitude"), F.lit(0.0))
    cell = [F.floor(F.col("easting") / 50000).alias("cx"), F.floor(F.col("northing") / 50000).alias("cy")]
    placed = made.withColumns({"x": x, "y": y, "z": z}).select("*", *cell)
    # The cell centres and the events both read the written table: the geometry runs once.
    centres = cl.centroid_location(cl.centroids(placed, ["cx", "cy"], ["x", "y", "z"]))
    out = cl.residuals(placed.drop("x", "y", "z"), centres, ["cx", "cy"])
    return out.select("id", F.round("d_theta", 6).alias("d_theta"), F.round("d_phi", 6).alias("d_phi"), F.round("cluster_ll", 4).alias("cluster_ll"))


@query(
    "pair_score",
    "WITH p AS (SELECT l_orderkey, l_quantity * 0.1 AS t1, l_discount * 100 AS p1, l_tax * 50 AS t2, l_extendedprice % 360 AS p2, 0.25 AS st, 0.5 AS sp, l_extendedprice * 20 AS d FROM lineitem),"
    " w AS (SELECT *, (p2 - p1) - 360 * floor(((p2 - p1) + 180) / 360) AS dp FROM p), l AS (SELECT l_orderkey, pow((t2 - t1) / st, 2) + pow(dp / sp, 2) AS ll, greatest(0, d - 750000.0) AS over FROM w)"
    " SELECT l_orderkey % 1000 AS bucket, round(min(ll + over), 4) AS lowest, round(max(least(ll + over + 1, ll + 2)), 4) AS d_min, round(max(ll + over + 1 + ll + 2), 4) AS d_sum FROM l GROUP BY 1",
)
def _pair_score(spark, folder):
    p = table(spark, folder, "lineitem").select(
        "l_orderkey", (F.col("l_quantity") * 0.1).alias("t1"), (F.col("l_discount") * 100).alias("p1"), (F.col("l_tax") * 50).alias("t2"),
        (F.col("l_extendedprice") % 360).alias("p2"), (F.col("l_extendedprice") * 20).alias("d"),
    )
    args = (F.col("t1"), F.col("p1"), 0.25, 0.5, F.col("t2"), F.col("p2"))
    near, far = scores.point_log_likelihood(*args), scores.point_log_likelihood(*args, distance_m=F.col("d"))
    rows = p.select((F.col("l_orderkey") % 1000).alias("bucket"), near.alias("near"), far.alias("far"))
    return rows.groupBy("bucket").agg(
        F.round(F.min("far"), 4).alias("lowest"),
        F.round(F.max(scores.pair_min(F.col("far"), F.col("near"), F.lit(2.0), F.lit(1.0))), 4).alias("d_min"),
        F.round(F.max(scores.pair_sum(F.col("far"), F.col("near"), F.lit(1.0), F.lit(2.0))), 4).alias("d_sum"),
    )
