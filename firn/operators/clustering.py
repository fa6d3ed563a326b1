"""Multi-threshold clustering of event positions, known sites, and cluster summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from firn.functions import geodesy, scores
from firn.functions.fitting import EVENT_FIELDS, pair_fit
from firn.operators.joins import HOT_ROWS, salted_join
from firn.operators.spatial import components, knn, link_components
from firn.session import materialize, shuffle_width

# Cluster size groups, each from its number up to the next.
SIZE_GROUPS = [100, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1]


def event_geometry(df: DataFrame, model: int = 3) -> DataFrame:
    """Source position, plane coordinates, resolution and self-likelihood of each direction.

    Needs payload longitude, latitude, altitude, heading, and theta, phi, snr. Directions
    above the horizon keep NULL positions and ``clusterable`` false.
    """
    payload = {c: F.col(f"payload_{c}") for c in ("longitude", "latitude", "altitude", "heading")}
    hit = geodesy.with_trace_to_surface(df, payload, F.col("theta"), F.col("phi"), "_hit")
    placed = hit.withColumns(
        {
            "longitude": F.col("_hit.longitude"),
            "latitude": F.col("_hit.latitude"),
            "distance_m": F.col("_hit.distance"),
            "altitude": F.lit(0.0),
            "sigma_theta": scores.resolution(F.col("snr"), "theta", model),
            "sigma_phi": scores.resolution(F.col("snr"), "phi", model),
        }
    ).drop("_hit")
    easting, northing = geodesy.easting_northing(F.col("longitude"), F.col("latitude"))
    source = {c: F.col(c) for c in ("longitude", "latitude", "altitude")}
    seen = geodesy.with_view_angles(placed.withColumns({"easting": easting, "northing": northing}), payload, source, "_v")
    own = scores.point_log_likelihood(
        F.col("theta"), F.col("phi"), F.col("sigma_theta"), F.col("sigma_phi"), F.col("_v.theta"), F.col("_v.phi")
    )
    # The row number keeps a filter on ``clusterable`` above the steps: moved below them, it would repeat their formulas.
    known = seen.withColumns({"self_ll": own, "_row": F.monotonically_increasing_id()}).drop("_v")
    return known.withColumn("clusterable", F.col("longitude").isNotNull() & (F.col("_row") >= 0)).drop("_row")


def by_threshold(points: DataFrame, sigma: Column, thresholds: Sequence[float], surface: float) -> DataFrame:
    """One row per threshold ``z`` with the distance up to which a point links.

    A point's log-likelihood at distance d is (d/sigma)^2, so threshold t reaches
    sigma * sqrt(t); closer than ``surface`` always links.
    """
    levels = F.array(*[F.struct(F.lit(i).alias("z"), F.lit(float(t)).alias("t")) for i, t in enumerate(thresholds)])
    spread = points.withColumn("_l", F.explode(levels))
    reach = F.greatest(F.lit(float(surface)), F.sqrt(F.col("_l.t")) * sigma)
    return spread.withColumns({"z": F.col("_l.z"), "rho": reach}).drop("_l")


def threshold_clusters(points: DataFrame, sigma: Column, thresholds: Sequence[float], surface: float) -> DataFrame:
    """z, id, label for all thresholds in one run; the label is the smallest member id.

    Two points join when either sees the other within its threshold. All linked pairs
    count, whatever the order of events, so clusters only grow with the threshold.
    """
    return link_components(by_threshold(points.select("id", "x", "y", sigma.alias("_s")), F.col("_s"), thresholds, surface).drop("_s"), ["z"])


def site_matches(events: DataFrame, sites: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every (z, id, site) with the site inside the event's reach ``rho``.

    Sites go into cells as wide as the longest reach; an event looks in its 3 x 3 cells.
    Cells with very many events are split over several tasks. An event's bytes tell nothing of the
    sites it meets: events are dealt out evenly first, so that no few tasks hold them.
    """
    longest = events.agg(F.max("rho")).first()[0]
    if longest is None:
        return events.select("z", "id", F.lit(None).cast("bigint").alias("site"), F.lit(0.0).alias("distance")).filter(F.lit(False))
    side = float(longest)

    def cell(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(side))

    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = (
        sites.select(F.col("id").alias("site"), F.col("x").alias("_x"), F.col("y").alias("_y"), cell("x").alias("_bx"), cell("y").alias("_by"))
        .withColumn("_dx", F.explode(step))
        .withColumn("_dy", F.explode(step))
        .select("site", "_x", "_y", (F.col("_bx") + F.col("_dx")).alias("_cx"), (F.col("_by") + F.col("_dy")).alias("_cy"))
    )
    looked = events.select("z", "id", "x", "y", "rho", cell("x").alias("_cx"), cell("y").alias("_cy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2))
    looked = looked.repartition(shuffle_width(events.sparkSession), "z", "id")
    met = salted_join(looked, around, ["_cx", "_cy"], hot_rows)
    return met.select("z", "id", "site", d.alias("distance"), "rho").filter(F.col("distance") <= F.col("rho")).drop("rho")


def merged_sites(matches: DataFrame) -> DataFrame:
    """z, site, merged: sites seen together by an event share the smallest site number.

    Each event contributes a star around its smallest site, de-duplicated before the
    shuffle, so the edge list is bounded by distinct site pairs rather than events.
    """
    least = matches.groupBy("z", "id").agg(F.min("site").alias("first_site"))
    edges = matches.join(least, ["z", "id"]).select("z", F.col("first_site").alias("src"), F.col("site").alias("dst")).distinct()
    return components(edges, ["z"]).select("z", F.col("id").alias("site"), F.col("label").alias("merged"))


def assign_sites(matches: DataFrame) -> DataFrame:
    """z, id, site (merged), nearest_site, distance: the cluster of each matched event."""
    nearest = matches.groupBy("z", "id").agg(F.min(F.struct("distance", "site")).alias("_n"))
    flat = nearest.select("z", "id", F.col("_n.site").alias("nearest_site"), F.col("_n.distance").alias("distance"))
    return flat.join(merged_sites(matches).withColumnRenamed("site", "nearest_site"), ["z", "nearest_site"]).select(
        "z", "id", F.col("merged").alias("site"), "nearest_site", "distance"
    )


def combined_clusters(points: DataFrame, site_of: DataFrame, labels: DataFrame) -> DataFrame:
    """Known-site clusters first, the rest by event-event linking: z, id, cluster, known.

    Site clusters are numbered -1 - site so they cannot collide with event ids.
    """
    joined = labels.join(site_of.select("z", "id", "site"), ["z", "id"], "left")
    per_cluster = joined.groupBy("z", "label").agg(F.min("site").alias("cluster_site"))
    known = F.col("cluster_site").isNotNull()
    full = labels.join(per_cluster, ["z", "label"])
    return full.select(
        "z", "id", F.when(known, -1 - F.col("cluster_site")).otherwise(F.col("label")).alias("cluster"), known.alias("known")
    )


def centroids(members: DataFrame, by: Sequence[str], position: Sequence[str]) -> DataFrame:
    """Mean position and size of each cluster."""
    return members.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in position])


def centroid_location(centred: DataFrame) -> DataFrame:
    """Longitude, latitude and altitude of mean earth-centred coordinates."""
    place = geodesy.from_earth_centred(F.col("mean_x"), F.col("mean_y"), F.col("mean_z"))
    return centred.withColumn("_p", place).select("*", "_p.*").drop("_p")


def size_group(n: Column) -> Column:
    chain = F.when(n >= SIZE_GROUPS[0], SIZE_GROUPS[0])
    for g in SIZE_GROUPS[1:]:
        chain = chain.when(n >= g, g)
    return chain


def multiplicity(sizes: DataFrame) -> DataFrame:
    """Clusters and events per (z, size group), known and unknown side by side.

    ``sizes`` has z, cluster, known, n.
    """
    known = F.col("known")
    return sizes.withColumn("size_group", size_group(F.col("n"))).groupBy("z", "size_group").agg(
        F.sum(known.cast("long")).alias("known_clusters"),
        F.sum((~known).cast("long")).alias("unknown_clusters"),
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known_events"),
        F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("unknown_events"),
    )


def background_estimate(table: DataFrame, max_small: Sequence[int], factor: float = 2.0) -> DataFrame:
    """Singlet background per threshold: known singlets over tau, tau from the small clusters.

    tau = factor * known / unknown clusters of 2..m members, for each m.
    """
    sides = table.withColumn("max_small", F.explode(F.array(*[F.lit(m) for m in max_small])))
    small = (F.col("size_group") >= 2) & (F.col("size_group") <= F.col("max_small"))

    def total(column: str, condition: Column) -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0))

    sums = sides.groupBy("z", "max_small").agg(
        total("known_clusters", small).alias("known_small"),
        total("unknown_clusters", small).alias("unknown_small"),
        total("known_clusters", F.col("size_group") == 1).alias("known_singlets"),
    )
    tau = F.try_divide(F.lit(factor) * F.col("known_small"), F.col("unknown_small"))
    return sums.withColumn("tau", tau).withColumn("background", F.try_divide(F.col("known_singlets"), F.col("tau")))


def unclustered_fraction(labels: DataFrame, weight: Column, unclustered: Column) -> DataFrame:
    """Weighted share of simulated events left without a cluster, per threshold."""
    w = weight.cast("double")
    return labels.groupBy("z").agg(
        F.try_divide(F.sum(F.when(unclustered, w).otherwise(0.0)), F.sum(w)).alias("unclustered")
    )


def attach_simulated(
    simulated: DataFrame, data: DataFrame, labels: DataFrame, sigma: Column, thresholds: Sequence[float], surface: float, horizon: float
) -> DataFrame:
    """z, id, cluster: each simulated event takes the cluster of its nearest data event in reach."""
    near = knn(simulated, data, 1, max_distance=horizon).select("id", "neighbour", "distance")
    reach = by_threshold(simulated.select("id", sigma.alias("_s")), F.col("_s"), thresholds, surface).select("z", "id", "rho")
    hit = reach.join(near, "id", "left").withColumn("neighbour", F.when(F.col("distance") <= F.col("rho"), F.col("neighbour")))
    return hit.join(labels.select("z", F.col("id").alias("neighbour"), F.col("label").alias("cluster")), ["z", "neighbour"], "left").select(
        "z", "id", "cluster"
    )


def residuals(events: DataFrame, clusters: DataFrame, by: Sequence[str]) -> DataFrame:
    """Angles from each event's direction to its cluster position, and their likelihood."""
    payload = {c: F.col(f"payload_{c}") for c in ("longitude", "latitude", "altitude", "heading")}
    joined = events.join(clusters.select(*by, *[F.col(c).alias(f"cluster_{c}") for c in ("longitude", "latitude", "altitude")]), list(by))
    seen = geodesy.with_view_angles(joined, payload, {c: F.col(f"cluster_{c}") for c in ("longitude", "latitude", "altitude")}, "_v")
    d_phi = F.pmod(F.col("_v.phi") - F.col("phi") + 180.0, F.lit(360.0)) - 180.0
    angled = seen.withColumns({"d_theta": F.col("_v.theta") - F.col("theta"), "d_phi": d_phi}).drop("_v")
    ll = F.pow(F.col("d_theta") / F.col("sigma_theta"), 2) + F.pow(F.col("d_phi") / F.col("sigma_phi"), 2)
    return angled.withColumn("cluster_ll", ll)


def fit_near_pairs(events: DataFrame, k: int, horizon: float) -> DataFrame:
    """Joint source fit of each event with its k nearest neighbours within the horizon, each pair once.

    Nearness is not mutual: a pair counts if either end has the other among its k nearest.
    ``events`` comes from :func:`event_geometry` with a unique ``id``. The cheap distance
    join runs first; the fit sees only the surviving pairs.
    """
    points = events.filter("clusterable").select("id", F.col("easting").alias("x"), F.col("northing").alias("y"))
    pairs = knn(points, points, k, exclude_self=True, max_distance=horizon).filter(F.col("neighbour").isNotNull())
    pairs = pairs.select(F.least("id", "neighbour").alias("id"), F.greatest("id", "neighbour").alias("neighbour"), "distance")
    # Written, so that the search's shuffle files are gone when the pairs meet their events.
    pairs = materialize(pairs.dropDuplicates(["id", "neighbour"]), "near_pairs")
    source = {
        "lon": "payload_longitude", "lat": "payload_latitude", "alt": "payload_altitude", "heading": "payload_heading",
        "theta": "theta", "phi": "phi", "sigma_theta": "sigma_theta", "sigma_phi": "sigma_phi",
    }

    def side(prefix: str, key: str) -> DataFrame:
        cols = [F.col(source[f]).alias(f"{prefix}_{f}") for f in EVENT_FIELDS]
        return events.select(F.col("id").alias(key), *cols, F.col("longitude").alias(f"{prefix}_slon"), F.col("latitude").alias(f"{prefix}_slat"))

    both = pairs.join(side("a", "id"), "id").join(side("b", "neighbour"), "neighbour")
    # The fit costs far more than its bytes suggest: keep adaptive execution from packing it into few tasks.
    both = both.repartition(shuffle_width(events.sparkSession), "id", "neighbour")
    fit = pair_fit(
        {f: F.col(f"a_{f}") for f in EVENT_FIELDS}, {f: F.col(f"b_{f}") for f in EVENT_FIELDS}, F.col("a_slon"), F.col("a_slat")
    )
    return both.select("id", "neighbour", "distance", fit.alias("fit")).select("id", "neighbour", "distance", "fit.*")


def seed(points: DataFrame, side: float) -> DataFrame:
    """The row nearest the mean of the fullest grid cell (smallest cell and id on ties).

    Counts and sums per cell are combined map-side; only one cell's summary is broadcast.
    """
    cx, cy = F.floor(F.col("x") / side), F.floor(F.col("y") / side)
    cells = points.groupBy(cx.alias("_cx"), cy.alias("_cy")).agg(F.count("*").alias("n"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    top = cells.agg(F.max(F.struct("n", (-F.col("_cx")).alias("a"), (-F.col("_cy")).alias("b"), "_mx", "_my")).alias("_t"))
    fullest = top.select(F.col("_t.n").alias("in_cell"), (-F.col("_t.a")).alias("_cx"), (-F.col("_t.b")).alias("_cy"), "_t._mx", "_t._my")
    inside = points.withColumns({"_cx": cx, "_cy": cy}).join(F.broadcast(fullest), ["_cx", "_cy"])
    d2 = F.pow(F.col("x") - F.col("_mx"), 2) + F.pow(F.col("y") - F.col("_my"), 2)
    return inside.agg(F.min(F.struct(d2.alias("d2"), "id", "in_cell")).alias("_s")).select(
        F.col("_s.id").alias("seed"), F.col("_s.in_cell").alias("in_cell"), F.sqrt("_s.d2").alias("offset")
    )


def small_cluster_trials(points: DataFrame, sizes: Sequence[int], trials: int, sigma: Column, thresholds: Sequence[float], surface: float, seed_value: int = 1) -> DataFrame:
    """Singlet share when a few random events are clustered on their own, per draw size and z.

    All trials run as one job: the draw number is part of the group key.
    """
    draws = [(n, t) for n in sizes for t in range(trials)]
    want = F.array(*[F.struct(F.lit(n).alias("size"), F.lit(i).alias("draw")) for i, (n, t) in enumerate(draws)])
    total = points.count()
    listed = points.select("id", "x", "y", sigma.alias("_s")).withColumn("_d", F.explode(want))
    # A hash below this level keeps each draw to a few times its size before the exact cut.
    level = F.least(F.lit(1.0), 8.0 * F.col("_d.size") / F.lit(float(max(total, 1))) + 8.0 / max(total, 1))
    mark = F.pmod(F.xxhash64(F.lit(seed_value), F.col("_d.draw"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    thin = listed.withColumn("_m", mark).filter(F.col("_m") < level)
    w = Window.partitionBy("_d.draw").orderBy("_m", "id")
    chosen = thin.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.col("_d.size"))
    spread = by_threshold(chosen.select(F.col("_d.draw").alias("draw"), F.col("_d.size").alias("size"), "id", "x", "y", "_s"), F.col("_s"), thresholds, surface)
    labels = link_components(spread.select("draw", "size", "z", "id", "x", "y", "rho"), ["draw", "size", "z"])
    sizes_table = labels.groupBy("draw", "size", "z", "label").count()
    return sizes_table.groupBy("size", "z").agg(
        F.avg((F.col("count") == 1).cast("double")).alias("singlet_share"), F.count("*").alias("clusters")
    )
