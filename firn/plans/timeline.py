"""Ordered and time-series queries over ``events``, ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from firn.functions.compare import rounded
from firn.operators import joins, monitor, series
from firn.plans.registry import query, table

WRAP = 100.0
KEYS = ["user_id"]
ORDER = ["ts", "event_id"]


def _events(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """Events with time in seconds since 2024 as ``t``."""
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value", *more).withColumn("t", seconds)


_E = "(SELECT *, (epoch_us(ts) - 1704067200000000) / 1e6 AS t FROM events)"


@query(
    "unwrap",
    f"WITH d AS (SELECT *, value % {WRAP} AS y, (value % {WRAP}) - lag(value % {WRAP}) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),"
    f" k AS (SELECT *, CASE WHEN s > 50 THEN ceil(s / 100 - 0.5) WHEN s < -50 THEN floor(s / 100 + 0.5) ELSE 0 END AS n FROM d)"
    f" SELECT event_id, user_id, round(y - 100.0 * sum(coalesce(n, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS unwrapped FROM k",
)
def _unwrap(spark, folder):
    """Whole-turn unwrapping of each user's series, whatever its length."""
    df = table(spark, folder, "events").select("event_id", "user_id", "ts", (F.col("value") % WRAP).alias("y"))
    return series.unwrap(df, KEYS, ORDER, "y", WRAP).select("event_id", "user_id", F.round("unwrapped", 4).alias("unwrapped"))


@query(
    "derivative",
    f"SELECT event_id, round((n - value) / nullif(nt - t, 0), 6) AS derivative FROM (SELECT *, lead(value) OVER w AS n, lead(t) OVER w AS nt FROM {_E}"
    " WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE nt IS NOT NULL",
)
def _derivative(spark, folder):
    out = series.derivative(_events(spark, folder), ["event_type"], ORDER, "t", "value")
    return out.select("event_id", F.round("derivative", 6).alias("derivative"))


@query(
    "rolling_mean",
    "SELECT event_id, round(sum(value) OVER w, 2) / count(value) OVER w AS rolling_mean, CAST(count(value) OVER w AS BIGINT) AS rolling_count FROM events"
    " WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)",
)
def _rolling_mean(spark, folder):
    """Mean over the last 1000 rows of each channel."""
    df = table(spark, folder, "events").select("event_id", "ts", "event_type", "value")
    out = series.rolling_mean(df, ["event_type"], ORDER, "value", 1000)
    # Values are in hundredths: the sum is made exact before dividing, so both engines agree to the last bit.
    total = F.round(F.col("rolling_mean") * F.col("rolling_count"), 2)
    return out.select("event_id", (total / F.col("rolling_count")).alias("rolling_mean"), "rolling_count")


@query(
    "local_p2p",
    "WITH a AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),"
    " x AS (SELECT * FROM a WHERE (p > value AND value < n) OR (p < value AND value > n)),"
    " y AS (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nv FROM x)"
    " SELECT user_id, round(max(abs(value - nv)), 4) AS swing FROM y WHERE nv IS NOT NULL GROUP BY 1",
)
def _local_p2p(spark, folder):
    df = _events(spark, folder)
    return series.local_swings(df, KEYS, ORDER, "t", "value").select("user_id", F.round("swing", 4).alias("swing"))


@query(
    "integrated_power",
    f"SELECT user_id, round(sum(value * value * (nt - t)), 2) AS power FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nt FROM {_E})"
    " WHERE nt IS NOT NULL GROUP BY 1",
)
def _integrated_power(spark, folder):
    out = series.integrated_power(_events(spark, folder), KEYS, ORDER, "t", "value")
    return out.select("user_id", F.round("power", 2).alias("power"))


@query(
    "gap_fill",
    "WITH s AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step FROM events)"
    " SELECT event_type AS bin, CAST(count(*) AS BIGINT) AS passed, CAST(sum(greatest(coalesce(step, 1), 1)) AS BIGINT) AS trials,"
    " round(count(*) / sum(greatest(coalesce(step, 1), 1)), 9) AS efficiency FROM s GROUP BY 1",
)
def _gap_fill(spark, folder):
    """Detected pulses over expected ones: a gap of n seconds hides n - 1 trials."""
    df = table(spark, folder, "events").select("event_id", "ts", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    stepped = series.gaps(df, ["event_type"], ORDER, "s")
    out = series.missing_trials(stepped, F.col("event_type"), F.col("step"))
    return out.select("bin", "passed", "trials", F.round("efficiency", 9).alias("efficiency"))


@query(
    "gap_detect",
    "SELECT event_id, event_type, event_id - p AS step FROM (SELECT event_id, event_type, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) WHERE event_id - p <> 1",
)
def _gap_detect(spark, folder):
    """Ids of one event type that do not follow each other."""
    df = table(spark, folder, "events").select("event_id", "event_type")
    return series.breaks(df, ["event_type"], ["event_id"], "event_id").select("event_id", "event_type", "step")


@query("stride", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS g FROM events) WHERE g % 7 = 0")
def _stride(spark, folder):
    return series.every_kth(table(spark, folder, "events").select("event_id", "user_id", "ts"), ORDER, 7).select("event_id", "user_id")


@query("kth_row", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 1 OFFSET 500")
def _kth_row(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value", (-F.col("value")).alias("m"))
    return series.kth_row(df, ["m", "event_id"], 500).select("event_id", "value")


@query("limit_offset", "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 250 OFFSET 100")
def _limit_offset(spark, folder):
    return table(spark, folder, "events").orderBy("ts", "event_id").offset(100).limit(250).select("event_id", "value")


@query(
    "divide",
    "WITH n AS (SELECT count(*) AS n FROM events), g AS (SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS g FROM events)"
    " SELECT CAST(least(g // (n // 7), 6) AS INT) AS division, CAST(count(*) AS BIGINT) AS rows, min(event_id) AS first_event, max(event_id) AS last_event FROM g, n GROUP BY 1",
)
def _divide(spark, folder):
    """Seven equal consecutive slices, the remainder in the last."""
    out = series.divide(table(spark, folder, "events").select("event_id", "ts"), ORDER, 7)
    return out.groupBy("division").agg(F.count("*").alias("rows"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query(
    "first_last",
    "SELECT user_id, arg_min(event_id, event_id) AS first_event_id, arg_max(event_id, event_id) AS last_event_id, arg_min(value, event_id) AS first_value,"
    " arg_max(value, event_id) AS last_value FROM events GROUP BY 1",
)
def _first_last(spark, folder):
    return series.first_last(table(spark, folder, "events"), KEYS, F.col("event_id"), ["event_id", "value"])


@query(
    "mean_rms",
    "SELECT event_type, CAST(count(value) AS BIGINT) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS rms,"
    " min(value) AS smallest, max(value) AS largest FROM events GROUP BY 1",
)
def _mean_rms(spark, folder):
    out = series.moments(table(spark, folder, "events"), ["event_type"], "value")
    return out.select(
        "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), F.round("rms", 6).alias("rms"), "smallest", "largest"
    )


@query(
    "normalize",
    "SELECT event_id, round((value - avg(value) OVER (PARTITION BY event_type)) / stddev_pop(value) OVER (PARTITION BY event_type), 6) AS normalised FROM events",
)
def _normalize(spark, folder):
    df = table(spark, folder, "events").select("event_id", "event_type", "value")
    return series.normalise(df, ["event_type"], "value").select("event_id", F.round("normalised", 6).alias("normalised"))


@query("sample_fraction")
def _sample_fraction(spark, folder):
    """About one per cent of rows, the same ones each time (a sampling operator)."""
    return series.sample_fraction(table(spark, folder, "events").select("event_id", "value"), 1.0, 11, ["event_id"])


@query("sample_rows")
def _sample_rows(spark, folder):
    """Exactly 100 rows without replacement (a sampling operator)."""
    return series.sample_rows(table(spark, folder, "events").select("event_id", "value"), 100, 11, ["event_id"])


_INTERP_SQL = (
    "WITH k AS (SELECT t, avg(value) % 360 AS v FROM (SELECT *, CAST(floor((epoch_us(ts) - 1704067200000000) / 1e6 / 3600) AS DOUBLE) * 3600 AS t FROM events) GROUP BY t),"
    " n AS (SELECT t AS t0, v AS v0, lead(t) OVER (ORDER BY t) AS t1, lead(v) OVER (ORDER BY t) AS v1 FROM k),"
    f" p AS (SELECT event_id, t FROM {_E}),"
    " j AS (SELECT * FROM p ASOF LEFT JOIN n ON p.t >= n.t0),"
    " r AS (SELECT event_id, CASE WHEN t = t0 THEN v0 WHEN t1 IS NOT NULL THEN v0 + ((v1 - v0) - 360 * round((v1 - v0) / 360)) * (t - t0) / (t1 - t0) END AS y FROM j)"
    " SELECT event_id, round(y - 360 * floor(y / 360), 6) AS interpolated FROM r"
)


@query("interp_asof", _INTERP_SQL)
def _interp_asof(spark, folder):
    """Hourly series looked up at every event time by linear interpolation, periodic in 360."""
    events = _events(spark, folder)
    hour = F.floor(F.col("t") / 3600) * 3600.0
    knots = events.groupBy(hour.alias("t")).agg((F.avg("value") % 360).alias("v"))
    out = joins.interpolate_at(events.select("event_id", "t"), knots, [], "t", "v", ["event_id"], wrap=360.0)
    return out.select("event_id", F.round("interpolated", 6).alias("interpolated"))


@query(
    "noise_at_event",
    f"WITH k AS (SELECT event_type, t, value AS noise FROM {_E} WHERE event_id % 10 = 0), p AS (SELECT event_id, event_type, t FROM {_E})"
    " SELECT p.event_id, k.noise AS noise FROM p ASOF LEFT JOIN k ON p.event_type = k.event_type AND p.t >= k.t",
)
def _noise_at_event(spark, folder):
    """Latest noise level of the channel at each event time; every tenth reading is a noise level."""
    events = _events(spark, folder)
    knots = events.filter(F.col("event_id") % 10 == 0).select("event_type", "t", F.col("value").alias("noise"))
    return joins.last_known_at(events.select("event_id", "event_type", "t"), knots, ["event_type"], "t", "noise", ["event_id"], "noise").select(
        "event_id", "noise"
    )


@query(
    "noise_average",
    "SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS time_bin, round(avg(value), 6) AS noise, CAST(count(value) AS BIGINT) AS n FROM events GROUP BY 1, 2",
)
def _noise_average(spark, folder):
    df = table(spark, folder, "events")
    out = monitor.noise_average(df, ["event_type"], F.unix_seconds(F.col("ts").cast("timestamp")), "value", 3600.0)
    return out.withColumn("noise", F.round("noise", 6))


_CHI = (
    "sum(CASE WHEN counted > 0 THEN pow(n * width / (s * s) * (width * (b + 0.5)) * exp(-0.5 * pow(width * (b + 0.5) / s, 2)) - counted, 2) / counted ELSE 0 END)"
)


@query(
    "rayleigh_scan",
    "WITH m AS (SELECT event_type, avg(value) AS mean, CAST(count(value) AS BIGINT) AS n, avg(value) * sqrt(-(4.0 / pi()) * ln(1.0 - 0.999)) / 10 AS width FROM events GROUP BY 1),"
    " c AS (SELECT m.event_type, b, mean, n, width, (SELECT count(*) FROM events e WHERE e.event_type = m.event_type AND CAST(floor(e.value / width) AS INT) = b) AS counted FROM m, range(0, 10) AS r(b)),"
    f" g AS (SELECT event_type, n, mean, sqrt(2.0 / pi()) * mean AS guess, CAST(count(*) FILTER (WHERE counted > 0) AS INT) AS filled, {_CHI.replace('s * s', 'pow(sqrt(2.0 / pi()) * mean, 2)').replace('/ s,', '/ (sqrt(2.0 / pi()) * mean),')} AS guess_chi FROM c GROUP BY event_type, n, mean),"
    f" t AS (SELECT event_type, s, {_CHI} AS chi FROM (SELECT c.*, 2 * sqrt(2.0 / pi()) * mean * k / 100 AS s FROM c, range(1, 100) AS q(k)) GROUP BY event_type, s),"
    " b AS (SELECT event_type, arg_min(s, chi) AS scan_scale, min(chi) AS scan_chi FROM t GROUP BY 1)"
    " SELECT event_type, n, round(mean, 6) AS mean, round(guess, 6) AS guess, round(guess_chi, 4) AS guess_chi, filled, round(scan_scale, 6) AS scan_scale, round(scan_chi, 4) AS scan_chi FROM g JOIN b USING (event_type)",
)
def _rayleigh_scan(spark, folder):
    """Rayleigh guess and 99-step scan of each channel's amplitudes."""
    out = monitor.whole_fit(table(spark, folder, "events").select("event_type", "value"), ["event_type"], "value")
    digits = {"mean": 6, "guess": 6, "guess_chi": 4, "scan_scale": 6, "scan_chi": 4}
    return out.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


@query("rolling_monitor")
def _rolling_monitor(spark, folder):
    """Trailing 1000-event Rayleigh fit and tail probability at every event, and the bin decision."""
    df = monitor.good_new(table(spark, folder, "events").select("event_id", "ts", "event_type", "value"), F.col("value") > 0)
    out = monitor.rolling_fit(df, ["event_type"], ORDER, "value")
    drop = monitor.zero_decision(F.try_divide("chi_square", "ndf"), 3.0, F.col("value"), F.col("scale"), 1e-4)
    return out.select(
        "event_id", "event_type", F.round("scale", 6).alias("scale"), F.round("chi_square", 4).alias("chi_square"), "ndf", "window_rows",
        F.round("log10_prob", 6).alias("log10_prob"), drop.alias("blanked"),
    )


@query(
    "moving_path",
    f"WITH s AS (SELECT user_id AS path, t AS t0, lead(t) OVER w AS t1, value AS x0, lead(value) OVER w AS x1, t / 5000 AS y0, lead(t) OVER w / 5000 AS y1 FROM {_E} WHERE event_type = 'purchase'"
    " WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),"
    f" e AS (SELECT event_id AS id, t, value AS x, t / 5000 AS y FROM {_E} WHERE event_type = 'error')"
    " SELECT id, path, round(abs(x - (x0 + (t - t0) / (t1 - t0) * (x1 - x0))), 4) AS distance FROM e JOIN s ON t >= t0 AND t < t1"
    " WHERE abs(x - (x0 + (t - t0) / (t1 - t0) * (x1 - x0))) <= 0.5",
)
def _moving_path(spark, folder):
    """Error events near each user's moving purchase level, at the event's own time."""
    events = _events(spark, folder)
    points = events.filter(F.col("event_type") == "purchase").select("user_id", "event_id", "ts", "t", "value")
    ahead = series.neighbours(series.place(points, ["user_id", *ORDER]), KEYS, {"t1": ("t", 1), "x1": ("value", 1)}).filter(F.col("t1").isNotNull())
    segments = ahead.select(
        F.col("user_id").alias("path"), F.col("t").alias("t0"), "t1", F.col("value").alias("x0"), "x1", (F.col("t") / 5000).alias("y0"), (F.col("t1") / 5000).alias("y1")
    )
    seen = events.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("id"), "t", F.col("value").alias("x"), (F.col("t") / 5000).alias("y")
    )
    return joins.near_moving_path(seen, segments, 0.5, 20000.0).withColumn("distance", rounded(F.col("distance"), 4))
