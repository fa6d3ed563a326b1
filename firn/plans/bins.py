"""Histogram, profile and threshold queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from firn.operators import histogram as h
from firn.operators.learn import exponential_tail, unpivot
from firn.operators.tails import fit_slices, tail_estimates, tail_scan
from firn.plans.flat import FLAT_SQL, flat_events
from firn.plans.registry import query, table

PRICE = h.Axis(40, 1000.0, 50000.0)
SCORE = h.Axis(64, 0.0, 500.0)


def bin_sql(x: str, axis: h.Axis) -> str:
    return (
        f"CASE WHEN {x} < {axis.low} THEN 0 WHEN {x} >= {axis.high} THEN {axis.bins + 1}"
        f" ELSE CAST(floor(({x} - {axis.low}) * {float(axis.bins)} / {float(axis.high - axis.low)}) AS INT) + 1 END"
    )


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def _dense_sql(bins: int, x: str, axis: h.Axis, source: str, weight: str = "1.0") -> str:
    return (
        f"SELECT g.bin, coalesce(f.content, 0.0) AS content FROM (SELECT CAST(unnest(range(1, {bins + 1})) AS INT) AS bin) g LEFT JOIN"
        f" (SELECT {bin_sql(x, axis)} AS bin, CAST(sum({weight}) AS DOUBLE) AS content FROM {source} GROUP BY 1) f ON f.bin = g.bin"
    )


@query(
    "hist1d_weighted",
    f"SELECT {bin_sql('l_extendedprice', PRICE)} AS bin, round(CAST(sum(l_tax) AS DOUBLE), 4) AS content, round(sqrt(sum(l_tax * l_tax)), 4) AS error,"
    " CAST(count(*) AS BIGINT) AS entries FROM lineitem GROUP BY 1",
)
def _hist1d(spark, folder):
    df = table(spark, folder, "lineitem")
    return _rounded(h.hist1d(df, F.col("l_extendedprice"), PRICE, F.col("l_tax")))


@query(
    "hist2d",
    f"SELECT {bin_sql('l_quantity', h.Axis(10, 0.0, 45.0))} AS bin_x, {bin_sql('l_extendedprice', PRICE)} AS bin_y,"
    " round(CAST(sum(l_discount) AS DOUBLE), 4) AS content, CAST(count(*) AS BIGINT) AS entries FROM lineitem GROUP BY 1, 2",
)
def _hist2d(spark, folder):
    df = table(spark, folder, "lineitem")
    return _rounded(h.hist2d(df, F.col("l_quantity"), F.col("l_extendedprice"), h.Axis(10, 0.0, 45.0), PRICE, F.col("l_discount")))


@query(
    "hist_time",
    "WITH e AS (SELECT min(event_id) AS lo, max(event_id) + 1 AS hi FROM events)"
    " SELECT CASE WHEN event_id >= hi THEN 33 ELSE CAST(floor((event_id - lo) * 32.0 / (hi - lo)) AS INT) + 1 END AS bin, CAST(count(*) AS BIGINT) AS entries FROM events, e GROUP BY 1",
)
def _hist_time(spark, folder):
    """Axis booked from the first to the last event number."""
    df = table(spark, folder, "events")
    axis = h.data_axis(df, F.col("event_id"), 32, pad=1.0)
    return h.hist1d(df, F.col("event_id"), axis).select("bin", "entries")


@query(
    "hist_extendable",
    "WITH RECURSIVE m AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),"
    " up AS (SELECT -1.0::DOUBLE AS a, 1.0::DOUBLE AS b UNION ALL SELECT a, b + (b - a) FROM up, m WHERE m.hi >= b),"
    " u AS (SELECT a, max(b) AS b FROM up GROUP BY a),"
    " down AS (SELECT a, b FROM u UNION ALL SELECT a - (b - a), b FROM down, m WHERE m.lo < a),"
    " ax AS (SELECT min(a) AS a, max(b) AS b FROM down)"
    " SELECT CAST(floor((c_acctbal - a) * 64.0 / (b - a)) AS INT) + 1 AS bin, CAST(count(*) AS BIGINT) AS entries FROM customer, ax GROUP BY 1",
)
def _hist_extendable(spark, folder):
    """Axis doubling until every value fits."""
    df = table(spark, folder, "customer")
    axis = h.extendable_axis(df, F.col("c_acctbal"), h.Axis(64, -1.0, 1.0))
    return h.hist1d(df, F.col("c_acctbal"), axis).select("bin", "entries")


_P2X, _P2Y = h.Axis(12, 0.0, 360.0), h.Axis(10, -26.0, 26.0)


@query(
    "profile2d",
    f"{FLAT_SQL} SELECT {bin_sql('peak_phi', _P2X)} AS bin_x, {bin_sql('peak_theta', _P2Y)} AS bin_y, round(avg(peak_value), 6) AS mean,"
    " round(stddev_pop(peak_value), 6) AS spread, CAST(count(*) AS BIGINT) AS entries FROM flat WHERE peak_theta < 0 AND longitude > -9999 GROUP BY 1, 2",
)
def _profile2d(spark, folder):
    df = flat_events(spark, folder).filter((F.col("peak_theta") < 0) & (F.col("longitude") > -9999))
    return _rounded(h.profile2d(df, F.col("peak_phi"), F.col("peak_theta"), F.col("peak_value"), _P2X, _P2Y), 6)


_LON, _LAT = h.Axis(36, -180.0, 180.0), h.Axis(15, -90.0, -60.0)


@query(
    "density_map",
    f"{FLAT_SQL} SELECT {bin_sql('longitude', _LON)} AS bin_x, {bin_sql('latitude', _LAT)} AS bin_y, round(CAST(sum(peak_value) AS DOUBLE), 4) AS content,"
    " CAST(count(*) AS BIGINT) AS entries FROM flat WHERE peak_theta < 0 GROUP BY 1, 2",
)
def _density_map(spark, folder):
    df = flat_events(spark, folder).filter(F.col("peak_theta") < 0)
    return _rounded(h.hist2d(df, F.col("longitude"), F.col("latitude"), _LON, _LAT, F.col("peak_value")))


_QY = h.Axis(20, 0.0, 0.1)
_H2 = f"SELECT {bin_sql('l_quantity', h.Axis(10, 0.0, 50.0))} AS bin_x, {bin_sql('l_tax', _QY)} AS bin_y, sum(l_discount) AS content, count(*) AS entries FROM lineitem GROUP BY 1, 2"


def _h2(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem")
    return h.hist2d(df, F.col("l_quantity"), F.col("l_tax"), h.Axis(10, 0.0, 50.0), _QY, F.col("l_discount"))


@query("project_y", f"SELECT bin_y, round(CAST(sum(content) AS DOUBLE), 4) AS content, CAST(sum(entries) AS BIGINT) AS entries FROM ({_H2}) GROUP BY 1")
def _project_y(spark, folder):
    return _rounded(h.project(_h2(spark, folder), "bin_y"))


@query(
    "profile_x",
    f"SELECT bin_x, round(CAST(sum(content) AS DOUBLE), 4) AS content, round(sum(content * c) / sum(content), 6) AS mean,"
    f" round(sqrt(greatest(0, sum(content * c * c) / sum(content) - pow(sum(content * c) / sum(content), 2))), 6) AS spread"
    f" FROM (SELECT *, (bin_y - 0.5) * {_QY.width} AS c FROM ({_H2}) WHERE bin_y BETWEEN 1 AND 20) GROUP BY 1",
)
def _profile_x(spark, folder):
    out = h.profile_x(_h2(spark, folder), _QY)
    return out.select("bin_x", F.round("content", 4).alias("content"), F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


@query(
    "slices",
    f"SELECT {bin_sql('l_quantity', h.Axis(25, 0.0, 50.0))} AS bin, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS spread,"
    " CAST(count(*) AS BIGINT) AS entries FROM lineitem GROUP BY 1",
)
def _slices(spark, folder):
    return _rounded(h.profile1d(table(spark, folder, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"), h.Axis(25, 0.0, 50.0)))


@query(
    "hist_of_hist",
    f"WITH a AS ({_H2}) SELECT {bin_sql('content', h.Axis(20, 0.0, 60.0))} AS bin, CAST(count(*) AS BIGINT) AS entries FROM a GROUP BY 1",
)
def _hist_of_hist(spark, folder):
    return h.content_distribution(_h2(spark, folder), h.Axis(20, 0.0, 60.0)).select("bin", "entries")


_EV = _dense_sql(64, "value", SCORE, "events")


def _dense(spark: SparkSession, folder: str) -> DataFrame:
    return h.dense(spark, h.hist1d(table(spark, folder, "events"), F.col("value"), SCORE), 64)


@query(
    "integral_hist",
    f"WITH d AS ({_EV}) SELECT bin, round(sum(content) OVER (ORDER BY bin DESC) / sum(content) OVER (), 6) AS total,"
    " round(sqrt(sum(content) OVER (ORDER BY bin DESC)) / sum(content) OVER (), 6) AS total_error FROM d",
)
def _integral_hist(spark, folder):
    return _rounded(h.integral(_dense(spark, folder), ascending=False, normalised=True), 6)


@query(
    "cum_eff",
    f"WITH d AS ({_EV}) SELECT bin, content, round(1 - coalesce(sum(content) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(content) OVER (), 6) AS efficiency FROM d",
)
def _cum_eff(spark, folder):
    return _rounded(h.efficiency_above(_dense(spark, folder)).select("bin", "content", "efficiency"), 6)


@query(
    "fwhm",
    f"WITH d AS ({_EV}), p AS (SELECT max(content) AS m FROM d), b AS (SELECT min(bin) AS peak_bin, max(m) AS m FROM d, p WHERE content = m)"
    f" SELECT peak_bin, round(CAST(coalesce((SELECT min(bin) - 1 FROM d WHERE bin >= peak_bin AND content < m / 2) * {SCORE.width}, 0)"
    f" - coalesce((SELECT max(bin) - 1 FROM d WHERE bin <= peak_bin AND content < m / 2) * {SCORE.width}, 0) AS DOUBLE), 6) AS fwhm FROM b",
)
def _fwhm(spark, folder):
    return _rounded(h.full_width_half_max(_dense(spark, folder), SCORE), 6)


_FISH = h.Axis(128, 0.0, 0.6)
_SIG = _dense_sql(128, "peak_value", _FISH, "flat WHERE mc_weight > 0", "weight")
_BACK = _dense_sql(128, "peak_value", _FISH, "flat WHERE NOT mc_weight > 0")


def _classes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    df = flat_events(spark, folder)
    signal = h.hist1d(df.filter(F.col("mc_weight") > 0), F.col("peak_value"), _FISH, F.col("weight"))
    background = h.hist1d(df.filter(~(F.col("mc_weight") > 0)), F.col("peak_value"), _FISH)
    return h.dense(spark, signal, 128), h.dense(spark, background, 128)


@query(
    "overlap_fom",
    f"{FLAT_SQL}, s AS ({_SIG}), b AS ({_BACK}), l AS (SELECT max(bin) AS last FROM b WHERE content > 0),"
    " r AS (SELECT max(last) AS last_background_bin, sum(CASE WHEN bin <= last THEN content ELSE 0 END) AS below, sum(CASE WHEN bin >= last THEN content ELSE 0 END) AS above FROM s, l)"
    " SELECT CAST(last_background_bin AS INT) AS last_background_bin, round(below, 4) AS below, round(above, 4) AS above, round(below / above, 4) AS merit FROM r",
)
def _overlap_fom(spark, folder):
    signal, background = _classes(spark, folder)
    return _rounded(h.overlap_merit(signal, background, 128))


@query(
    "threshold_pick",
    f"{FLAT_SQL}, s AS ({_SIG}), b AS ({_BACK}),"
    " eb AS (SELECT bin, 1 - coalesce(sum(content) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(content) OVER () AS e FROM b),"
    " es AS (SELECT bin, 1 - coalesce(sum(content) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(content) OVER () AS e FROM s),"
    " p AS (SELECT min(bin) AS k FROM eb WHERE e < 0.05 AND bin < 128)"
    f" SELECT round(CAST(max(k) * {_FISH.width} AS DOUBLE), 6) AS threshold, round(avg(e), 6) AS signal_efficiency FROM es, p WHERE bin BETWEEN k AND k + 1",
)
def _threshold_pick(spark, folder):
    signal, background = _classes(spark, folder)
    return _rounded(h.score_threshold(signal, background, _FISH, 0.05), 6)


@query(
    "outliers",
    f"WITH d AS ({_EV}), t AS (SELECT bin, sum(content) OVER (ORDER BY bin DESC) AS tail FROM d), l AS (SELECT (min(bin) - 1) * {SCORE.width} AS lim FROM t WHERE tail < 20)"
    " SELECT event_id, value FROM events, l WHERE value > lim",
)
def _outliers(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    return h.outliers(events, F.col("value"), _dense(spark, folder), SCORE, 20).select("event_id", "value")


_PARTS = ["peak_value", "coherent_filtered_impulsivityMeasure", "deconvolved_filtered_impulsivityMeasure"]
_CAX = h.Axis(30, 0.0, 0.6)


@query(
    "unpivot_hist",
    f"{FLAT_SQL}, u AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS component, {c} AS value, weight FROM flat" for c in _PARTS)
    + f") SELECT component, {bin_sql('value', _CAX)} AS bin, round(CAST(sum(weight) AS DOUBLE), 4) AS content, CAST(count(*) AS BIGINT) AS entries FROM u GROUP BY 1, 2",
)
def _unpivot_hist(spark, folder):
    """All component histograms from one scan."""
    long = unpivot(flat_events(spark, folder), ["weight"], _PARTS)
    return _rounded(h.hist1d(long, F.col("value"), _CAX, F.col("weight"), by=["component"]).drop("error"))


_TAIL = h.Axis(25, 0.0, 250.0)


@query(
    "tail_fit",
    f"WITH f AS (SELECT {bin_sql('value', _TAIL)} AS bin, count(*) * 1.0 AS content FROM events GROUP BY 1),"
    f" u AS (SELECT (bin - 0.5) * {_TAIL.width} AS x, ln(content) AS y, content FROM f WHERE bin BETWEEN 1 AND 25),"
    " r AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, count(*) AS bins FROM u)"
    " SELECT round(max(slope), 6) AS slope, round(max(intercept), 6) AS intercept, CAST(max(bins) AS BIGINT) AS bins,"
    " round(sum(pow(content - exp(intercept + slope * x), 2) / content) / (max(bins) - 2), 4) AS reduced_chi FROM u, r",
)
def _tail_fit(spark, folder):
    hist = h.hist1d(table(spark, folder, "events"), F.col("value"), _TAIL).filter(F.col("bin").between(1, 25))
    out = exponential_tail(hist, _TAIL.centre(F.col("bin")), _TAIL.width)
    return out.select(
        F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "bins", F.round("reduced_chi", 4).alias("reduced_chi")
    )


@query(
    "lsq_slope",
    "SELECT l_returnflag AS flag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1",
)
def _lsq_slope(spark, folder):
    return table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"),
        F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"),
    )


_PRICES = h.Axis(60, 0.0, 480_000.0)
_LIMIT = 250_000.0
_SCAN_SQL = (
    f"WITH f AS (SELECT o_orderpriority AS priority, {bin_sql('o_totalprice', _PRICES)} AS bin, count(*) * 1.0::DOUBLE AS content FROM orders GROUP BY 1, 2),"
    f" c AS (SELECT *, (bin - 0.5::DOUBLE) * {_PRICES.width} AS c FROM f WHERE bin BETWEEN 1 AND {_PRICES.bins}),"
    f" p AS (SELECT priority, bin, content, ln(content) AS y, m.model, CASE WHEN m.model = 'power' THEN ln(c) - ln({_LIMIT}) ELSE c - {_LIMIT} END AS x, CASE WHEN m.model = 'power' THEN ln({_LIMIT}) ELSE {_LIMIT} END AS o"
    " FROM c, (VALUES ('exponential'), ('power')) m(model)),"
    " s AS (SELECT priority, model, bin, o, count(*) OVER d AS bins, sum(content) OVER d AS s0, sum(content * x) OVER d AS sx, sum(content * y) OVER d AS sy, sum(content * x * x) OVER d AS sxx,"
    " sum(content * x * y) OVER d AS sxy, sum(content * y * y) OVER d AS syy FROM p WINDOW d AS (PARTITION BY priority, model ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)),"
    " l AS (SELECT *, CASE WHEN bins >= 2 THEN (s0 * sxy - sx * sy) / nullif(s0 * sxx - sx * sx, 0) END AS slope FROM s), a AS (SELECT *, (sy - slope * sx) / s0 AS v FROM l),"
    " r AS (SELECT *, CASE WHEN bins >= 3 THEN greatest(syy - v * sy - slope * sxy, 0) / (bins - 2) END AS chi FROM a),"
    f" e AS (SELECT priority, model, CAST((bin - 1) * {_PRICES.width} AS DOUBLE) AS start, CAST(bins AS BIGINT) AS bins, slope, v - slope * o AS intercept, chi, coalesce(chi < 1.5, false) AS good, exp(v) AS at_threshold,"
    f" CASE WHEN model = 'power' THEN CASE WHEN slope < -1 THEN exp(v) * {_LIMIT} / (-slope - 1) END ELSE CASE WHEN slope < 0 THEN exp(v) / -slope END END / {_PRICES.width} AS above FROM r)"
)


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    hist = h.hist1d(table(spark, folder, "orders"), F.col("o_totalprice"), _PRICES, by=["o_orderpriority"]).withColumnRenamed("o_orderpriority", "priority")
    return tail_scan(hist, _PRICES, _LIMIT, ["priority"])


@query(
    "tail_scan",
    _SCAN_SQL + " SELECT priority, model, start, bins, round(slope * 1000, 5) AS slope, round(intercept, 5) AS intercept, round(chi, 5) AS reduced_chi, round(at_threshold, 4) AS at_threshold, round(above, 3) AS above FROM e WHERE bins >= 4",
)
def _tail_scan(spark, folder):
    """Exponential and power-law tail of order prices from every start bin of at least four non-empty bins, per priority."""
    out = _scan(spark, folder).filter("bins >= 4")
    return out.select(
        "priority", "model", "start", "bins", F.round(F.col("slope") * 1000, 5).alias("slope"), F.round("intercept", 5).alias("intercept"),
        F.round("reduced_chi", 5).alias("reduced_chi"), F.round("at_threshold", 4).alias("at_threshold"), F.round("above", 3).alias("above"),
    )


@query(
    "tail_estimates",
    _SCAN_SQL + " SELECT priority, model, count(*) AS fits, round(avg(above), 3) AS mean, round(stddev_pop(above), 3) AS spread, round(min(above), 3) AS lowest, round(max(above), 3) AS highest"
    " FROM e WHERE bins >= 4 AND good AND above IS NOT NULL GROUP BY 1, 2",
)
def _tail_estimates(spark, folder):
    """Entries expected above the threshold, over all starts with a good fit."""
    found = tail_estimates(_scan(spark, folder).filter("bins >= 4"), ["priority"])
    return found.select("priority", "model", "fits", *[F.round(c, 3).alias(c) for c in ("mean", "spread", "lowest", "highest")])


@query("slice_fit")
def _slice_fit(spark, folder):
    """Gaussian of the price distribution in each slice of quantity."""
    x, y = h.Axis(25, 0.0, 50.0), h.Axis(120, 0.0, 120_000.0)
    hist = h.hist2d(table(spark, folder, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"), x, y)
    return fit_slices(hist, y).select("bin_x", "bins", *[F.round(c, 4).alias(c) for c in ("height", "mean", "width", "reduced_chi")], "converged")
