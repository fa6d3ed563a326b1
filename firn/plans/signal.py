"""Waveform queries over ``embeddings``: each 64-number vector is one sampled waveform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from firn.functions import spectral, waveform
from firn.operators import imaging, quality
from firn.operators.summary import summarise
from firn.plans.registry import query, table
from firn.session import materialize

N = 64
DT = 0.5
RING = 16


def waves(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, y (doubles), x (times)."""
    y = F.transform("embedding", lambda v: v.cast("double"))
    x = F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: i * DT)
    return table(spark, folder, "embeddings").select("vec_id", y.alias("y"), x.alias("x"))


def channels(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen consecutive waveforms make one event on a single ring of antennas."""
    return waves(spark, folder).select(
        F.floor(F.col("vec_id") / RING).alias("event"), (F.col("vec_id") % RING).cast("int").alias("ant"), "y"
    )


def ring_geometry(spark: SparkSession) -> DataFrame:
    """Sixteen antennas on a ring of 2 m, alternating in height."""
    return spark.range(RING).select(
        F.col("id").cast("int").alias("ant"), F.lit(2.0).alias("r"), (F.col("id") % 2 * 0.5).alias("z"), (F.col("id") * 22.5).alias("phi")
    )


W_SQL = "s AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) AS r(i))"
_DFT = (
    f"{W_SQL}, f AS (SELECT vec_id, k, sum(v * cos(2 * pi() * k * i / 64)) AS re, sum(-v * sin(2 * pi() * k * i / 64)) AS im FROM s, range(0, 33) AS q(k) GROUP BY 1, 2),"
    " p AS (SELECT *, (CASE WHEN k = 0 OR k = 32 THEN 1 ELSE 2 END) * (re * re + im * im) AS fold FROM f)"
)


def _long(df: DataFrame, array: Column, index: str, value: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias(index, value))


@query("dft_power", f"WITH {_DFT} SELECT vec_id, CAST(k AS INT) AS k, round(fold / 64, 8) AS power FROM p")
def _dft_power(spark, folder):
    """Power spectrum whose sum is the sum of squares."""
    df = waves(spark, folder).select("vec_id", spectral.power_spectrum(F.col("y")).alias("p"))
    return _long(df, F.col("p"), "k", "power", "vec_id").withColumn("power", F.round("power", 8))


@query(
    "power_norms",
    f"WITH {_DFT} SELECT vec_id, round(sum(fold) / 64 / 64, 8) AS average, round(sum(fold) * 0.5 / 64, 8) AS time_integral, round(sum(fold) * 0.25, 6) AS density,"
    " round(sum(fold) * 0.25 / 50, 8) AS density_50_ohm FROM p GROUP BY 1",
)
def _power_norms(spark, folder):
    """Total of each of the other four normalisations."""
    names = ["average", "time_integral", "density", "density_50_ohm"]
    df = waves(spark, folder).select("vec_id", *[spectral.power_spectrum(F.col("y"), DT, n).alias(n) for n in names])
    return df.select("vec_id", *[F.round(waveform.total(F.col(n)), 6 if n == "density" else 8).alias(n) for n in names])


@query(
    "fft_round_trip",
    "SELECT vec_id, true AS same, CAST(33 AS INT) AS bins FROM embeddings",
)
def _fft_round_trip(spark, folder):
    df = waves(spark, folder).select("vec_id", "y", spectral.forward(F.col("y")).alias("f"))
    back = df.select("vec_id", "y", F.size("f.re").alias("bins"), spectral.inverse(F.col("f"), N).alias("b"))
    gap = F.array_max(F.zip_with("y", "b", lambda a, b: F.abs(a - b)))
    return back.select("vec_id", (gap < 1e-12).alias("same"), "bins")


@query(
    "xcorr",
    f"WITH {W_SQL} SELECT a.vec_id, CAST(l AS INT) AS lag, round(sum(a.v * b.v) / 64, 8) AS corr FROM s a, range(0, 64) AS q(l), s b"
    " WHERE b.vec_id = CASE WHEN a.vec_id % 2 = 0 THEN a.vec_id + 1 ELSE a.vec_id - 1 END AND b.i = (a.i - l + 64) % 64 GROUP BY 1, 2",
)
def _xcorr(spark, folder):
    """Circular cross-correlation of each waveform with its partner."""
    w = waves(spark, folder).select("vec_id", "y")
    partner = w.select(F.when(F.col("vec_id") % 2 == 0, F.col("vec_id") + 1).otherwise(F.col("vec_id") - 1).alias("vec_id"), F.col("y").alias("other"))
    df = w.join(partner, "vec_id").select("vec_id", spectral.cross_correlate(F.col("y"), F.col("other")).alias("c"))
    return _long(df, F.col("c"), "lag", "corr", "vec_id").withColumn("corr", F.round("corr", 8))


@query(
    "xcorr_peak",
    f"WITH {W_SQL}, c AS (SELECT a.vec_id, l, sum(a.v * b.v) / 64 AS c FROM s a, range(0, 64) AS q(l), s b"
    " WHERE b.vec_id = CASE WHEN a.vec_id % 2 = 0 THEN a.vec_id + 1 ELSE a.vec_id - 1 END AND b.i = (a.i - l + 64) % 64 GROUP BY 1, 2),"
    " p AS (SELECT vec_id, arg_max(l, c) AS l, max(c) AS peak FROM c GROUP BY 1) SELECT vec_id, round(peak, 8) AS peak, CASE WHEN l >= 32 THEN l - 64 ELSE l END * 0.5::DOUBLE AS lag FROM p",
)
def _xcorr_peak(spark, folder):
    """Lag and size of the largest correlation with the partner."""
    w = waves(spark, folder).select("vec_id", "y")
    partner = w.select(F.when(F.col("vec_id") % 2 == 0, F.col("vec_id") + 1).otherwise(F.col("vec_id") - 1).alias("vec_id"), F.col("y").alias("other"))
    df = w.join(partner, "vec_id").select("vec_id", spectral.cross_correlate(F.col("y"), F.col("other")).alias("c"))
    return df.select("vec_id", F.round(F.array_max("c"), 8).alias("peak"), waveform.lag_of_max(F.col("c"), DT).alias("lag"))


@query(
    "notch_filter",
    f"WITH {_DFT} SELECT vec_id, round(sum(CASE WHEN k / 32.0 >= 0.23 AND k / 32.0 < 0.29 THEN re * re + im * im ELSE 0 END) / sum(re * re + im * im), 8) AS removed,"
    " round(sum(CASE WHEN k / 32.0 >= 0.23 AND k / 32.0 < 0.29 THEN 0 ELSE fold END) / 64, 8) AS power FROM p GROUP BY 1",
)
def _notch(spark, folder):
    """Remove 0.23 <= f < 0.29; fraction removed, and the power of the filtered waveform."""
    df = waves(spark, folder).select("vec_id", spectral.notch(spectral.forward(F.col("y")), N, DT, 0.23, 0.29).alias("f"))
    back = df.select("vec_id", "f.removed", spectral.inverse(F.col("f"), N).alias("y"))
    squares = waveform.total(F.transform("y", lambda v: v * v))
    return back.select("vec_id", F.round("removed", 8).alias("removed"), F.round(squares, 8).alias("power"))


@query(
    "spectral_slope",
    f"WITH {_DFT} SELECT vec_id, round(regr_slope(10 * log10(fold / 64), k / 32.0), 6) AS slope, round(regr_intercept(10 * log10(fold / 64), k / 32.0), 6) AS intercept FROM p WHERE k >= 6 AND k < 30 GROUP BY 1",
)
def _spectral_slope(spark, folder):
    """Least-squares slope of the spectrum in dB between two frequencies."""
    df = waves(spark, folder).select("vec_id", spectral.power_spectrum(F.col("y")).alias("p"))
    rows = _long(df, F.col("p"), "k", "p", "vec_id").filter((F.col("k") >= 6) & (F.col("k") < 30))
    db, f = 10 * F.log10("p"), F.col("k") / 32.0
    return rows.groupBy("vec_id").agg(F.round(F.regr_slope(db, f), 6).alias("slope"), F.round(F.regr_intercept(db, f), 6).alias("intercept"))


@query(
    "topk_per_group",
    f"WITH {_DFT}, n AS (SELECT *, lag(fold) OVER w AS a, lead(fold) OVER w AS b FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY k)),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY fold DESC) AS rank FROM n WHERE fold > a AND fold > b)"
    " SELECT vec_id, CAST(rank AS INT) AS rank, round(fold / 64, 8) AS power, k / 32.0::DOUBLE AS frequency FROM r WHERE rank <= 3",
)
def _topk(spark, folder):
    """Three largest local maxima of each spectrum."""
    df = waves(spark, folder).select("vec_id", spectral.power_spectrum(F.col("y")).alias("p"))
    top = df.select("vec_id", F.posexplode(waveform.spectral_peaks(F.col("p"), 1 / 32.0, 3)).alias("r", "e"))
    return top.filter(F.col("e.power") > 0).select(
        "vec_id", (F.col("r") + 1).alias("rank"), F.round("e.power", 8).alias("power"), F.col("e.frequency").alias("frequency")
    )


@query(
    "wave_features",
    f"WITH {W_SQL}, l AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY i)),"
    " x AS (SELECT vec_id, i, v, lead(v) OVER (PARTITION BY vec_id ORDER BY i) AS nv FROM l WHERE (p > v AND v < n) OR (p < v AND v > n)),"
    " q AS (SELECT vec_id, max(abs(v - nv)) AS swing FROM x WHERE nv IS NOT NULL GROUP BY 1)"
    " SELECT s.vec_id, round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS rms, CAST(arg_max(i, v) AS BIGINT) AS max_at, CAST(arg_min(i, v) AS BIGINT) AS min_at,"
    " round(sum(CASE WHEN i < 63 THEN v * v * 0.5 ELSE 0 END), 8) AS power, round(max(swing), 8) AS swing, round(max(swing) / (2 * stddev_pop(v)), 6) AS snr FROM s JOIN q ON q.vec_id = s.vec_id GROUP BY 1",
)
def _wave_features(spark, folder):
    """Moments, extremes, power and largest swing of every waveform, row by row in the JVM."""
    w = waves(spark, folder)
    y, x = F.col("y"), F.col("x")
    swing = waveform.largest_swing(waveform.extrema(x, y))["swing"]
    return w.select(
        "vec_id", F.round(waveform.mean(y), 8).alias("mean"), F.round(waveform.rms(y), 8).alias("rms"), waveform.first_max_index(y).alias("max_at"),
        waveform.first_min_index(y).alias("min_at"), F.round(waveform.integrated_power(x, y), 8).alias("power"), F.round(swing, 8).alias("swing"),
        F.round(F.try_divide(swing, 2 * waveform.rms(y)), 6).alias("snr"),
    )


@query(
    "wave_derivative",
    f"WITH {W_SQL} SELECT vec_id, CAST(i AS INT) AS i, round((n - v) / 0.5, 8) AS slope FROM (SELECT *, lead(v) OVER (PARTITION BY vec_id ORDER BY i) AS n FROM s) WHERE n IS NOT NULL",
)
def _wave_derivative(spark, folder):
    df = waves(spark, folder).select("vec_id", waveform.derivative(F.col("x"), F.col("y")).alias("d"))
    return _long(df, F.col("d"), "i", "slope", "vec_id").withColumn("slope", F.round("slope", 8))


@query(
    "wave_shapes",
    "SELECT vec_id, CAST(128 AS INT) AS padded, embedding[33]::DOUBLE AS first_of_split, embedding[32]::DOUBLE AS last_of_split,"
    " round((embedding[1]::DOUBLE - list_avg(embedding::DOUBLE[])) / list_stddev_pop(embedding::DOUBLE[]), 6) AS first_normalised, CAST(len(list_filter(embedding, lambda v: v >= 0.1::FLOAT AND v <= 0.2::FLOAT)) AS INT) AS between FROM embeddings",
)
def _wave_shapes(spark, folder):
    """Zero padding, negative-lag-first reordering, normalisation and range limits."""
    w = waves(spark, folder).withColumns({"m": waveform.mean(F.col("y")), "s": waveform.rms(F.col("y"))})
    split = waveform.split_correlation(F.col("y"))
    low, high = F.lit(0.1).cast("float").cast("double"), F.lit(0.2).cast("float").cast("double")
    return w.select(
        "vec_id", F.size(waveform.zero_pad(F.col("y"), waveform.next_power_of_two(F.size("y") + 1))).alias("padded"),
        split[0].alias("first_of_split"), split[N - 1].alias("last_of_split"),
        F.round(waveform.normalised(F.col("y"), F.col("m"), F.col("s"))[0], 6).alias("first_normalised"),
        F.size(waveform.within(F.col("y"), F.col("y"), low, high)).alias("between"),
    )


@query(
    "frac_power_window",
    f"WITH {W_SQL}, c AS (SELECT vec_id, i, coalesce(sum(v * v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM s),"
    " t AS (SELECT vec_id, max(c) AS total FROM c GROUP BY 1),"
    " w AS (SELECT a.vec_id, a.i AS b, min(e.i) AS e FROM c a JOIN t ON t.vec_id = a.vec_id JOIN c e ON e.vec_id = a.vec_id AND e.i > a.i AND e.c >= a.c + 0.5 * total GROUP BY 1, 2)"
    " SELECT vec_id, round(min(e - b) * 0.5::DOUBLE, 4) AS width FROM w GROUP BY 1",
)
def _frac_power_window(spark, folder):
    """Shortest window holding half the power."""
    df = waves(spark, folder).select("vec_id", spectral.narrowest_window(F.col("x"), F.col("y"), 0.5).alias("w"))
    return df.select("vec_id", F.round(F.col("w.end") - F.col("w.begin"), 4).alias("width"))


_BANDS = "(SELECT vec_id, sum(CASE WHEN k / 32.0 >= 0.15 AND k / 32.0 < 0.25 THEN fold / 64 ELSE 0 END) / 32 AS p FROM p GROUP BY 1)"


@query(
    "band_power",
    f"WITH {_DFT}, c AS (SELECT vec_id // 12 AS event, (vec_id % 12) % 2 AS pol, (vec_id % 12) // 2 % 3 AS ring, (vec_id % 12) // 6 AS sector, p FROM {_BANDS}),"
    " b AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY p DESC) AS rn FROM c WHERE ring > 0)"
    " SELECT b.event, round(b.p, 9) AS low_power, CAST(b.pol AS INT) AS pol, CAST(b.sector AS INT) AS sector, CAST(b.ring AS INT) AS low_ring, round(t.p, 9) AS top_power"
    " FROM b LEFT JOIN c t ON t.event = b.event AND t.pol = b.pol AND t.sector = b.sector AND t.ring = 0 WHERE rn = 1",
)
def _band_power(spark, folder):
    """Loudest lower channel in 0.15-0.25 GHz and the top channel of its sector; 12 channels an event."""
    w = waves(spark, folder).select("vec_id", spectral.power_spectrum(F.col("y")).alias("p"))
    c = F.col("vec_id") % 12
    rows = w.select(
        F.floor(F.col("vec_id") / 12).alias("event"), (c % 2).cast("int").alias("pol"), (F.floor(c / 2) % 3).cast("int").alias("ring"),
        F.floor(c / 6).cast("int").alias("sector"), quality.band_power(F.col("p"), 1 / 32.0, 0.15, 0.25).alias("band"),
    )
    rows = materialize(rows, "bands")
    out = quality.loudest_channel(rows, "event", F.col("band"))
    return out.select("event", F.round("low_power", 9).alias("low_power"), "pol", "sector", "low_ring", F.round("top_power", 9).alias("top_power"))


_PHI_BINS, _THETA_BINS = imaging.COARSE_PHI_BINS, imaging.COARSE_THETA_BINS
_THETA = imaging.coarse_theta_edges()
_GEO = "g AS (SELECT a AS ant, 2.0 AS r, a % 2 * 0.5 AS z, a * 22.5 AS phi FROM range(0, 16) AS q(a))"
_ARRIVE = "cos(radians(th)) * (-{0}.z * tan(radians(th)) - {0}.r * cos(radians(ph - {0}.phi))) * 1e9 / 299792458.0"
_MAP_SQL = (
    f"WITH {W_SQL}, {_GEO}, d AS (SELECT c.*, pb * 2.5 - 11.25 AS ph, [{', '.join(f'{t!r}::DOUBLE' for t in _THETA[:-1])}][CAST(tb AS INT) + 1] AS th FROM (SELECT pb, tb, pb // 9 AS sec FROM range(0, {_PHI_BINS}) AS p(pb), range(0, {_THETA_BINS}) AS t(tb)) c),"
    f" pr AS (SELECT x.ant AS a, y.ant AS b, pb, tb, ({_ARRIVE.format('y')}) - ({_ARRIVE.format('x')}) AS delay FROM g x, g y, d WHERE x.ant < y.ant"
    " AND least(abs(x.ant - y.ant), 16 - abs(x.ant - y.ant)) <= 2 AND least(abs(x.ant - sec), 16 - abs(x.ant - sec)) <= 2 AND least(abs(y.ant - sec), 16 - abs(y.ant - sec)) <= 2),"
    " ab AS (SELECT DISTINCT a, b FROM pr),"
    " co AS MATERIALIZED (SELECT u.vec_id // 16 AS event, ab.a, ab.b, l, sum(u.v * w.v) / 64 AS c FROM ab, range(0, 64) AS q(l), s u, s w"
    " WHERE u.vec_id % 16 = ab.a AND w.vec_id = u.vec_id - ab.a + ab.b AND w.i = (u.i - l + 64) % 64 GROUP BY 1, 2, 3, 4),"
    " lk AS (SELECT *, CAST(floor(delay / 0.5) AS BIGINT) AS lo, delay / 0.5 - floor(delay / 0.5) AS fr FROM pr),"
    " m AS (SELECT c1.event, lk.pb, lk.tb, avg(c1.c + fr * (c2.c - c1.c)) AS value FROM lk JOIN co c1 ON c1.a = lk.a AND c1.b = lk.b AND c1.l = ((lo % 64) + 64) % 64"
    " JOIN co c2 ON c2.event = c1.event AND c2.a = lk.a AND c2.b = lk.b AND c2.l = (((lo + 1) % 64) + 64) % 64 GROUP BY 1, 2, 3)"
)


def _maps(spark: SparkSession, folder: str) -> DataFrame:
    return imaging.event_maps(channels(spark, folder), ring_geometry(spark), ["event"], DT)


@query("coarse_map", f"{_MAP_SQL} SELECT event, CAST(pb AS INT) AS phi_bin, CAST(tb AS INT) AS theta_bin, round(value, 8) + 0.0 AS value FROM m")
def _coarse_map(spark, folder):
    """Mean interpolated correlation of the antenna pairs facing each direction."""
    cells = _maps(spark, folder).select("event", F.posexplode("map").alias("cell", "value")).filter("value is not null")
    phi, theta = F.floor(F.col("cell") / _THETA_BINS), F.col("cell") % _THETA_BINS
    return cells.select("event", phi.cast("int").alias("phi_bin"), theta.cast("int").alias("theta_bin"), (F.round("value", 8) + 0.0).alias("value"))


def _peaks(spark: SparkSession, folder: str) -> DataFrame:
    edges = [k * 360.0 / _PHI_BINS - 180.0 / imaging.SECTORS for k in range(_PHI_BINS)]
    return imaging.event_peaks(channels(spark, folder), ring_geometry(spark), ["event"], DT, edges, _THETA[:-1], 3)


@query("nms_topk")
def _nms_topk(spark, folder):
    """Three greedy peaks per map with a blanked box around each."""
    return _peaks(spark, folder).select("event", F.posexplode("peaks").alias("rank", "p")).select("event", "rank", "p.*")


@query("zoom_peak")
def _zoom_peak(spark, folder):
    """Fine map around the best coarse peak, and its quadratic vertex."""
    geometry = ring_geometry(spark)
    best = _peaks(spark, folder).select("event", F.get("peaks", F.lit(0)).alias("p")).select("event", "p.phi", "p.theta")
    best = materialize(best.filter(F.col("phi").isNotNull()), "best")
    corr = imaging.correlations(channels(spark, folder), imaging.antenna_pairs(geometry), ["event"], upsample=6)
    fine = imaging.zoom_map(corr, geometry, best, ["event"], DT / 6, bins=20)
    rows = imaging.map_rows(fine, ["event"], 20, 20)
    return rows.select("event", imaging.quadratic_peak(F.col("map"), 20, 20).alias("q")).select("event", "q.*")


@query("coherent_sum")
def _coherent_sum(spark, folder):
    """Channels facing the best peak, delayed and averaged; features of the sum."""
    best = _peaks(spark, folder).select("event", F.get("peaks", F.lit(0)).alias("p")).select("event", "p.phi", "p.theta")
    best = materialize(best.filter(F.col("phi").isNotNull()), "best")
    summed = imaging.coherent_sum(channels(spark, folder), ring_geometry(spark), best, ["event"], DT, N)
    env = summed.withColumn("envelope", spectral.hilbert_envelope(F.col("wave")))
    return env.select("event", "channels", F.array_max("envelope").alias("peak_hilbert"), spectral.impulsivity(F.col("envelope")).alias("impulsivity"))


@query("spectral_filter")
def _spectral_filter(spark, folder):
    """Sine subtraction, then two notches; power before and after."""
    clean = waves(spark, folder).select("vec_id", "y", spectral.sine_subtract(F.col("y")).alias("c"))
    first = spectral.notch(spectral.forward(F.col("c")), N, DT, 0.23, 0.29)
    once = clean.withColumn("f", first)
    twice = once.withColumn("g", spectral.notch(F.col("f"), N, DT, 0.34, 0.40))
    back = twice.withColumn("b", spectral.inverse(F.col("g"), N))

    def power(name: str) -> Column:
        return waveform.total(F.transform(name, lambda v: v * v))

    return back.select("vec_id", power("y").alias("raw"), power("c").alias("subtracted"), power("b").alias("filtered"))


@query("envelope_stokes")
def _envelope_stokes(spark, folder):
    """Stokes parameters of each even waveform with the following odd one."""
    w = waves(spark, folder).select("vec_id", "y")
    v = w.filter(F.col("vec_id") % 2 == 1).select((F.col("vec_id") - 1).alias("vec_id"), F.col("y").alias("v"))
    return w.join(v, "vec_id").select("vec_id", spectral.stokes(F.col("y"), F.col("v")).alias("s")).select("vec_id", "s.*")


@query("resample")
def _resample(spark, folder):
    """Linear and Akima resampling, spectral upsampling, and the smooth background of the spectrum."""
    w = waves(spark, folder)
    made = w.select(
        "vec_id", spectral.resample_linear(F.col("x"), F.col("y"), 0.2).alias("linear"), spectral.resample_akima(F.col("x"), F.col("y"), 1.0, 0.2, 100).alias("akima"),
        spectral.clipped_background(spectral.power_spectrum(F.col("y"))).alias("background"), spectral.forward(F.col("y")).alias("f"),
    )
    fine = spectral.inverse(spectral.zero_pad_spectrum(F.col("f"), N, 4 * N), 4 * N)
    return made.select(
        "vec_id", F.size("linear").alias("linear_samples"), F.array_max("akima").alias("akima_max"), waveform.total(F.col("background")).alias("background"), fine[0].alias("first_fine")
    )


@query("template_match")
def _template_match(spark, folder):
    """Correlation of every waveform with one decaying sine template."""
    template = [float(2.718281828 ** (-i / 8)) * (1 if i % 4 < 2 else -1) for i in range(N)]
    df = waves(spark, folder).select("vec_id", spectral.template_peak(F.col("y"), template).alias("t"))
    return df.select("vec_id", "t.*")


@query("whitened")
def _whitened(spark, folder):
    """Spectra set to unit magnitude, and normalised to unit RMS."""
    df = waves(spark, folder).select("vec_id", spectral.forward(F.col("y")).alias("f"))
    flat = spectral.inverse(spectral.set_magnitude(F.col("f")), N)
    unit = spectral.inverse(spectral.normalise_spectrum(F.col("f"), N), N)
    made = df.select("vec_id", flat.alias("flat"), unit.alias("unit"))
    return made.select("vec_id", waveform.rms(F.col("flat")).alias("flat_rms"), waveform.rms(F.col("unit")).alias("unit_rms"))


@query("event_summaries")
def _event_summaries(spark, folder):
    """Raw waveforms to nested summaries: filters, maps, peaks, coherent sums, features."""
    made = summarise(
        channels(spark, folder), ring_geometry(spark), ["event"], DT, N, "sine_subtract_brick_wall"
    )
    each = made.select("event", "nPeaks", F.posexplode(F.arrays_zip(F.col("peak").alias("p"), F.col("coherent_filtered").alias("w"))).alias("rank", "_e"))
    return each.select("event", "nPeaks", "rank", "_e.*").select("event", "nPeaks", "rank", "p.value", "p.phi", "p.theta", "w.snr", "w.peakHilbert", "w.impulsivityMeasure", "w.totalPower")
