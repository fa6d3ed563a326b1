"""Raw waveforms to nested event summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from firn.functions import spectral, waveform
from firn.operators import imaging
from firn.session import materialize

# Power fractions whose narrowest windows are stored.
FRACTIONS = (0.1, 0.2, 0.3, 0.4, 0.5)
# Notch bands in GHz of the brick-wall option.
BRICK_WALL = ((0.23, 0.29), (0.34, 0.40))
MOMENTS = 5

Filter = Callable[[Column, int, float], Column]


def no_filter(y: Column, samples: int, dt: float) -> Column:
    return y


def sine_filter(y: Column, samples: int, dt: float) -> Column:
    return spectral.sine_subtract(y)


def brick_wall(y: Column, samples: int, dt: float) -> Column:
    f = spectral.forward(y)
    for low, high in BRICK_WALL:
        f = spectral.notch(f, samples, dt, low, high)
    return spectral.inverse(f, samples)


# Filter strategies by name, each a chain applied in order.
STRATEGIES: dict[str, tuple[Filter, ...]] = {
    "none": (no_filter,),
    "sine_subtract": (sine_filter,),
    "sine_subtract_brick_wall": (sine_filter, brick_wall),
}


def filtered(channels: DataFrame, strategy: str, samples: int, dt: float) -> DataFrame:
    for step in STRATEGIES[strategy]:
        channels = channels.withColumn("y", step(F.col("y"), samples, dt))
    return channels


def waveform_info(waves: DataFrame, wave: str, noise: Column, dt: float, samples: int, keep: Sequence[str]) -> DataFrame:
    """Features of one summed waveform per row: ``keep`` and a struct ``info``."""
    x = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: i * F.lit(dt))
    base = waves.select(*keep, F.col(wave).alias("_y"), x.alias("_x"), noise.cast("double").alias("_noise")).withColumns(
        {
            "_env": spectral.hilbert_envelope(F.col("_y")),
            "_psd": spectral.power_spectrum(F.col("_y"), dt, "sum"),
            **{f"_w{k}": spectral.narrowest_window(F.col("_x"), F.col("_y"), f) for k, f in enumerate(FRACTIONS)},
        }
    )
    y, env = F.col("_y"), F.col("_env")
    swing = waveform.largest_swing(waveform.extrema(F.col("_x"), y))["swing"]
    squares = F.transform(y, lambda v: v * v)
    timed = base.withColumns(
        {
            "_imp": spectral.impulsivity(env),
            "_swing": swing,
            "_peak_time": waveform.first_max_index(env) * F.lit(dt),
            "_power": waveform.total(squares),
            "_tops": waveform.spectral_peaks(F.col("_psd"), 1.0 / (samples * dt), 3),
        }
    )

    def moment(k: int) -> Column:
        weighted = F.zip_with(F.col("_x"), squares, lambda t, p: F.pow(t - F.col("_peak_time"), F.lit(float(k))) * p)
        return F.try_divide(waveform.total(weighted), F.col("_power"))

    info = F.struct(
        F.try_divide(F.col("_swing"), 2 * F.col("_noise")).alias("snr"),
        F.array_max("_env").alias("peakHilbert"),
        F.array_max("_y").alias("peakVal"),
        F.col("_peak_time").alias("peakTime"),
        F.col("_imp").alias("impulsivityMeasure"),
        F.col("_power").alias("totalPower"),
        F.array(*[F.col(f"_w{k}.begin") for k in range(len(FRACTIONS))]).alias("fracPowerWindowBegins"),
        F.array(*[F.col(f"_w{k}.end") for k in range(len(FRACTIONS))]).alias("fracPowerWindowEnds"),
        F.array(*[moment(k) for k in range(1, MOMENTS + 1)]).alias("peakMoments"),
        F.transform("_tops", lambda p: p["power"]).alias("peakPower"),
        F.transform("_tops", lambda p: p["frequency"]).alias("peakFrequency"),
    )
    return timed.select(*keep, info.alias("info"))


def summarise(
    channels: DataFrame, geometry: DataFrame, event: Sequence[str], dt: float, samples: int, strategy: str = "none",
    peaks: int = 3, phi_bins: int = imaging.COARSE_PHI_BINS, theta_bins: int = imaging.COARSE_THETA_BINS,
    zoom_bins: int = imaging.ZOOM_BINS, upsample: int = 6,
) -> DataFrame:
    """One nested summary per event: ``peak`` and ``coherent_filtered`` arrays in rank order.

    Filter, correlate pairs, coarse map, greedy peaks, fine map and vertex, coherent sum,
    features. Every step is keyed by the event, whose rows are bounded by the array.
    """
    clean = materialize(filtered(channels, strategy, samples, dt), "filtered")
    pairs = imaging.antenna_pairs(geometry)
    phi_edges = [360.0 * k / phi_bins - 180.0 / imaging.SECTORS for k in range(phi_bins)]
    theta_edges = imaging.coarse_theta_edges(theta_bins)[:theta_bins]
    searched = imaging.event_peaks(clean.select(*event, "ant", "y"), geometry, event, dt, phi_edges, theta_edges, peaks)
    rough = searched.select(*event, F.posexplode("peaks").alias("rank", "p"))
    rough = materialize(rough.select(*event, "rank", F.col("p.value").alias("rough_value"), "p.phi", "p.theta"), "rough")
    fine = imaging.zoom_map(
        imaging.correlations(clean, pairs, event, upsample), geometry, rough, event, dt / upsample, bins=zoom_bins, peak=["rank"]
    )
    vertex = imaging.map_rows(fine, [*event, "rank"], zoom_bins, zoom_bins).select(
        *event, "rank", imaging.quadratic_peak(F.col("map"), zoom_bins, zoom_bins).alias("q")
    )
    half = zoom_bins // 2 * imaging.ZOOM_STEP
    found = rough.join(vertex, [*event, "rank"]).select(
        *event, "rank", F.col("q.value").alias("value"), (F.col("phi") + F.col("q.d_phi") - half).alias("phi"),
        (F.col("theta") + F.col("q.d_theta") - half).alias("theta"), F.col("q.chisq").alias("chisq"),
        (F.col("q.d_phi") - half).alias("dphi_rough"), (F.col("q.d_theta") - half).alias("dtheta_rough"),
    )
    found = materialize(found, "found")
    summed = imaging.coherent_sum(clean, geometry, found, event, dt, samples, peak=["rank"])
    noise = clean.groupBy(*event).agg(F.avg(waveform.rms(F.col("y"))).alias("noise"))
    info = waveform_info(summed.join(noise, list(event)), "wave", F.col("noise"), dt, samples, [*event, "rank"])
    fields = [c for c in found.columns if c not in (*event, "rank")]
    rows = found.join(info, [*event, "rank"]).select(*event, "rank", F.struct(*fields).alias("peak"), F.col("info").alias("wave"))
    # At most ``peaks`` rows per event.
    packed = F.array_sort(F.collect_list(F.struct("rank", "peak", "wave")))
    return rows.groupBy(*event).agg(packed.alias("_r")).select(
        *event, F.size("_r").alias("nPeaks"), F.transform("_r", lambda r: r["peak"]).alias("peak"), F.transform("_r", lambda r: r["wave"]).alias("coherent_filtered")
    )
