"""Discriminant, resolution, Rayleigh and pair-distance expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from firn.functions.angles import delta_angle
from firn.functions.compare import col

# Angular resolution parameters per flight model, (p0, p1, p2).
RESOLUTION = {
    3: {"phi": (-2.50414e-01, 3.02406e-01, 2.43376e-01), "theta": (-3.83773e-01, -3.00964e-01, 1.64537e-01)},
    4: {"phi": (5.09057, 8.01369e-01, 1.0), "theta": (1.34307, 7.09382e-01, 1.0)},
}

# Intercept, then (weight, expression) of the trained score.
SCORE_INTERCEPT = 0.898497
SCORE_TERMS = [
    (1.929594, "coherent_filtered_fracPowerWindowGradient/deconvolved_filtered_fracPowerWindowGradient"),
    (-0.195909, "deconvolved_filtered_fracPowerWindowGradient"),
    (5.943355, "coherent_filtered_impulsivityMeasure"),
    (0.826114, "deconvolved_filtered_impulsivityMeasure"),
    (0.021763, "coherent_filtered_peakHilbert"),
    (-0.012670, "deconvolved_filtered_peakHilbert"),
    (-0.394201, "peak_value"),
]
SCORE_THRESHOLD = 5.800012

HORIZON_M = 750e3
SURFACE_SEPARATION_KM = 30.0
# Likelihood thresholds evaluated together.
LL_THRESHOLDS = [1, 2, 4, 6, 8, 10, 12, 15, 20, 40, 70, 100]


def event_weight(mc_weight) -> Column:
    """Simulated rows keep their weight, data rows (0) count one, negatives count nothing."""
    w = col(mc_weight)
    return F.when(w > 0, w).when(w == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def safe_ratio(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def term(expression: str) -> Column:
    """A score term: a column, or the ratio of two columns (NULL on division by zero)."""
    top, _, bottom = expression.partition("/")
    return safe_ratio(F.col(top), F.col(bottom)) if bottom else F.col(top)


def linear_score(intercept: float, terms: list[tuple[float, str]]) -> Column:
    score = F.lit(float(intercept))
    for weight, expression in terms:
        score = score + F.lit(float(weight)) * term(expression)
    return score


def score_text(intercept: float, terms: list[tuple[float, str]]) -> str:
    return f"{intercept:.6f}" + "".join(f"+({w:.6f}*{e})" for w, e in terms)


def resolution(snr, axis: str, model: int = 3) -> Column:
    """Angular resolution in degrees as a function of signal-to-noise ratio."""
    p0, p1, p2 = RESOLUTION[model][axis]
    snr = col(snr)
    if model == 3:
        return F.exp(F.lit(p0) * snr + F.lit(p1)) + F.lit(p2)
    return F.lit(p0) / (F.pow(snr, F.lit(p1)) + F.lit(p2))


def snr(peak_to_peak, mean_noise) -> Column:
    return safe_ratio(col(peak_to_peak), 2.0 * col(mean_noise))


def rayleigh_survival(amplitude, scale) -> Column:
    return F.exp(-0.5 * F.pow(col(amplitude) / col(scale), 2))


def rayleigh_scale_from_mean(mean) -> Column:
    return F.lit(math.sqrt(2.0 / math.pi)) * col(mean)


def rayleigh_axis_limit(mean, fraction: float) -> Column:
    return F.lit(math.sqrt(-(4.0 / math.pi) * math.log(1.0 - fraction))) * col(mean)


def point_log_likelihood(
    theta, phi, sigma_theta, sigma_phi, source_theta, source_phi, distance_m=None, horizon_m: float = HORIZON_M
) -> Column:
    """Squared normalised angle to a point, plus metres beyond the horizon if asked for."""
    d_theta = (col(source_theta) - col(theta)) / col(sigma_theta)
    d_phi = delta_angle(col(source_phi) - col(phi)) / col(sigma_phi)
    ll = d_theta * d_theta + d_phi * d_phi
    if distance_m is not None:
        ll = ll + F.greatest(F.lit(0.0), col(distance_m) - F.lit(horizon_m))
    return ll


def pair_min(asym12, asym21, self1, self2) -> Column:
    return F.least(col(asym12) + col(self2), col(asym21) + col(self1))


def pair_sum(asym12, asym21, self1, self2) -> Column:
    return col(asym12) + col(self1) + col(asym21) + col(self2)


def cartesian(ax, ay, az, bx, by, bz) -> Column:
    dx, dy, dz = col(ax) - col(bx), col(ay) - col(by), col(az) - col(bz)
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def window_gradient(begins: Column, ends: Column) -> Column:
    """Least-squares slope of the window width over five power fractions 0.1 apart."""
    def width(i: int) -> Column:
        return ends[i] - begins[i]

    return 10.0 * (-0.2 * width(0) - 0.1 * width(1) + 0.1 * width(3) + 0.2 * width(4))


def near_station(longitude, latitude) -> Column:
    lon, lat = col(longitude), col(latitude)
    return (lon >= 150) & (lon < 180) & (lat >= -85) & (lat < -75)


def in_sandbox(longitude) -> Column:
    return (col(longitude) >= -90) & (col(longitude) < 90)


# Pulser timing in ns.
PULSER_WINDOW_NS = 1200
PULSER_RANGE_NS = 1e6 / 0.3
DELAY_PERIOD_NS = 199996850
DELAY_OFFSET_NS = 500


def wais_pulser(trigger_ns, expected_ns) -> Column:
    return (col(expected_ns) < PULSER_RANGE_NS) & (
        F.abs(col(trigger_ns).cast("long") - col(expected_ns).cast("long")) < PULSER_WINDOW_NS
    )


def ldb_pulser(run, trigger_ns, expected_ns) -> Column:
    """Delayed pulser: the delay depends on the run range, modulo the generator period."""
    delay = F.when(col(run) < 150, 25000000).when(col(run) < 172, 50000000).otherwise(0)
    late = col(trigger_ns).cast("long") - col(expected_ns).cast("long")
    return (col(expected_ns) < PULSER_RANGE_NS) & (
        F.abs(late % DELAY_PERIOD_NS - delay - DELAY_OFFSET_NS) < PULSER_WINDOW_NS
    )


def pulser_flag(run, trigger_ns, wais_expected_ns, ldb_expected_ns) -> Column:
    return (
        F.when(wais_pulser(trigger_ns, wais_expected_ns), 1)
        .when(ldb_pulser(run, trigger_ns, ldb_expected_ns), 2)
        .otherwise(0)
    )
