"""Angles and plane-wave delays as column expressions (degrees, metres, nanoseconds)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from firn.functions.compare import col

SPEED_OF_LIGHT = 299792458.0

# Even coefficients of the off-boresight delay polynomial (ns per degree^power).
OFF_AXIS_POWERS = {
    2: -1.68751e-05,
    4: 2.77815e-08,
    6: -8.29351e-12,
    8: 1.15064e-15,
    10: -7.71170e-20,
    12: 1.99661e-24,
}


def delta_angle(d) -> Column:
    """Fold an angle difference into [-180, 180); exactly 180 stays 180.

    Differences five or more turns away are not angles and give NULL.
    """
    d = col(d)
    folded = d - 360.0 * F.floor((d + 180.0) / 360.0)
    return (
        F.when((d >= 1620.0) | (d < -1620.0), F.lit(None).cast("double"))
        .when(d == 180.0, F.lit(180.0))
        .otherwise(folded)
    )


def wrap_into(value, period) -> Column:
    """Fold a value into [0, period)."""
    value, period = col(value), col(period)
    return value - period * F.floor(value / period)


def off_axis_delay(angle_deg) -> Column:
    """Extra delay of one antenna at an angle off its boresight (Horner in angle^2)."""
    square = col(angle_deg) * col(angle_deg)
    total = F.lit(0.0)
    for power in sorted(OFF_AXIS_POWERS, reverse=True):
        total = (total + F.lit(OFF_AXIS_POWERS[power])) * square
    return total


def relative_off_axis_delay(antenna1_phi, antenna2_phi, phi_deg) -> Column:
    return off_axis_delay(delta_angle(col(antenna1_phi) - col(phi_deg))) - off_axis_delay(
        delta_angle(col(antenna2_phi) - col(phi_deg))
    )


def plane_delay(z, r, antenna_phi_deg, phi_deg, theta_deg) -> Column:
    """Arrival time of a plane wave at an antenna relative to the array centre, in ns."""
    theta = F.radians(col(theta_deg))
    azimuth = F.radians(col(phi_deg) - col(antenna_phi_deg))
    path = -col(z) * F.tan(theta) - col(r) * F.cos(azimuth)
    return F.cos(theta) * path * F.lit(1e9 / SPEED_OF_LIGHT)


def pair_delay(a: dict, b: dict, phi_deg, theta_deg) -> Column:
    """Expected delay between two antennas given as dicts of z, r, phi columns."""
    return plane_delay(b["z"], b["r"], b["phi"], phi_deg, theta_deg) - plane_delay(
        a["z"], a["r"], a["phi"], phi_deg, theta_deg
    )


def nearest_set_sector(peak_phi, pattern, sectors: int = 16, first_phi: float = 0.0) -> Column:
    """Signed angle from a peak to the nearest sector whose bit is set; NULL if none is."""
    width = 360.0 / sectors
    offsets = F.array(
        *[
            F.when(
                F.getbit(col(pattern).cast("long"), F.lit(k)) == 1,
                delta_angle(col(peak_phi) - F.lit(first_phi + k * width)),
            )
            for k in range(sectors)
        ]
    )
    known = F.filter(offsets, lambda d: d.isNotNull())
    keyed = F.transform(known, lambda d: F.struct(F.abs(d).alias("size"), d.alias("angle")))
    return F.array_min(keyed)["angle"]
