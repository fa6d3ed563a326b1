"""Operations on sampled waveforms held in array columns.

One waveform is one row and its length is fixed by the digitiser, so every
function here is row-local: no shuffle, no collection across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from firn.functions.compare import col


def doubles(y: Column) -> Column:
    return F.transform(y, lambda v: v.cast("double"))


def total(y: Column) -> Column:
    return F.aggregate(y, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def mean(y: Column) -> Column:
    return F.try_divide(total(y), F.size(y))


def rms(y: Column) -> Column:
    """sqrt(E[y^2] - E[y]^2)."""
    squares = F.transform(y, lambda v: v.cast("double") * v.cast("double"))
    m = mean(y)
    return F.sqrt(F.greatest(mean(squares) - m * m, F.lit(0.0)))


def first_max_index(y: Column) -> Column:
    """Zero-based index of the first maximum."""
    return F.array_position(y, F.array_max(y)) - 1


def first_min_index(y: Column) -> Column:
    return F.array_position(y, F.array_min(y)) - 1


def nan_indices(y: Column) -> Column:
    marked = F.transform(y, lambda v, i: F.when(F.isnan(v), i))
    return F.filter(marked, lambda i: i.isNotNull())


def shift(y: Column, by) -> Column:
    return F.transform(y, lambda v: v.cast("double") - col(by))


def scale(y: Column, by) -> Column:
    return F.transform(y, lambda v: v.cast("double") * col(by))


def zero_pad(y: Column, length) -> Column:
    extra = F.greatest(col(length) - F.size(y), F.lit(0))
    return F.concat(doubles(y), F.array_repeat(F.lit(0.0), extra))


def next_power_of_two(n) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(col(n).cast("double")))).cast("int")


def normalised(y: Column, centre: Column, spread: Column) -> Column:
    """Mean 0 and RMS 1; a flat waveform is only centred."""
    divisor = F.when(spread > 0, spread).otherwise(F.lit(1.0))
    return F.transform(y, lambda v: (v.cast("double") - centre) / divisor)


def differences(y: Column) -> Column:
    """y[i+1] - y[i], one shorter than y."""
    n = F.size(y)
    left, right = F.slice(y, 1, F.greatest(n - 1, F.lit(0))), F.slice(y, 2, F.greatest(n - 1, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: b.cast("double") - a.cast("double"))


def derivative(x: Column, y: Column) -> Column:
    return F.zip_with(differences(x), differences(y), lambda dx, dy: F.try_divide(dy, dx))


def integrated_power(x: Column, y: Column) -> Column:
    """Sum of y^2 dx over all samples but the last."""
    steps = differences(x)
    used = F.slice(y, 1, F.size(steps))
    return total(F.zip_with(used, steps, lambda v, dx: v.cast("double") * v.cast("double") * dx))


def split_correlation(y: Column) -> Column:
    """Negative lags first: second half, then first half."""
    half = F.floor(F.size(y) / 2).cast("int")
    return F.concat(F.slice(y, half + 1, F.size(y) - half), F.slice(y, 1, half))


def lag_of_max(y: Column, dt: float) -> Column:
    """Signed lag, in time units, of the first maximum of a circular correlation."""
    n, k = F.size(y), first_max_index(y)
    return F.when(k >= F.floor(n / 2), k - n).otherwise(k) * F.lit(dt)


def at_lag(correlation: Column, lag, dt: float) -> Column:
    """Linear interpolation of a circular correlation at a signed lag."""
    n = F.size(correlation)
    position = col(lag) / dt
    low = F.floor(position)
    fraction = position - low
    first = F.element_at(correlation, (F.pmod(low, n) + 1).cast("int"))
    second = F.element_at(correlation, (F.pmod(low + 1, n) + 1).cast("int"))
    return first + fraction * (second - first)


def extrema(x: Column, y: Column) -> Column:
    """Strict three-point extrema as an array of (x, y)."""
    n = F.size(y)
    marked = F.transform(
        F.sequence(F.lit(2), n - 1),
        lambda i: F.when(
            ((F.get(y, i - 2) > F.get(y, i - 1)) & (F.get(y, i - 1) < F.get(y, i)))
            | ((F.get(y, i - 2) < F.get(y, i - 1)) & (F.get(y, i - 1) > F.get(y, i))),
            F.struct(F.get(x, i - 1).cast("double").alias("x"), F.get(y, i - 1).cast("double").alias("y")),
        ),
    )
    return F.when(n >= 3, F.filter(marked, lambda e: e.isNotNull())).otherwise(F.filter(marked, lambda e: F.lit(False)))


def largest_swing(points: Column) -> Column:
    """The adjacent extremum pair with the largest |dy|, earliest on ties.

    Struct of swing, max_y, max_x, min_y, min_x; NULL with fewer than two extrema.
    """
    n = F.size(points)
    pairs = F.zip_with(
        F.slice(points, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(points, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(
            F.abs(a["y"] - b["y"]).alias("swing"),
            F.greatest(a["y"], b["y"]).alias("max_y"),
            F.when(a["y"] > b["y"], a["x"]).otherwise(b["x"]).alias("max_x"),
            F.least(a["y"], b["y"]).alias("min_y"),
            F.when(a["y"] > b["y"], b["x"]).otherwise(a["x"]).alias("min_x"),
        ),
    )
    best = F.array_max(F.transform(pairs, lambda p: p["swing"]))
    return F.get(F.filter(pairs, lambda p: p["swing"] == best), F.lit(0))


def within(x: Column, y: Column, low, high) -> Column:
    """The (x, y) samples with low <= x <= high."""
    pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
    return F.filter(pairs, lambda p: (p["x"] >= col(low)) & (p["x"] <= col(high)))


def spectral_peaks(power: Column, df: float, count: int) -> Column:
    """The ``count`` largest strict local maxima as (power, frequency), padded with zeros."""
    n = F.size(power)
    peaks = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.when(
            (F.get(power, i) > F.get(power, i - 1)) & (F.get(power, i) > F.get(power, i + 1)),
            F.struct(F.get(power, i).alias("power"), (i * df).alias("frequency")),
        ),
    )
    ordered = F.sort_array(F.filter(peaks, lambda p: p.isNotNull()), asc=False)
    empty = F.struct(F.lit(0.0).alias("power"), F.lit(0.0).alias("frequency"))
    return F.slice(F.concat(ordered, F.array_repeat(empty, count)), 1, count)
