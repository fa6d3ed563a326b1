"""Vectorised spectral helpers for waveform columns.

Spark distributes the rows; waveforms of one length in an Arrow batch are read as a matrix, and
numpy gets ``SLICE`` rows of it at a time. Rows never become Python objects: a task holds its batch,
the result, and the working arrays of one slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

# Fixed value: termination resistance used by the dBm-style density.
OHMS = 50.0
#: Waveforms handed to numpy at once.
SLICE = 512

NORMALISATIONS: dict[str, Callable[[int, float], float]] = {
    "sum": lambda n, dt: 1.0 / n,
    "average": lambda n, dt: 1.0 / (n * n),
    "time_integral": lambda n, dt: dt / n,
    "density": lambda n, dt: dt * dt,
    "density_50_ohm": lambda n, dt: dt * dt / OHMS,
}


def _lengths(*columns: pa.Array) -> np.ndarray:
    """Length of each row's waveform in the first column, 0 where any column is null."""
    known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
    return np.where(known, pc.list_value_length(columns[0]).fill_null(0).to_numpy(zero_copy_only=False), 0)


def _matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(rows), -1)


def _computed(fn: Callable[..., np.ndarray], columns: Sequence[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and results of ``fn`` on 2-D float arrays, for each distinct row length; rows null or empty are left out."""
    lengths = _lengths(*columns)
    for n in np.unique(lengths[lengths > 0]):
        rows, made = np.flatnonzero(lengths == n), None
        for at in range(0, len(rows), SLICE):
            part = fn(*[_matrix(c, rows[at : at + SLICE]) for c in columns])
            if made is None:
                made = np.empty((len(rows), *part.shape[1:]))
            made[at : at + SLICE] = part
        yield rows, made


def lists(count: int, found: Sequence[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """One array of doubles per row from matrices of rows; NULL for rows in none of them."""
    wide, unseen = np.zeros(count, np.int64), np.ones(count, bool)
    for rows, made in found:
        wide[rows], unseen[rows] = made.shape[1], False
    offsets = np.concatenate(([0], np.cumsum(wide))).astype(np.int32)
    if len(found) == 1 and not unseen.any():
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[0][1].ravel(), from_pandas=True))
    flat = np.empty(offsets[-1])
    for rows, made in found:
        for at, row in zip(rows, made):
            flat[offsets[at] : offsets[at + 1]] = row
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, from_pandas=True), mask=pa.array(unseen))


def stacked(fn: Callable[..., np.ndarray], *columns: pa.Array) -> pa.Array:
    """Apply ``fn`` to 2-D float arrays, at most ``SLICE`` rows of one length at a time; it gives one row of numbers each."""
    return lists(len(columns[0]), list(_computed(fn, columns)))


def measured(fn: Callable[..., np.ndarray], count: int, *columns: pa.Array) -> list[pa.Array]:
    """The same where ``fn`` gives ``count`` numbers a row: one array for each of them, NULL for NaN."""
    values, unseen = np.zeros((len(columns[0]), count)), np.ones(len(columns[0]), bool)
    for rows, made in _computed(fn, columns):
        values[rows], unseen[rows] = made.reshape(len(rows), count), False
    return [pa.array(np.ascontiguousarray(v), mask=unseen | np.isnan(v)) for v in values.T]


def waveforms(*columns: pa.Array) -> Iterator[list[np.ndarray] | None]:
    """The rows one by one as arrays, None where the first column is null."""
    known = columns[0].is_valid().to_numpy(zero_copy_only=False)
    held = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False).astype(float, copy=False)) for c in columns]
    for i, seen in enumerate(known):
        yield [v[at[i] : at[i + 1]] for at, v in held] if seen else None


def varied(values: Sequence[np.ndarray | None]) -> pa.Array:
    """Arrays of doubles of any lengths, NULL for None."""
    unseen = np.array([v is None for v in values], bool)
    offsets = np.concatenate(([0], np.cumsum([0 if v is None else len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate([np.empty(0), *[v for v in values if v is not None]])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, from_pandas=True), mask=pa.array(unseen))


def power_matrix(y: np.ndarray, dt: float, norm: str) -> np.ndarray:
    n = y.shape[1]
    fold = np.full(n // 2 + 1, 2.0)
    fold[0] = 1.0
    if n % 2 == 0:
        fold[-1] = 1.0
    return np.abs(np.fft.rfft(y, axis=1)) ** 2 * fold * NORMALISATIONS[norm](n, dt)


def power_spectrum(y: Column, dt: float = 1.0, norm: str = "sum") -> Column:
    """One-sided power spectrum; interior bins carry both signs of frequency."""

    @F.arrow_udf("array<double>")
    def run(s: pa.Array) -> pa.Array:
        return stacked(lambda m: power_matrix(m, dt, norm), s)

    return run(y)


def forward(y: Column) -> Column:
    """Struct of arrays re, im (n//2 + 1 bins)."""

    @F.arrow_udf("re array<double>, im array<double>")
    def run(s: pa.Array) -> pa.Array:
        re = stacked(lambda m: np.fft.rfft(m, axis=1).real, s)
        im = stacked(lambda m: np.fft.rfft(m, axis=1).imag, s)
        return pa.StructArray.from_arrays([re, im], ["re", "im"])

    return run(y)


def inverse(spectrum: Column, n: int) -> Column:
    @F.arrow_udf("array<double>")
    def run(re: pa.Array, im: pa.Array) -> pa.Array:
        return stacked(lambda a, b: np.fft.irfft(a + 1j * b, n=n, axis=1), re, im)

    return run(spectrum["re"], spectrum["im"])


def frequencies(n: int, dt: float) -> list[float]:
    return [k / (n * dt) for k in range(n // 2 + 1)]


def correlate_matrix(a: np.ndarray, b: np.ndarray, pad: int = 1) -> np.ndarray:
    n = a.shape[1] * pad
    product = np.fft.rfft(a, n=n, axis=1) * np.conj(np.fft.rfft(b, n=n, axis=1))
    return np.fft.irfft(product, n=n, axis=1) / a.shape[1]


def cross_correlate(a: Column, b: Column, pad: int = 1) -> Column:
    """Circular cross-correlation divided by the length; ``pad`` = 2 avoids wrap-around."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return stacked(lambda p, q: correlate_matrix(p, q, pad), x, y)

    return run(a, b)


def upsampled_correlation(a: Column, b: Column, factor: int) -> Column:
    """Cross-correlation on a grid ``factor`` times finer, by zero-padding the spectrum."""

    def fine(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        n = p.shape[1]
        product = np.fft.rfft(p, axis=1) * np.conj(np.fft.rfft(q, axis=1))
        if n % 2 == 0:
            product[:, -1] *= 0.5
        return np.fft.irfft(product, n=n * factor, axis=1) * factor / n

    @F.arrow_udf("array<double>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return stacked(fine, x, y)

    return run(a, b)


def zero_pad_spectrum(spectrum: Column, n: int, padded: int) -> Column:
    """Spectrum of an upsampled waveform: scaled by length, last bin by sqrt(1/2)."""
    bins, wide, ratio = n // 2 + 1, padded // 2 + 1, padded / n

    def part(values: Column) -> Column:
        scaled = F.transform(values, lambda v, k: v * ratio * F.when(k == bins - 1, F.sqrt(F.lit(0.5))).otherwise(1.0))
        return F.concat(scaled, F.array_repeat(F.lit(0.0), wide - bins))

    return F.struct(part(spectrum["re"]).alias("re"), part(spectrum["im"]).alias("im"))


def normalise_spectrum(spectrum: Column, n: int) -> Column:
    """Divide by the time-domain RMS, found from the spectrum with half weight on the last bin."""
    bins = n // 2 + 1
    power = F.zip_with(spectrum["re"], spectrum["im"], lambda a, b: a * a + b * b)
    weighted = F.transform(power, lambda p, k: p * F.when(k == bins - 1, 0.5).otherwise(1.0))
    rms = F.sqrt(F.aggregate(weighted, F.lit(0.0), lambda acc, p: acc + p) / (n * n / 2.0))
    return F.struct(
        F.transform(spectrum["re"], lambda v: F.try_divide(v, rms)).alias("re"),
        F.transform(spectrum["im"], lambda v: F.try_divide(v, rms)).alias("im"),
    )


def notch(spectrum: Column, n: int, dt: float, low: float, high: float) -> Column:
    """Zero the bins with low <= f < high; also gives the fraction of power removed."""
    df = 1.0 / (n * dt)

    def inside(k: Column) -> Column:
        return (k * df >= low) & (k * df < high)

    power = F.zip_with(spectrum["re"], spectrum["im"], lambda a, b: a * a + b * b)
    everything = F.aggregate(power, F.lit(0.0), lambda acc, p: acc + p)
    cut = F.aggregate(
        F.transform(power, lambda p, k: F.when(inside(k), p).otherwise(0.0)), F.lit(0.0), lambda acc, p: acc + p
    )
    return F.struct(
        F.transform(spectrum["re"], lambda v, k: F.when(inside(k), 0.0).otherwise(v)).alias("re"),
        F.transform(spectrum["im"], lambda v, k: F.when(inside(k), 0.0).otherwise(v)).alias("im"),
        F.try_divide(cut, everything).alias("removed"),
    )


def set_magnitude(spectrum: Column, magnitude: Column | None = None) -> Column:
    """Keep the phase; magnitude 1, or that of a background spectrum."""
    paired = F.zip_with(
        spectrum["re"], spectrum["im"], lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.hypot(a, b).alias("m"))
    )

    def wanted(k: Column) -> Column:
        return F.lit(1.0) if magnitude is None else F.get(magnitude, k)

    def scaled(field: str) -> Column:
        return F.transform(paired, lambda p, k: F.when(p["m"] > 0, p[field] / p["m"] * wanted(k)).otherwise(0.0))

    return F.struct(scaled("a").alias("re"), scaled("b").alias("im"))


def analytic(y: np.ndarray) -> np.ndarray:
    n = y.shape[1]
    gain = np.zeros(n)
    gain[0] = 1.0
    gain[1 : (n + 1) // 2] = 2.0
    if n % 2 == 0:
        gain[n // 2] = 1.0
    return np.fft.ifft(np.fft.fft(y, axis=1) * gain, axis=1)


def hilbert_envelope(y: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(s: pa.Array) -> pa.Array:
        return stacked(lambda m: np.abs(analytic(m)), s)

    return run(y)


def stokes(h: Column, v: Column) -> Column:
    """Time-averaged Stokes I, Q, U, V of two polarisations."""

    @F.arrow_udf("i double, q double, u double, v double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        def four(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            x, y = analytic(p), analytic(q)
            cross = x * np.conj(y)
            xx, yy = np.abs(x) ** 2, np.abs(y) ** 2
            return np.stack([xx + yy, xx - yy, 2 * cross.real, 2 * cross.imag], axis=1).mean(axis=2)

        return pa.StructArray.from_arrays(measured(four, 4, a, b), ["i", "q", "u", "v"])

    return run(h, v)


def impulsivity(envelope: Column) -> Column:
    """Twice the mean of the cumulative power around the peak, less one: 1 for a delta, 0 for a flat wave."""

    def measure(e: np.ndarray) -> np.ndarray:
        n = e.shape[1]
        distance = np.abs(np.arange(n)[None, :] - np.argmax(e, axis=1)[:, None])
        power = np.take_along_axis(e**2, np.argsort(distance, axis=1, kind="stable"), axis=1)
        whole = power.sum(axis=1, keepdims=True)
        return 2 * (np.cumsum(power, axis=1) / np.where(whole > 0, whole, 1)).mean(axis=1) - 1

    @F.arrow_udf("double")
    def run(s: pa.Array) -> pa.Array:
        return measured(measure, 1, s)[0]

    return run(envelope)


def sine_subtract(y: Column, min_reduction: float = 0.05) -> Column:
    """Remove the strongest sinusoid while it takes out at least ``min_reduction`` of the power.

    A removed frequency has no power left, so the loop ends after one round per frequency at most.
    """

    def clean(m: np.ndarray) -> np.ndarray:
        out, n = m.copy(), m.shape[1]
        t = np.arange(n)
        active = np.ones(len(out), dtype=bool)
        while active.any():
            spectrum = np.fft.rfft(out, axis=1)
            spectrum[:, 0] = 0
            k = np.argmax(np.abs(spectrum), axis=1)
            best = np.take_along_axis(spectrum, k[:, None], axis=1)
            fold = np.where((n % 2 == 0) & (k == n // 2), 1.0, 2.0)[:, None]
            wave = fold / n * (best * np.exp(2j * np.pi * k[:, None] * t / n)).real
            trial = out - wave
            before = (out**2).sum(axis=1)
            gone = before - (trial**2).sum(axis=1)
            active &= (gone >= min_reduction * before) & (gone > 0)
            out[active] = trial[active]
        return out

    @F.arrow_udf("array<double>")
    def run(s: pa.Array) -> pa.Array:
        return stacked(clean, s)

    return run(y)


def resample_linear(x: Column, y: Column, dt: float) -> Column:
    """Linear interpolation on x0, x0 + dt, ... within the original range."""

    @F.arrow_udf("array<double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        def one(p, q):
            steps = int(np.floor((p[-1] - p[0]) / dt + 1e-9)) + 1
            return np.interp(p[0] + dt * np.arange(steps), p, q)

        return varied([None if w is None or len(w[0]) == 0 else one(*w) for w in waveforms(a, b)])

    return run(x, y)


def akima_values(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Akima (1970) interpolation; 0 outside the range of x."""
    slopes = np.diff(y) / np.diff(x)
    m = np.concatenate([[3 * slopes[0] - 2 * slopes[1], 2 * slopes[0] - slopes[1]], slopes,
                        [2 * slopes[-1] - slopes[-2], 3 * slopes[-1] - 2 * slopes[-2]]])
    right, left = np.abs(m[3:] - m[2:-1]), np.abs(m[1:-2] - m[:-3])
    weight = right + left
    flat = weight < 1e-9 * max(weight.max(), 1e-300)
    t = np.where(flat, (m[1:-2] + m[2:-1]) / 2, (right * m[1:-2] + left * m[2:-1]) / np.where(flat, 1, weight))
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h, d = np.diff(x)[k], at - x[k]
    c = (3 * slopes[k] - 2 * t[k] - t[k + 1]) / h
    b = (t[k] + t[k + 1] - 2 * slopes[k]) / h**2
    value = y[k] + d * (t[k] + d * (c + d * b))
    return np.where((at < x[0]) | (at > x[-1]), 0.0, value)


def resample_akima(x: Column, y: Column, start: float, dt: float, count: int) -> Column:
    grid = start + dt * np.arange(count)

    @F.arrow_udf("array<double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return varied([None if w is None or len(w[0]) < 3 else akima_values(*w, grid) for w in waveforms(a, b)])

    return run(x, y)


def narrowest_window(x: Column, y: Column, fraction: float) -> Column:
    """Shortest (begin, end) holding ``fraction`` of the integrated power, earliest on ties."""

    def one(t: np.ndarray, v: np.ndarray) -> tuple[float | None, float | None]:
        sums = np.concatenate([[0.0], np.cumsum(v[:-1] ** 2 * np.diff(t))])
        want = fraction * sums[-1] * (1 - 1e-12)
        end = np.searchsorted(sums, sums + want, side="left")
        start = np.flatnonzero(end < len(sums))
        if not len(start):
            return None, None
        width = t[end[start]] - t[start]
        best = start[np.flatnonzero(width <= width.min() + 1e-12)[0]]
        return float(t[best]), float(t[end[best]])

    @F.arrow_udf("begin double, end double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = [one(*w) if w is not None and len(w[0]) > 1 else (None, None) for w in waveforms(a, b)]
        ends = [pa.array([r[k] for r in rows], pa.float64(), from_pandas=True) for k in (0, 1)]
        return pa.StructArray.from_arrays(ends, ["begin", "end"])

    return run(x, y)


def clipped_background(power: Column, iterations: int = 4) -> Column:
    """Smooth background by the SNIP clipping rule (Ryan et al. 1988) with growing windows."""

    def clip(m: np.ndarray) -> np.ndarray:
        out = m.copy()
        for p in range(1, iterations + 1):
            if out.shape[1] <= 2 * p:
                break
            middle = (out[:, : -2 * p] + out[:, 2 * p :]) / 2
            out[:, p:-p] = np.minimum(out[:, p:-p], middle)
        return out

    @F.arrow_udf("array<double>")
    def run(s: pa.Array) -> pa.Array:
        return stacked(clip, s)

    return run(power)


def template_peak(y: Column, template: list[float]) -> Column:
    """Largest circular correlation with a normalised template, and its lag in samples."""
    fixed = np.asarray(template, float)
    fixed = (fixed - fixed.mean()) / (fixed.std() or 1.0)

    def match(m: np.ndarray) -> np.ndarray:
        centred = m - m.mean(axis=1, keepdims=True)
        spread = centred.std(axis=1, keepdims=True)
        unit = centred / np.where(spread > 0, spread, 1)
        c = correlate_matrix(unit, np.broadcast_to(fixed, unit.shape))
        k = np.argmax(c, axis=1)
        n = m.shape[1]
        return np.stack([c[np.arange(len(c)), k], np.where(k >= n // 2, k - n, k)], axis=1)

    @F.arrow_udf("peak double, lag int")
    def run(s: pa.Array) -> pa.Array:
        peak, lag = measured(match, 2, s)
        return pa.StructArray.from_arrays([peak, lag.cast(pa.int32())], ["peak", "lag"])

    return run(y)
