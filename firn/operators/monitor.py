"""Rolling noise monitor over the last N good events of each channel and frequency, in batch.

The streaming twin is :mod:`firn.streaming.monitor`; both use the same window fit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from firn.functions.rayleigh import BINS, FRACTION, SCAN_STEPS, fit_windows
from firn.functions.scores import rayleigh_axis_limit, rayleigh_scale_from_mean, rayleigh_survival
from firn.operators.ordered import blocks, place
from firn.session import shuffle_width

WINDOW = 1000
ROWS_AT_ONCE = 2048


def good_new(df: DataFrame, good: Column) -> DataFrame:
    """Bad-quality rows never reach the averages."""
    return df.filter(F.coalesce(good, F.lit(False)))


def rolling_fit(df: DataFrame, keys: Sequence[str], order: Sequence[str], amplitude: str, rows: int = WINDOW, size: int | None = None) -> DataFrame:
    """Adds scale, chi_square, ndf, mean_power and log10_prob of the trailing window.

    The line is cut into blocks that carry the ``rows`` - 1 rows before them, so no task
    sees more than a block, however many rows one channel has.
    """
    size = max(size or 8 * rows, rows)
    placed = place(df, [*keys, *order])
    cut = blocks(placed, size, before=rows - 1)
    extra = "scale double, chi_square double, ndf int, mean_power double, log10_prob double, window_rows int"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_g")
        parts = []
        for _, series in pdf.groupby(list(keys), sort=False, dropna=False) if keys else [(None, pdf)]:
            parts.append(_fit_series(series, amplitude, rows))
        out = pd.concat(parts)
        return out[out["_home"]].drop(columns=["_g", "_block", "_home"])

    # Much work per byte: a fixed width keeps adaptive execution from packing blocks into few tasks.
    return cut.repartition(shuffle_width(df.sparkSession), "_block").groupBy("_block").applyInPandas(fit, f"{fields}, {extra}")


def _fit_series(series: pd.DataFrame, amplitude: str, rows: int) -> pd.DataFrame:
    values = series[amplitude].to_numpy(dtype=float)
    padded = np.concatenate([np.full(rows - 1, np.nan), values])
    windows = np.lib.stride_tricks.sliding_window_view(padded, rows)
    fits: list[np.ndarray] = []
    for start in range(0, len(values), ROWS_AT_ONCE):
        part = windows[start : start + ROWS_AT_ONCE]
        scale, chi, ndf = fit_windows(part)
        fits.append(np.stack([scale, chi, ndf, np.nanmean(part**2, axis=1), (~np.isnan(part)).sum(axis=1)], axis=1))
    table = np.concatenate(fits)
    scale = np.where(table[:, 0] > 0, table[:, 0], np.nan)
    return series.assign(
        scale=table[:, 0], chi_square=table[:, 1], ndf=table[:, 2].astype(int), mean_power=table[:, 3],
        log10_prob=-0.5 * (values / scale) ** 2 / np.log(10.0), window_rows=table[:, 4].astype(int),
    )


def zero_decision(reduced_chi: Column, chi_threshold: float, amplitude: Column, scale: Column, tail_fraction: float, channel_mean: Column | None = None) -> Column:
    """Blank a frequency bin: window fit too poor, or this amplitude too unlikely.

    A channel whose mean (amplitude/scale)^2 exceeds 2 gets that much extra room when
    ``channel_mean`` is given.
    """
    limit = F.lit(-2.0 * float(np.log(tail_fraction)))
    if channel_mean is not None:
        limit = limit + F.greatest(channel_mean - 2.0, F.lit(0.0))
    return (reduced_chi > chi_threshold) | (F.pow(amplitude / scale, 2) > limit)


def whole_fit(df: DataFrame, keys: Sequence[str], amplitude: str) -> DataFrame:
    """Guess and scanned Rayleigh fit of all amplitudes of each key, as plain aggregates.

    Means first, then ten bin counts per key: both map-side combined, so a key of any
    size shrinks before the shuffle. The 99 trial scales are an array expression.
    """
    means = df.groupBy(*keys).agg(F.avg(amplitude).alias("mean"), F.count(amplitude).alias("n"))
    sized = means.withColumn("width", rayleigh_axis_limit(F.col("mean"), FRACTION) / BINS)
    binned = df.join(sized.select(*keys, "width"), list(keys)).select(
        *keys, F.floor(F.col(amplitude) / F.col("width")).cast("int").alias("b")
    )
    counts = binned.groupBy(*keys).agg(
        F.array(*[F.sum(F.when(F.col("b") == k, 1).otherwise(0)) for k in range(BINS)]).alias("counts")
    )
    joined = sized.join(counts, list(keys)).withColumn("guess", rayleigh_scale_from_mean(F.col("mean")))

    def chi(scale: Column) -> Column:
        def one(count: Column, k: Column) -> Column:
            centre = F.col("width") * (k + 0.5)
            model = F.col("n") * F.col("width") / (scale * scale) * centre * rayleigh_survival(centre, scale)
            return F.when(count > 0, F.pow(model - count, 2) / count).otherwise(0.0)

        return F.aggregate(F.transform(F.col("counts"), one), F.lit(0.0), lambda acc, v: acc + v)

    trials = F.transform(
        F.sequence(F.lit(1), F.lit(SCAN_STEPS - 1)),
        lambda s: F.struct(chi(2 * F.col("guess") * s / SCAN_STEPS).alias("chi"), (2 * F.col("guess") * s / SCAN_STEPS).alias("scale")),
    )
    best = joined.withColumns({"guess_chi": chi(F.col("guess")), "_best": F.array_min(trials)})
    filled = F.size(F.filter("counts", lambda c: c > 0))
    return best.select(
        *keys, "n", "mean", "guess", "guess_chi", filled.alias("filled"), F.col("_best.scale").alias("scan_scale"), F.col("_best.chi").alias("scan_chi")
    )


def noise_average(df: DataFrame, keys: Sequence[str], seconds: Column, rms: str, scale_seconds: float = 10.0) -> DataFrame:
    """Mean noise per channel in fixed time bins."""
    return df.groupBy(*keys, F.floor(seconds / scale_seconds).cast("long").alias("time_bin")).agg(
        F.avg(rms).alias("noise"), F.count(rms).alias("n")
    )


