"""Time-series operators on long tables, safe for keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from firn.operators.ordered import BLOCK_ROWS, neighbours, number, place, rolling_sums, running_sum


def unwrap(df: DataFrame, keys: Sequence[str], order: Sequence[str], y: str, wrap: float, out: str = "unwrapped", size: int = BLOCK_ROWS) -> DataFrame:
    """Add or subtract whole turns so neighbouring values differ by at most half a turn."""
    placed = place(df, [*keys, *order])
    stepped = neighbours(placed, keys, {"_prev": (y, -1)}, size)
    turns = (F.col(y) - F.col("_prev")) / F.lit(float(wrap))
    count = F.when(turns > 0.5, F.ceil(turns - 0.5)).when(turns < -0.5, F.floor(turns + 0.5)).otherwise(0)
    summed = running_sum(stepped, keys, F.coalesce(count, F.lit(0)).cast("long"), "_turns", size)
    return summed.withColumn(out, F.col(y) - F.lit(float(wrap)) * F.col("_turns")).drop("_g", "_prev", "_turns")


def derivative(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Discrete derivative at the left point; the last point of a series has none."""
    placed = place(df, [*keys, *order])
    ahead = neighbours(placed, keys, {"_nx": (x, 1), "_ny": (y, 1)}, size)
    slope = F.try_divide(F.col("_ny") - F.col(y), F.col("_nx") - F.col(x))
    return ahead.filter(F.col("_nx").isNotNull()).withColumn("derivative", slope).drop("_g", "_nx", "_ny")


def local_swings(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Largest |dy| between adjacent strict extrema of each series (earliest on ties)."""
    placed = place(df, [*keys, *order])
    around = neighbours(placed, keys, {"_p": (y, -1), "_n": (y, 1)}, size)
    here = F.col(y)
    turning = ((F.col("_p") > here) & (here < F.col("_n"))) | ((F.col("_p") < here) & (here > F.col("_n")))
    points = around.filter(turning).select(*keys, *dict.fromkeys([*order, x, y]), F.col("_g").alias("_at"))
    pairs = neighbours(place(points, [*keys, "_at"]), keys, {"_ny": (y, 1), "_nx": (x, 1)}, size).filter(F.col("_ny").isNotNull())
    falls = F.col(y) > F.col("_ny")
    pair = F.struct(
        F.abs(F.col(y) - F.col("_ny")).alias("swing"),
        (-F.col("_at")).alias("_earlier"),
        F.greatest(y, "_ny").alias("max_y"),
        F.when(falls, F.col(x)).otherwise(F.col("_nx")).alias("max_x"),
        F.least(y, "_ny").alias("min_y"),
        F.when(falls, F.col("_nx")).otherwise(F.col(x)).alias("min_x"),
    )
    best = pairs.groupBy(*keys).agg(F.max(pair).alias("_b")) if keys else pairs.agg(F.max(pair).alias("_b"))
    return best.select(*keys, "_b.swing", "_b.max_y", "_b.max_x", "_b.min_y", "_b.min_x")


def integrated_power(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Sum of y^2 dx per series, the last sample having no step."""
    placed = place(df, [*keys, *order])
    ahead = neighbours(placed, keys, {"_nx": (x, 1)}, size).filter(F.col("_nx").isNotNull())
    return ahead.groupBy(*keys).agg(F.sum(F.col(y) * F.col(y) * (F.col("_nx") - F.col(x))).alias("power"))


def rolling_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], y: str, rows: int, size: int = BLOCK_ROWS) -> DataFrame:
    """Mean and count over the last ``rows`` rows of each series."""
    placed = place(df, [*keys, *order])
    known = F.col(y).isNotNull().cast("long")
    sums = rolling_sums(placed, keys, rows, {"_total": F.col(y), "rolling_count": known}, size)
    return sums.withColumn("rolling_mean", F.try_divide("_total", "rolling_count")).drop("_g", "_total")


def gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``step``: distance to the previous row of the series (NULL for the first)."""
    placed = place(df, [*keys, *order])
    behind = neighbours(placed, keys, {"_prev": (at, -1)}, size)
    return behind.withColumn("step", F.col(at) - F.col("_prev")).drop("_g", "_prev")


def breaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, expected: int = 1, size: int = BLOCK_ROWS) -> DataFrame:
    """Rows whose id does not follow its predecessor: history must be reloaded there."""
    return gaps(df, keys, order, at, size).filter(F.col("step").isNotNull() & (F.col("step") != expected))


def missing_trials(stepped: DataFrame, by: Column, step: Column) -> DataFrame:
    """Trials per bin when a step of n implies n - 1 missed ones: passed, trials, efficiency."""
    sums = stepped.groupBy(by.alias("bin")).agg(
        F.count("*").alias("passed"), F.sum(F.greatest(F.coalesce(step, F.lit(1)), F.lit(1))).alias("trials")
    )
    return sums.withColumn("efficiency", F.try_divide(F.col("passed").cast("double"), F.col("trials")))


def every_kth(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """Rows 0, k, 2k, ... in the given order."""
    return place(df, list(order)).filter(F.col("_g") % k == 0).drop("_g")


def kth_row(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """The k-th row (0-based)."""
    return place(df, list(order)).filter(F.col("_g") == k).drop("_g")


def divide(df: DataFrame, order: Sequence[str], parts: int) -> DataFrame:
    """Number equal consecutive slices 0..parts-1, the remainder going to the last."""
    placed = place(df, list(order))
    rows = placed.count()
    each = max(rows // parts, 1)
    return placed.withColumn("division", F.least(F.floor(F.col("_g") / each), F.lit(parts - 1)).cast("int")).drop("_g")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rn", size: int = BLOCK_ROWS) -> DataFrame:
    return number(place(df, [*keys, *order]), keys, out, size).drop("_g")


def first_last(df: DataFrame, keys: Sequence[str], position: Column, columns: Sequence[str], *more: Column) -> DataFrame:
    """First and last value by position, and any further aggregates: one pass, no sort."""
    aggs = [*more] + [
        f(F.col(c), position).alias(f"{label}_{c}")
        for c in columns
        for label, f in (("first", F.min_by), ("last", F.max_by))
    ]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def moments(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """Mean, RMS about the mean, sum, extremes and count."""
    aggs = [
        F.count(y).alias("n"),
        F.sum(y).alias("total"),
        F.avg(y).alias("mean"),
        F.stddev_pop(y).alias("rms"),
        F.min(y).alias("smallest"),
        F.max(y).alias("largest"),
    ]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def normalise(df: DataFrame, keys: Sequence[str], y: str, out: str = "normalised") -> DataFrame:
    """Mean 0 and RMS 1 per series (NULL is a key like any other): an aggregate joined back, so heavy keys can be split."""
    stats = df.groupBy(*keys).agg(F.avg(y).alias("_m"), F.stddev_pop(y).alias("_s"))
    spread = F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))
    named = stats.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [df[k].eqNullSafe(named[f"_of_{k}"]) for k in keys]
    return df.join(named, same).drop(*[f"_of_{k}" for k in keys]).withColumn(out, (F.col(y) - F.col("_m")) / spread).drop("_m", "_s")


def sample_rows(df: DataFrame, n: int, seed: int, unique: Sequence[str]) -> DataFrame:
    """``n`` rows without replacement, the same ones on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), *unique), *unique).limit(n)


def sample_fraction(df: DataFrame, percent: float, seed: int, unique: Sequence[str]) -> DataFrame:
    """Keep about ``percent`` of rows, decided per row by a hash of its id."""
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *unique), F.lit(1_000_000)) < percent * 10_000)
