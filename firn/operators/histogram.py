"""Histograms and profiles as grouped aggregates.

Every fill is one partial + final aggregate on the bin number; the result has at most
``bins + 2`` rows per group, so windows over a finished histogram are small by definition.
Bin 0 is underflow and bin ``bins + 1`` overflow, NaN included.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from firn.functions.compare import col


@dataclass(frozen=True)
class Axis:
    bins: int
    low: float
    high: float

    @property
    def width(self) -> float:
        return (self.high - self.low) / self.bins

    def index(self, x) -> Column:
        x = col(x).cast("double")
        inside = F.floor((x - F.lit(float(self.low))) * F.lit(float(self.bins)) / F.lit(float(self.high - self.low))) + 1
        number = F.when(x < self.low, 0).when(x >= self.high, self.bins + 1).otherwise(
            F.least(inside, F.lit(self.bins))
        )
        return number.cast("int")

    def low_edge(self, bin_number) -> Column:
        return F.lit(float(self.low)) + (col(bin_number) - 1) * F.lit(self.width)

    def centre(self, bin_number) -> Column:
        return F.lit(float(self.low)) + (col(bin_number) - 0.5) * F.lit(self.width)

    def extended(self, smallest: float, largest: float) -> "Axis":
        """Double the range, keeping the bin count, until both values are inside."""
        low, high = self.low, self.high
        while largest >= high:
            high += high - low
        while smallest < low:
            low -= high - low
        return Axis(self.bins, low, high)


def data_axis(df: DataFrame, x: Column, bins: int, pad: float = 0.0) -> Axis:
    """An axis from the smallest to the largest finite value (one small aggregate); from 0 to 1 without any."""
    value = x.cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    row = df.agg(F.min(finite).alias("lo"), F.max(finite).alias("hi")).first()
    if row["lo"] is None:
        return Axis(bins, 0.0, 1.0 + pad)
    low, high = float(row["lo"]), float(row["hi"])
    return Axis(bins, low, high + pad if high + pad > low else low + 1.0)


def extendable_axis(df: DataFrame, x: Column, start: Axis) -> Axis:
    found = data_axis(df, x, start.bins)
    return start.extended(found.low, found.high)


def hist1d(df: DataFrame, x: Column, axis: Axis, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """bin, content, error, entries."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    filled = df.select(*by, axis.index(x).alias("bin"), w.alias("_w")).filter(F.col("bin").isNotNull())
    return filled.groupBy(*by, "bin").agg(
        F.sum("_w").alias("content"),
        F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("error"),
        F.count("*").alias("entries"),
    )


def hist2d(df: DataFrame, x: Column, y: Column, x_axis: Axis, y_axis: Axis, weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight.cast("double")
    filled = df.select(x_axis.index(x).alias("bin_x"), y_axis.index(y).alias("bin_y"), w.alias("_w"))
    return filled.filter(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull()).groupBy("bin_x", "bin_y").agg(
        F.sum("_w").alias("content"), F.count("*").alias("entries")
    )


def profile1d(df: DataFrame, x: Column, y: Column, axis: Axis) -> DataFrame:
    """Mean, spread and count of y per x bin."""
    return df.select(axis.index(x).alias("bin"), y.cast("double").alias("_y")).groupBy("bin").agg(
        F.avg("_y").alias("mean"), F.stddev_pop("_y").alias("spread"), F.count("_y").alias("entries")
    )


def profile2d(df: DataFrame, x: Column, y: Column, z: Column, x_axis: Axis, y_axis: Axis) -> DataFrame:
    binned = df.select(x_axis.index(x).alias("bin_x"), y_axis.index(y).alias("bin_y"), z.cast("double").alias("_z"))
    return binned.groupBy("bin_x", "bin_y").agg(
        F.avg("_z").alias("mean"), F.stddev_pop("_z").alias("spread"), F.count("_z").alias("entries")
    )


def project(hist: DataFrame, onto: str) -> DataFrame:
    """Sum a 2-D histogram over its other axis."""
    return hist.groupBy(onto).agg(F.sum("content").alias("content"), F.sum("entries").alias("entries"))


def profile_x(hist: DataFrame, y_axis: Axis) -> DataFrame:
    """Mean and spread of y per x bin from a 2-D histogram; under- and overflow excluded.

    The moment estimate also serves as the per-slice Gaussian.
    """
    centre, w = y_axis.centre(F.col("bin_y")), F.col("content")
    inside = hist.filter(F.col("bin_y").between(1, y_axis.bins))
    sums = inside.groupBy("bin_x").agg(
        F.sum(w).alias("content"), F.sum(w * centre).alias("_m1"), F.sum(w * centre * centre).alias("_m2")
    )
    mean = F.try_divide(F.col("_m1"), F.col("content"))
    variance = F.try_divide(F.col("_m2"), F.col("content")) - mean * mean
    return sums.select("bin_x", "content", mean.alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("spread"))


def dense(spark: SparkSession, hist: DataFrame, bins: int, by: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """All bins 1..n including the empty ones, for cumulative work."""
    numbers = F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")
    base = (groups if groups is not None else hist.select(*by).distinct()) if by else spark.range(1)
    grid = base.select(*by, numbers)
    return grid.join(hist, [*by, "bin"], "left").fillna(0, subset=["content", "error", "entries"])


def _over_bins(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy("bin")


def integral(hist: DataFrame, ascending: bool = True, normalised: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative content with its error, from the first bin up or from the last bin down."""
    order = F.asc("bin") if ascending else F.desc("bin")
    span = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    scale = F.sum("content").over(whole) if normalised else F.lit(1.0)
    return hist.select(
        *by,
        "bin",
        F.try_divide(F.sum("content").over(span), scale).alias("total"),
        F.try_divide(F.sqrt(F.sum(F.col("error") * F.col("error")).over(span)), scale).alias("total_error"),
    )


def efficiency_above(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fraction of content not below each bin: 1 minus the normalised sum of earlier bins."""
    w = _over_bins(by).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("content").over(Window.partitionBy(*by))
    below = F.coalesce(F.sum("content").over(w), F.lit(0.0))
    return hist.select("*", (F.lit(1.0) - F.try_divide(below, whole)).alias("efficiency"))


def full_width_half_max(hist: DataFrame, axis: Axis) -> DataFrame:
    """Distance between the first bins below half maximum on each side of the first peak bin."""
    # The histogram is bounded by its bin count: one global row of three conditional aggregates.
    peak = hist.agg(F.max("content").alias("_max"), F.max_by("bin", F.struct("content", -F.col("bin"))).alias("_peak"))
    joined = hist.join(F.broadcast(peak), F.col("bin") > 0)
    low_side = F.max(F.when((F.col("bin") <= F.col("_peak")) & (F.col("content") < F.col("_max") / 2), F.col("bin")))
    high_side = F.min(F.when((F.col("bin") >= F.col("_peak")) & (F.col("content") < F.col("_max") / 2), F.col("bin")))
    edges = joined.agg(
        F.first("_peak").alias("peak_bin"), low_side.alias("_l"), high_side.alias("_h")
    )

    def edge(name: str) -> Column:
        return F.coalesce(axis.low_edge(F.col(name)), F.lit(0.0))

    return edges.select("peak_bin", (edge("_h") - edge("_l")).alias("fwhm"))


def content_distribution(hist: DataFrame, axis: Axis) -> DataFrame:
    """Histogram of bin contents."""
    return hist1d(hist, F.col("content"), axis)


def overlap_merit(signal: DataFrame, background: DataFrame, bins: int) -> DataFrame:
    """Signal up to and from the last non-empty background bin, and their ratio."""
    last = background.filter((F.col("content") > 0) & F.col("bin").between(1, bins)).agg(F.max("bin").alias("_last"))
    joined = signal.join(F.broadcast(last), F.col("bin") <= bins + 1)
    below = F.sum(F.when(F.col("bin").between(1, F.col("_last")), F.col("content")).otherwise(0.0))
    above = F.sum(F.when(F.col("bin") >= F.col("_last"), F.col("content")).otherwise(0.0))
    merged = joined.agg(F.first("_last").alias("last_background_bin"), below.alias("below"), above.alias("above"))
    return merged.withColumn("merit", F.try_divide("below", "above"))


def score_threshold(signal: DataFrame, background: DataFrame, axis: Axis, acceptance: float) -> DataFrame:
    """Upper edge of the first bin whose background efficiency is below ``acceptance``.

    Inputs are dense histograms. Also gives the signal efficiency there, interpolated
    between bin centres (held constant beyond the outermost centres).
    """
    kept = efficiency_above(background).filter((F.col("efficiency") < acceptance) & (F.col("bin") < axis.bins))
    pick = kept.agg(F.min("bin").alias("_b")).select("_b", (axis.low_edge(F.col("_b")) + axis.width).alias("threshold"))
    eff = efficiency_above(signal).select("bin", "efficiency")
    # An upper edge lies halfway between two centres, so the interpolation is their mean.
    near = eff.join(F.broadcast(pick), F.col("bin").between(F.col("_b"), F.col("_b") + 1))
    return near.agg(F.first("threshold").alias("threshold"), F.avg("efficiency").alias("signal_efficiency"))


def outliers(df: DataFrame, score: Column, hist: DataFrame, axis: Axis, at_most: float) -> DataFrame:
    """Rows scoring above the lowest bin edge with fewer than ``at_most`` entries from there up."""
    tail = integral(hist, ascending=False).filter((F.col("total") < at_most) & F.col("bin").between(1, axis.bins))
    limit = tail.agg(axis.low_edge(F.min("bin")).alias("_limit"))
    return df.withColumn("_score", score).join(F.broadcast(limit), F.col("_score") > F.col("_limit")).drop("_limit")
