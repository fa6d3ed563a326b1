"""Event quality from per-channel measurements.

Tables here have one row per (event, channel). All rules are grouped aggregates with
map-side combining, or row-local functions when a channel array is nested in the event.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Voltage limits in mV and the channel counts that trip a rule.
BLAST_VOLTS = 400.0
SATURATION_VOLTS = 1500.0
BLAST_CHANNELS = 15
BLAST_SECTORS = 9
SATURATED_CHANNELS = 3
RATIO_LIMIT = 2.8
MIN_SAMPLES = 200
SURF_LIMITS = (2000.0, -2000.0, 500.0)
SECTORS = 16
# Frequency bands in GHz, the first slightly widened to include its edges.
POWER_BANDS = ((0.15 - 1e-10, 0.25 + 1e-10), (0.0, 999.0))


def channel_quality(
    channels: DataFrame, event: str, sector: Column, volts: Column,
    blast: float = BLAST_VOLTS, saturation: float = SATURATION_VOLTS,
    counts: tuple[int, int, int] = (BLAST_CHANNELS, BLAST_SECTORS, SATURATED_CHANNELS),
) -> DataFrame:
    """Counts over limits and the quality number: 1 blast, 2 saturated, 0 fine.

    The sector count uses a per-event bit mask, so it stays a plain aggregate.
    """
    loud = volts > blast
    mask = F.when(loud, F.pow(F.lit(2.0), sector)).otherwise(F.lit(0.0)).cast("long")
    grouped = channels.groupBy(event).agg(
        F.sum(loud.cast("long")).alias("above_blast"),
        F.sum((volts > saturation).cast("long")).alias("above_saturation"),
        F.bit_count(F.bit_or(mask)).cast("long").alias("sectors_above"),
    )
    number = (
        F.when((F.col("above_blast") >= counts[0]) | (F.col("sectors_above") >= counts[1]), 1)
        .when(F.col("above_saturation") >= counts[2], 2)
        .otherwise(0)
    )
    return grouped.withColumn("quality", number)


def saturation(channels: DataFrame, event: str, high: Column, low: Column, limits: tuple[float, float, float] = SURF_LIMITS) -> DataFrame:
    """Largest, smallest and most asymmetric channel of each event, and whether it passes."""
    top, bottom, asymmetry = limits
    grouped = channels.groupBy(event).agg(
        F.max(high).alias("max_volts"), F.min(low).alias("min_volts"), F.max(F.abs(high + low)).alias("asym_volts")
    )
    ok = (F.col("max_volts") <= top) & (F.col("min_volts") >= bottom) & (F.col("asym_volts") <= asymmetry)
    return grouped.withColumn("passes", ok)


def bottom_to_top(channels: DataFrame, event: str, limit: float = RATIO_LIMIT, skip: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """Largest middle/bottom peak-to-peak per polarisation over the top channel of the same sector.

    Channels have ``pol``, ``ring`` (0 top, 1 middle, 2 bottom), ``sector`` and ``p2p``; (pol, sector) pairs in
    ``skip`` are left out. One row per event and polarisation: the ratio, sector and maximum, in how many
    sectors the bottom channel beats the top one, and whether the ratio is over the limit.
    """
    for pol, sector in skip:
        channels = channels.filter(~((F.col("pol") == pol) & (F.col("sector") == sector)))
    per_sector = channels.groupBy(event, "pol", "sector").agg(
        F.max(F.when(F.col("ring") == 0, F.col("p2p"))).alias("top"),
        F.max(F.when(F.col("ring") > 0, F.col("p2p"))).alias("low"),
        F.max(F.when(F.col("ring") == 2, F.col("p2p"))).alias("bottom"),
    )
    best = F.max(F.struct(F.col("low"), (-F.col("sector")).alias("m"), F.col("top")))
    per_pol = per_sector.filter(F.col("low").isNotNull()).groupBy(event, "pol").agg(
        best.alias("_b"), F.sum((F.col("bottom") > F.col("top")).cast("long")).alias("sectors_exceeding")
    )
    ratio = F.when(F.col("_b.top") > 0, F.col("_b.low") / F.col("_b.top")).otherwise(-1.0)
    return per_pol.select(
        event, "pol", ratio.alias("ratio"), (-F.col("_b.m")).alias("sector"), F.col("_b.low").alias("max_p2p"),
        F.coalesce("sectors_exceeding", F.lit(0)).alias("sectors_exceeding"), (ratio > limit).alias("blast"),
    )


def blast_events(per_pol: DataFrame, event: str) -> DataFrame:
    """An event is a blast if either polarisation is."""
    return per_pol.groupBy(event).agg(F.bool_or("blast").alias("is_blast"), F.max("ratio").alias("max_ratio"))


def enough_samples(counts: Column, weight: Column, least: int = MIN_SAMPLES) -> Column:
    """Every channel long enough; simulated events are exempt."""
    return (weight > 0) | F.forall(F.flatten(counts), lambda n: n >= least)


def band_power(power: Column, df: float, low: float, high: float) -> Column:
    """Power in low <= f < high of one spectrum."""
    inside = F.transform(power, lambda p, k: F.when((k * df >= low) & (k * df < high), p).otherwise(0.0))
    return F.aggregate(inside, F.lit(0.0), lambda acc, p: acc + p) * df


def loudest_channel(channels: DataFrame, event: str, band: Column) -> DataFrame:
    """Middle/bottom channel with most power in a band, and the top channel of its sector."""
    with_power = channels.select(event, "pol", "ring", "sector", band.alias("p"))
    low = with_power.filter(F.col("ring") > 0).groupBy(event).agg(
        F.max(F.struct("p", (-F.col("pol")).alias("m_pol"), (-F.col("sector")).alias("m_sector"), (-F.col("ring")).alias("m_ring"))).alias("_b")
    )
    chosen = low.select(
        event, F.col("_b.p").alias("low_power"), (-F.col("_b.m_pol")).alias("pol"), (-F.col("_b.m_sector")).alias("sector"),
        (-F.col("_b.m_ring")).alias("low_ring"),
    )
    top = with_power.filter(F.col("ring") == 0).select(event, "pol", "sector", F.col("p").alias("top_power"))
    return chosen.join(top, [event, "pol", "sector"], "left")


def quality_flags(summary: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Write named rules into the ``flags`` struct; ``isGood`` is 1 when none is set."""
    value = F.col("flags")
    for name, rule in flags.items():
        value = value.withField(name, rule.cast("int"))
    bad = F.greatest(*[r.cast("int") for r in flags.values()], F.lit(0))
    return summary.withColumn("flags", value.withField("isGood", (bad == 0).cast("int")))
