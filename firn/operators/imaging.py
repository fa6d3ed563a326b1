"""Correlation maps of antenna arrays, their peaks, and coherent sums.

The array is fixed hardware, so antenna pairs and expected delays are small constant
tables (size set by the geometry, never by the data) and may be broadcast. Events are
never paired with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from firn.functions.angles import delta_angle, pair_delay, plane_delay
from firn.functions.spectral import akima_values, cross_correlate, upsampled_correlation, varied, waveforms
from firn.functions.waveform import at_lag

# Map binning and peak search.
SECTORS = 16
PAIR_REACH = 2
COARSE_PHI_BINS = 9 * SECTORS
COARSE_THETA_BINS = 70
THETA_RANGE = (-55.0, 35.0)
ZOOM_BINS = 40
ZOOM_STEP = 0.25
SUPPRESS_DEGREES = 10.0
FIT_SIZE = 5
#: Doubles of maps that a task holds at once.
MAP_VALUES = 1 << 20
_PEAK = ("value", "phi", "theta")
PEAKS = ArrayType(StructType([StructField(c, DoubleType()) for c in _PEAK]))
_PEAKS_ARROW = pa.list_(pa.struct([(c, pa.float64()) for c in _PEAK]))


def sector_gap(a: Column, b: Column, sectors: int = SECTORS) -> Column:
    """Distance around the ring."""
    d = F.abs(a % sectors - b % sectors)
    return F.least(d, sectors - d)


def antenna_pairs(antennas: DataFrame, sectors: int = SECTORS, reach: int = PAIR_REACH) -> DataFrame:
    """a < b no more than ``reach`` sectors apart (336 pairs for three rings of 16).

    Each antenna lists the sectors it can pair with, so this is an equi-join on sector.
    """
    left = antennas.select(
        F.col("ant").alias("a"),
        F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.pmod(F.col("ant") + k, F.lit(sectors)))).alias("_s"),
    ).distinct()
    right = antennas.select(F.col("ant").alias("b"), F.pmod(F.col("ant"), F.lit(sectors)).alias("_s"))
    return left.join(right, "_s").filter(F.col("a") < F.col("b")).select("a", "b")


def in_sector(pairs: DataFrame, sectors: int = SECTORS, reach: int = PAIR_REACH) -> DataFrame:
    """Pairs used for each sector: both antennas within ``reach`` of it."""
    listed = pairs.withColumn("sector", F.explode(F.sequence(F.lit(0), F.lit(sectors - 1))))
    return listed.filter(
        (sector_gap(F.col("a"), F.col("sector"), sectors) <= reach) & (sector_gap(F.col("b"), F.col("sector"), sectors) <= reach)
    )


def coarse_theta_edges(bins: int = COARSE_THETA_BINS) -> list[float]:
    """Bin edges uniform in the sine of the angle."""
    low, high = (np.sin(np.radians(t)) for t in THETA_RANGE)
    return [float(np.degrees(np.arcsin(low + k * (high - low) / bins))) for k in range(bins + 1)]


def fine_edges(low: float, high: float, span: float = ZOOM_BINS * ZOOM_STEP) -> list[float]:
    """Quarter-degree edges, half a zoom window beyond each end."""
    count = round((high - low + span) / ZOOM_STEP)
    return [low - span / 2 + k * ZOOM_STEP for k in range(count + 1)]


def coarse_delays(
    spark: SparkSession, geometry: DataFrame, phi0: float = 0.0, phi_bins: int = COARSE_PHI_BINS,
    theta_bins: int = COARSE_THETA_BINS, sectors: int = SECTORS,
) -> DataFrame:
    """a, b, phi_bin, theta_bin, delay for the pairs used in each direction's sector."""
    edges = coarse_theta_edges(theta_bins)
    theta = F.element_at(F.array(*[F.lit(t) for t in edges]), F.col("theta_bin") + 1)
    per_sector = phi_bins // sectors
    pairs = in_sector(antenna_pairs(geometry, sectors), sectors)
    cells = pairs.withColumns(
        {
            "phi_bin": F.explode(F.sequence(F.col("sector") * per_sector, (F.col("sector") + 1) * per_sector - 1)),
        }
    ).withColumn("theta_bin", F.explode(F.sequence(F.lit(0), F.lit(theta_bins - 1))))
    placed = _with_geometry(cells, geometry)
    # Sector k spans half a sector each side of its centre, phi0 + k * 360 / sectors.
    phi = F.lit(phi0 - 180.0 / sectors) + F.col("phi_bin") * F.lit(360.0 / phi_bins)
    delay = pair_delay(_antenna("a"), _antenna("b"), phi, theta)
    return placed.select("a", "b", "phi_bin", "theta_bin", delay.alias("delay"))


def _antenna(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}_{k}") for k in ("z", "r", "phi")}


def _with_geometry(df: DataFrame, geometry: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        named = geometry.select(F.col("ant").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("z", "r", "phi")])
        df = df.join(F.broadcast(named), side)
    return df


def correlations(channels: DataFrame, pairs: DataFrame, event: Sequence[str], upsample: int = 1) -> DataFrame:
    """Cross-correlation of every antenna pair of an event: event, a, b, corr.

    ``channels`` has event, ant and the waveform ``y``. Rows per event are bounded by the
    array, and the join is on (event, antenna).
    """
    first = channels.withColumnsRenamed({"ant": "a", "y": "_ya"})
    second = channels.select(*event, F.col("ant").alias("b"), F.col("y").alias("_yb"))
    met = first.join(F.broadcast(pairs), "a").join(second, [*event, "b"])
    corr = cross_correlate(F.col("_ya"), F.col("_yb")) if upsample == 1 else upsampled_correlation(F.col("_ya"), F.col("_yb"), upsample)
    return met.select(*event, "a", "b", corr.alias("corr"))


def coarse_map(correlated: DataFrame, delays: DataFrame, event: Sequence[str], dt: float) -> DataFrame:
    """Mean interpolated correlation per direction."""
    looked = correlated.join(F.broadcast(delays), ["a", "b"])
    value = at_lag(F.col("corr"), F.col("delay"), dt)
    return looked.select(*event, "phi_bin", "theta_bin", value.alias("v")).groupBy(*event, "phi_bin", "theta_bin").agg(
        F.avg("v").alias("value")
    )


def event_maps(
    channels: DataFrame, geometry: DataFrame, event: Sequence[str], dt: float,
    phi_bins: int = COARSE_PHI_BINS, theta_bins: int = COARSE_THETA_BINS,
) -> DataFrame:
    """One row per event with its coarse map as a flat array, phi-major; NULL where no pair of the event looks."""
    bins = phi_bins * theta_bins

    def flat(values: list[np.ndarray], unseen: list[np.ndarray]) -> pa.Array:
        held = pa.array(np.concatenate(values), mask=np.concatenate(unseen))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * bins), held)

    return _mapped(channels, geometry, event, dt, phi_bins, theta_bins, StructField("map", ArrayType(DoubleType())), flat)


def event_peaks(
    channels: DataFrame, geometry: DataFrame, event: Sequence[str], dt: float, phi_edges: Sequence[float], theta_edges: Sequence[float],
    count: int, suppress: float = SUPPRESS_DEGREES,
) -> DataFrame:
    """One row per event with the ``peaks`` of its coarse map, searched where the map is made: no map leaves the task."""
    search = _peak_search(phi_edges, theta_edges, count, suppress)
    held = StructField("peaks", PEAKS)

    def found(values: list[np.ndarray], unseen: list[np.ndarray]) -> pa.Array:
        return pa.array([search(np.where(none, np.nan, v)) for v, none in zip(values, unseen)], _PEAKS_ARROW)

    return _mapped(channels, geometry, event, dt, len(phi_edges), len(theta_edges), held, found)


def _mapped(
    channels: DataFrame, geometry: DataFrame, event: Sequence[str], dt: float, phi_bins: int, theta_bins: int, field: StructField,
    finish: Callable[[list[np.ndarray], list[np.ndarray]], pa.Array],
) -> DataFrame:
    """What ``finish`` makes of the coarse maps of some events, given as values and the bins that no pair sees.

    The channels of an event (``ant`` and equally long ``y``) are brought together once; their number is bounded by
    the array. Each is transformed once, and all directions are read from the pair correlations through
    one index matrix, which the geometry fixes and which is shipped to every task. A map is far larger than its
    channels, so only ``MAP_VALUES`` numbers of maps are made before they are handed on.
    """
    looks = coarse_delays(channels.sparkSession, geometry, phi_bins=phi_bins, theta_bins=theta_bins).toArrow()
    column = {c: np.asarray(looks.column(c)) for c in looks.column_names}
    pairs, pair = np.unique(np.stack([column["a"], column["b"]]), axis=1, return_inverse=True)
    cell = column["phi_bin"].astype(np.int64) * theta_bins + column["theta_bin"]
    low, bins = np.floor(column["delay"] / dt).astype(np.int64), phi_bins * theta_bins
    shared = channels.sparkSession.sparkContext.broadcast((pairs, pair.ravel(), cell, low, column["delay"] / dt - low))
    names, step = [*event, field.name], max(1, MAP_VALUES // bins)

    def mapped(waves: np.ndarray, antennas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs, pair, cell, low, part = shared.value
        n, row = waves.shape[1], np.full(max(int(pairs.max()), int(antennas.max())) + 1, -1)
        row[antennas] = np.arange(len(antennas))
        first, second = row[pairs[0]], row[pairs[1]]
        spectra = np.fft.rfft(waves, axis=1)
        corr = np.fft.irfft(spectra[first] * np.conj(spectra[second]), n=n, axis=1) / n
        seen = ((first >= 0) & (second >= 0))[pair]
        before, after = corr[pair[seen], low[seen] % n], corr[pair[seen], (low[seen] + 1) % n]
        total = np.bincount(cell[seen], before + part[seen] * (after - before), minlength=bins)
        count = np.bincount(cell[seen], minlength=bins)
        return total / np.maximum(count, 1), count == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            values, unseen = [], []
            for ants, waves in zip(batch.column("_ants"), batch.column("_waves"), strict=True):
                held = waves.values
                made, none = mapped(held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1), ants.values.to_numpy())
                values.append(made)
                unseen.append(none)
            yield pa.RecordBatch.from_arrays([*[batch.column(e) for e in event], finish(values, unseen)], names)

    together = F.sort_array(F.collect_list(F.struct(F.col("ant").cast("int").alias("ant"), "y")))
    grouped = channels.groupBy(*event).agg(together.alias("_c")).select(*event, F.col("_c.ant").alias("_ants"), F.col("_c.y").alias("_waves"))
    keys = [grouped.schema[e] for e in event]
    return grouped.mapInArrow(run, StructType([*keys, field]))


def zoom_map(
    correlated: DataFrame, geometry: DataFrame, peaks: DataFrame, event: Sequence[str], dt: float,
    bins: int = ZOOM_BINS, step: float = ZOOM_STEP, sectors: int = SECTORS, phi0: float = 0.0, peak: Sequence[str] = (),
) -> DataFrame:
    """Fine maps around given directions (``phi``, ``theta``) from upsampled correlations.

    One direction per event, or several told apart by the ``peak`` columns.
    """
    sector = F.pmod(F.floor((F.col("phi") - phi0) * sectors / 360.0 + 0.5), F.lit(sectors))
    centred = correlated.join(peaks.select(*event, *peak, "phi", "theta", sector.alias("_s")), list(event))
    used = centred.filter(
        (sector_gap(F.col("a"), F.col("_s"), sectors) <= PAIR_REACH) & (sector_gap(F.col("b"), F.col("_s"), sectors) <= PAIR_REACH)
    )
    half = bins // 2
    spread = used.withColumn("phi_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn(
        "theta_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    )
    placed = _with_geometry(spread, geometry)
    phi = F.col("phi") + (F.col("phi_bin") - half) * F.lit(step)
    theta = F.col("theta") + (F.col("theta_bin") - half) * F.lit(step)
    delay = pair_delay(_antenna("a"), _antenna("b"), phi, theta)
    value = at_lag(F.col("corr"), delay, dt)
    return placed.select(*event, *peak, "phi_bin", "theta_bin", value.alias("v")).groupBy(*event, *peak, "phi_bin", "theta_bin").agg(
        F.avg("v").alias("value")
    )


def map_rows(cells: DataFrame, event: Sequence[str], phi_bins: int, theta_bins: int) -> DataFrame:
    """One row per event with the map as a flat array, phi-major; directions no pair sees are NULL.

    The array length is the bin count, so the collected group is bounded.
    """
    bin_number = (F.col("phi_bin") * theta_bins + F.col("theta_bin")).cast("int")
    held = cells.groupBy(*event).agg(F.sort_array(F.collect_list(F.struct(bin_number.alias("k"), F.col("value").alias("v")))).alias("_m"))
    none = F.lit(None).cast("double")

    def before(i: Column) -> Column:
        return F.when(i > 0, F.get("_m", i - 1)["k"]).otherwise(-1)

    # Each bin brings the open bins before it, so the whole map is laid out in one pass.
    laid = F.flatten(F.transform("_m", lambda e, i: F.concat(F.array_repeat(none, e["k"] - before(i) - 1), F.array(e["v"]))))
    rest = F.array_repeat(none, F.lit(phi_bins * theta_bins - 1) - F.element_at("_m", -1)["k"])
    return held.select(*event, F.concat(laid, rest).alias("map"))


def _grid(values: np.ndarray, phi_bins: int, theta_bins: int) -> np.ndarray:
    return np.nan_to_num(np.asarray(values, float), nan=-np.inf).reshape(phi_bins, theta_bins)


def _peak_search(phi_edges: Sequence[float], theta_edges: Sequence[float], count: int, suppress: float) -> Callable[[np.ndarray], list[dict]]:
    """Greedy peaks of a map: local maximum of its 8 neighbours (phi wraps, theta does not), then blank a box around it."""
    phi, theta = np.asarray(phi_edges, float), np.asarray(theta_edges, float)

    def search(values: np.ndarray) -> list[dict]:
        m = _grid(values, len(phi), len(theta))
        padded = np.pad(np.concatenate([m[-1:], m, m[:1]]), ((0, 0), (1, 1)), constant_values=-np.inf)
        around = [
            padded[1 + i : 1 + i + len(phi), 1 + j : 1 + j + len(theta)]
            for i in (-1, 0, 1)
            for j in (-1, 0, 1)
            if (i, j) != (0, 0)
        ]
        summit = np.logical_and.reduce([a < m for a in around])
        open_cells, found = np.ones_like(summit), []
        for _ in range(count):
            ok = summit & open_cells
            if not ok.any():
                break
            i, j = np.unravel_index(np.argmax(np.where(ok, m, -np.inf)), m.shape)
            found.append({"value": float(m[i, j]), "phi": float(phi[i]), "theta": float(theta[j])})
            gap = np.abs((phi - phi[i] + 180.0) % 360.0 - 180.0)
            open_cells &= ~((gap < suppress)[:, None] & (np.abs(theta - theta[j]) < suppress)[None, :])
        return found

    return search


def quadratic_design(size: int = FIT_SIZE, step: float = ZOOM_STEP) -> np.ndarray:
    """Pseudo-inverse of the 6-term quadratic on a size x size patch."""
    offsets = (np.arange(size) - size // 2) * step
    x, y = (g.ravel() for g in np.meshgrid(offsets, offsets, indexing="ij"))
    return np.linalg.pinv(np.stack([x * x, y * y, x * y, x, y, np.ones_like(x)], axis=1))


def quadratic_peak(map_array: Column, phi_bins: int, theta_bins: int, step: float = ZOOM_STEP, size: int = FIT_SIZE) -> Column:
    """Vertex of a quadratic fitted around the highest bin: offsets in bins' units of degrees.

    Struct of value, d_phi, d_theta (from the first bin edge) and reduced chi-square; the
    plain bin when the patch leaves the map.
    """
    inverse, half = quadratic_design(size, step), size // 2
    offsets = (np.arange(size) - half) * step
    x, y = (g.ravel() for g in np.meshgrid(offsets, offsets, indexing="ij"))

    def fit(values: np.ndarray) -> tuple[float, float, float, float]:
        m = _grid(values, phi_bins, theta_bins)
        i, j = np.unravel_index(np.argmax(m), m.shape)
        at = (float(m[i, j]), i * step, j * step, float("nan"))
        if i < half or j < half or i + half >= phi_bins or j + half >= theta_bins:
            return at
        patch = m[i - half : i + half + 1, j - half : j + half + 1].ravel()
        if not np.isfinite(patch).all():
            return at
        a, b, c, d, e, f = inverse @ patch
        det = 4 * a * b - c * c
        if det == 0:
            return at
        px, py = (c * e - 2 * b * d) / det, (c * d - 2 * a * e) / det
        model = a * x * x + b * y * y + c * x * y + d * x + e * y + f
        top = a * px * px + b * py * py + c * px * py + d * px + e * py + f
        return float(top), float(i * step + px), float(j * step + py), float(((model - patch) ** 2).mean())

    names = ["value", "d_phi", "d_theta", "chisq"]

    @F.arrow_udf("value double, d_phi double, d_theta double, chisq double")
    def run(s: pa.Array) -> pa.Array:
        fits = np.array([fit(w[0]) for w in waveforms(s)], float).reshape(-1, len(names))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v), from_pandas=True) for v in fits.T], names)

    return run(map_array)


def coherent_sum(
    channels: DataFrame, geometry: DataFrame, directions: DataFrame, event: Sequence[str], dt: float, samples: int,
    sectors: int = SECTORS, reach: int = PAIR_REACH, phi0: float = 0.0, peak: Sequence[str] = (),
) -> DataFrame:
    """Average of the channels facing a direction after removing each one's plane-wave delay.

    ``directions`` has event, phi, theta and any ``peak`` columns. Result: those keys,
    wave (``samples`` long), channels.
    """
    keys = [*event, *peak]
    sector = F.pmod(F.floor((F.col("phi") - phi0) * sectors / 360.0 + 0.5), F.lit(sectors))
    aimed = directions.select(*keys, "phi", "theta", sector.alias("_s"))
    joined = channels.join(aimed, list(event)).filter(sector_gap(F.col("ant"), F.col("_s"), sectors) <= reach)
    placed = joined.join(F.broadcast(geometry.select("ant", F.col("z").alias("_z"), F.col("r").alias("_r"), F.col("phi").alias("_p"))), "ant")
    delay = plane_delay(F.col("_z"), F.col("_r"), F.col("_p"), F.col("phi"), F.col("theta"))

    @F.arrow_udf("array<double>")
    def shifted(y: pa.Array, late: pa.Array) -> pa.Array:
        grid = dt * np.arange(samples)
        return varied([akima_values(dt * np.arange(len(w[0])), w[0], grid + d) for w, d in zip(waveforms(y), late.to_numpy(zero_copy_only=False))])

    rows = placed.select(*keys, F.posexplode(shifted(F.col("y"), delay)).alias("i", "v"))
    means = rows.groupBy(*keys, "i").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    packed = F.array_sort(F.collect_list(F.struct("i", "v")))
    return means.groupBy(*keys).agg(F.transform(packed, lambda e: e["v"]).alias("wave"), F.max("n").alias("channels"))


def sector_of(phi: Column, phi0: float = 0.0, sectors: int = SECTORS) -> Column:
    return F.pmod(F.floor((phi - phi0) * sectors / 360.0 + 0.5), F.lit(sectors)).cast("int")


def angle_from(phi: Column, other: Column) -> Column:
    return delta_angle(phi - other)
