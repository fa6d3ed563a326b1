"""The analysis programs as Spark jobs: read, run one operator chain, write."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from firn.functions import scores
from firn.functions.compare import where
from firn.operators import clustering as cl
from firn.operators import joins, learn
from firn.operators.cuts import Catalogue, nested_cuts
from firn.operators.elements import linear_elements, skim
from firn.plans.nested import DIRECTIONS, thermal_columns
from firn.sources import readers, sinks

FIELDS = ("peak", "coherent_filtered", "deconvolved_filtered")

# Cut lists of the skims and the variables of the two trainings.
REDUCTIONS = {
    "analysis": [
        "highestPeak", "isRfTrigger", "isNotTaggedAsPulser", "newPayloadBlastCutPart0A", "newPayloadBlastCutPart0B",
        "newPayloadBlastCutPart1", "newPayloadBlastCutPart2", "newPayloadBlastCutPart3", "smallDeltaRough", "goodGPS",
        "isBelowHorizontal", "reasonableHilbertPeakTimeShiftAfterDedispersion", "higherHilbertPeakAfterDedispersion",
        "higherImpulsivityMeasureAfterDedispersion", "lowerFracPowerWindowGradientAfterDedispersion",
    ],
    "calibration": ["isTaggedAsWaisPulser"],
    "payload_blast": ["isTaggedAsPayloadBlast"],
}
SUB_THRESHOLD = 0.2


def split_cuts(cuts: Catalogue, names: Sequence[str]) -> tuple[list[Column], list]:
    """Row-level conditions and element cuts of a list of names."""
    chosen = [cuts[n] for n in names]
    return [c.column for c in chosen if not c.per_element], [c for c in chosen if c.per_element]


def reduce(summaries: DataFrame, which: str, path: str | None = None) -> DataFrame:
    """Skim summaries by a named cut list; rows are unchanged."""
    elements = F.col("_el")
    rows, per_element = split_cuts(nested_cuts(elements), REDUCTIONS[which])
    kept = skim(summaries.withColumn("_el", linear_elements(FIELDS, DIRECTIONS)), elements, rows, per_element).drop("_el")
    if path:
        sinks.write(kept, path, by=["run"])
    return kept


def thermal_table(summaries: DataFrame, run: int | None = None, path: str | None = None) -> DataFrame:
    """Flat table of the highest peak of each event."""
    elements = F.col("_el")
    cuts = nested_cuts(elements)
    source = summaries if run is None else readers.run_range(summaries, run, run)
    source = source.withColumn("_el", linear_elements(FIELDS, DIRECTIONS))
    flat = thermal_columns(source, elements, [], [cuts["highestPeak"]])
    if path:
        sinks.write(flat, path, by=["run"])
    return flat


def side_table(flat: DataFrame, columns: dict[str, Column], run: str, event: str) -> DataFrame:
    """A side table with its own id columns, computed from the flat table (beacon or surface data)."""
    return flat.select(*[c.alias(n) for n, c in columns.items()], F.col("eventNumber").alias(event), F.col("run").alias(run))


def refresh_flags(summaries: DataFrame, fresh: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Flags replaced by recomputed ones, for all events or a chosen list."""
    chosen = fresh if ids is None else joins.only_ids(fresh, ids, ["eventNumber"])
    return joins.overlay(summaries, chosen, ["eventNumber"], ["flags"])


def optimise_cuts(signal: DataFrame, background: DataFrame, names: Sequence[str], cuts: Sequence[Column]) -> learn.Discriminant:
    """Train the discriminant on two selections; only the named columns and the weight are read."""
    for c in cuts:
        signal, background = where(signal, c), where(background, c)
    return learn.train(signal, background, {n: scores.term(n) for n in names}, F.col("weight"))


def above_score(flat: DataFrame, below_threshold: float = 0.0) -> DataFrame:
    """Events over the score threshold, optionally lowered for a looser sample."""
    score = scores.linear_score(scores.SCORE_INTERCEPT, scores.SCORE_TERMS)
    return flat.filter(score > scores.SCORE_THRESHOLD - below_threshold)


def cluster_events(
    points: DataFrame, sites: DataFrame | None, thresholds: Sequence[float] = tuple(scores.LL_THRESHOLDS), surface: float = scores.SURFACE_SEPARATION_KM,
    simulated: DataFrame | None = None, horizon: float = scores.HORIZON_M / 1000, cut: Column | None = None,
) -> dict[str, DataFrame]:
    """Full clustering: known sites first if given, then event-event linking, then simulated events.

    ``points`` has id, x, y, sigma (km). Cuts are honoured.
    """
    used = points if cut is None else where(points, cut)
    labels = cl.threshold_clusters(used, F.col("sigma"), thresholds, surface)
    if sites is None:
        events = labels.select("z", "id", F.col("label").alias("cluster"), F.lit(False).alias("known"))
    else:
        matches = cl.site_matches(cl.by_threshold(used.select("id", "x", "y", "sigma"), F.col("sigma"), thresholds, surface), sites)
        events = cl.combined_clusters(used, cl.assign_sites(matches), labels)
    sizes = events.groupBy("z", "cluster", "known").agg(F.count("*").alias("n"))
    out = {"events": events, "clusters": sizes, "multiplicity": cl.multiplicity(sizes)}
    if simulated is not None:
        out["simulated"] = cl.attach_simulated(
            simulated, used, events.select("z", "id", F.col("cluster").alias("label")), F.col("sigma"), thresholds, surface, horizon
        )
    return out


def extend_clusters(points: DataFrame, added: DataFrame, **options) -> dict[str, DataFrame]:
    """Cluster new events together with those of an earlier run; new links may join old clusters."""
    return cluster_events(joins.merge_runs(points, added), options.pop("sites", None), **options)


def horizon_grid(spark: SparkSession, altitudes: tuple[float, float], angles: tuple[float, float], steps: int = 128) -> DataFrame:
    """Distance to the surface over a grid of payload altitude and viewing angle."""
    from firn.functions.geodesy import trace_to_surface

    def axis(k: Column, span: tuple[float, float]) -> Column:
        return F.lit(span[0]) + (k + 0.5) * F.lit((span[1] - span[0]) / steps)

    cells = spark.range(steps * steps).select(axis(F.col("id") % steps, altitudes).alias("altitude"), axis(F.floor(F.col("id") / steps), angles).alias("theta"))
    payload = {"longitude": F.lit(0.0), "latitude": F.lit(-80.0), "altitude": F.col("altitude"), "heading": F.lit(0.0)}
    return cells.withColumn("_h", trace_to_surface(payload, F.col("theta"), F.lit(0.0))).select("altitude", "theta", F.col("_h.distance").alias("distance"))


def run_profile(flat: DataFrame, value: Callable[[], Column]) -> DataFrame:
    """Mean and spread per run, leaving out the excluded runs."""
    from firn.operators.cuts import excluded_runs

    return flat.filter(excluded_runs(F.col("run"))).groupBy("run").agg(F.avg(value()).alias("mean"), F.stddev_pop(value()).alias("spread"), F.count("*").alias("entries"))
