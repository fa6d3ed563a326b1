"""Named, composable cuts.

A cut is a name, a rule and a kind: ``row`` rules use columns only, ``element`` rules also
take one [pol][direction] element. ``&`` is AND and ``~`` is NOT, as in cut algebra.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from firn.functions.angles import delta_angle
from firn.functions.compare import both, eq, finite, ge, gt, half_open, lt
from firn.functions.scores import (
    SCORE_INTERCEPT,
    SCORE_TERMS,
    SCORE_THRESHOLD,
    linear_score,
    window_gradient,
)
from firn.operators.elements import max_over


@dataclass(frozen=True)
class Cut:
    name: str
    rule: Callable[[Column | None], Column]
    per_element: bool = False

    def __call__(self, element: Column | None = None) -> Column:
        return self.rule(element)

    @property
    def column(self) -> Column:
        if self.per_element:
            raise TypeError(f"{self.name} needs an element")
        return self.rule(None)

    def __and__(self, other: "Cut") -> "Cut":
        return Cut(
            f"{self.name} && {other.name}",
            lambda e: both(self.rule(e), other.rule(e)),
            self.per_element or other.per_element,
        )

    def __or__(self, other: "Cut") -> "Cut":
        return Cut(
            f"({self.name} || {other.name})",
            lambda e: self.rule(e) | other.rule(e),
            self.per_element or other.per_element,
        )

    def __invert__(self) -> "Cut":
        return Cut(f"!({self.name})", lambda e: ~self.rule(e), self.per_element)


class Catalogue(dict):
    """Cuts by name; adding an existing name replaces it."""

    def row(self, name: str, rule: Callable[[], Column]) -> Cut:
        self[name] = Cut(name, lambda e: rule())
        return self[name]

    def element(self, name: str, rule: Callable[[Column], Column]) -> Cut:
        self[name] = Cut(name, rule, per_element=True)
        return self[name]

    def all_of(self, name: str, parts: Iterable[str]) -> Cut:
        cuts = [self[p] for p in parts]
        self[name] = Cut(
            name,
            lambda e: both(*[c.rule(e) for c in cuts]),
            any(c.per_element for c in cuts),
        )
        return self[name]


# Cut constants.
QUIET_TIME = (1419320000, 1420250000)
BLAST_SLOPE_0A = 30.0 / 7
BLAST_SLOPE_0B = 7.0 / 30
BLAST_OFFSET = 0.06
BLAST_SLOPE_1 = 1.0 / 0.28
BLAST_RATIO = 2.67
BLAST_HILBERT_SCALE = 14.0
BLAST_HILBERT_OFFSET = 1000.0
ROUGH_DEGREES = 4.0
PEAK_SHIFT_NS = (0.0, 20.0)
CLOSE_PHI = 5.5
CLOSE_THETA = 3.5
CLOSE_HICAL = 5.0
WAIS_RUNS = (331, 354)
LDB_LAST_RUN = 200
LDB_FLIGHT = 3
ROTATED_HILBERT = 100.0
ROTATED_PEAK = 0.15


def _c(name: str) -> Column:
    return F.col(name)


def _gradient(e: Column, waveform: str) -> Column:
    return window_gradient(e[waveform]["fracPowerWindowBegins"], e[waveform]["fracPowerWindowEnds"])


def nested_cuts(elements: Column, on_continent: Callable[[Column, Column], Column] | None = None, flight: int = LDB_FLIGHT) -> Catalogue:
    """Cuts for nested summaries; ``elements`` is the linear element array of a row.

    Only flight 3 bounds the runs of its LDB pulser.
    """
    c = Catalogue()
    flag = "flags.{}".format
    c.row("isRfTrigger", lambda: gt(_c(flag("isRF")), 0))
    c.row("isNotTaggedAsPulser", lambda: eq(_c(flag("pulser")), 0))
    c.row("quietTime", lambda: half_open(_c("realTime"), *QUIET_TIME))
    c.row("goodGPS", lambda: finite(_c("payloadLocation.heading")))
    c.row(
        "isGood",
        lambda: (gt(_c("mc.weight"), 0) & eq(_c(flag("isVarner")), 0) & eq(_c(flag("isPayloadBlast")), 0))
        | (eq(_c("mc.weight"), 0) & eq(_c(flag("isGood")), 1)),
    )
    c.row("isTaggedAsPayloadBlast", lambda: gt(_c(flag("isPayloadBlast")), 0))
    ldb_run = (lambda: lt(_c("run"), LDB_LAST_RUN)) if flight == LDB_FLIGHT else (lambda: F.lit(True))
    c.row("isTaggedAsLDBPulser", lambda: ldb_run() & eq(_c(flag("pulser")), 2))
    c.row("isTaggedAsWaisPulser", lambda: eq(_c(flag("pulser")), 1))
    c.row("isTaggedAsPulser", lambda: c["isTaggedAsLDBPulser"].column | c["isTaggedAsWaisPulser"].column)
    _blast_parts(
        c,
        lambda name, k: _c(flag(name))[k],
        lambda: F.array_max(_c(flag("maxBottomToTopRatio"))),
    )
    c.element("highestPeak", lambda e: eq(e["peak"]["value"], max_over(elements, lambda x: x["peak"]["value"])))

    def impulsivity(e: Column) -> Column:
        return e["deconvolved_filtered"]["impulsivityMeasure"]

    c.element("mostImpulsivePeak", lambda e: eq(impulsivity(e), max_over(elements, impulsivity)))
    c.element(
        "smallDeltaRough",
        lambda e: lt(F.abs(e["peak"]["dphi_rough"]), ROUGH_DEGREES) & lt(F.abs(e["peak"]["dtheta_rough"]), ROUGH_DEGREES),
    )
    c.element(
        "higherHilbertPeakAfterDedispersion",
        lambda e: gt(e["deconvolved_filtered"]["peakHilbert"], e["coherent_filtered"]["peakHilbert"]),
    )
    c.element(
        "higherImpulsivityMeasureAfterDedispersion",
        lambda e: gt(impulsivity(e), e["coherent_filtered"]["impulsivityMeasure"]),
    )
    c.element(
        "lowerFracPowerWindowGradientAfterDedispersion",
        lambda e: lt(_gradient(e, "deconvolved_filtered"), _gradient(e, "coherent_filtered")),
    )

    def peak_shift(e: Column) -> Column:
        return e["coherent_filtered"]["peakTime"] - e["deconvolved_filtered"]["peakTime"]

    c.element(
        "reasonableHilbertPeakTimeShiftAfterDedispersion",
        lambda e: gt(peak_shift(e), PEAK_SHIFT_NS[0]) & lt(peak_shift(e), PEAK_SHIFT_NS[1]),
    )
    c.element(
        "isOnContinent",
        lambda e: (on_continent or _no_map)(e["peak"]["longitude"], e["peak"]["latitude"]),
    )
    # NULL is the 'no location' marker here, so a location exists when latitude is known.
    c.element(
        "hasSourceLocation",
        lambda e: e["peak"]["latitude"].isNotNull() | gt(F.abs(e["peak"]["theta_adjustment_needed"]), 0),
    )
    c.element("isAboveHorizontal", lambda e: gt(e["peak"]["theta"], 0))
    c.element("isBelowHorizontal", lambda e: lt(e["peak"]["theta"], 0))
    c.element(
        "newPayloadBlastCutPart3",
        lambda e: gt(
            BLAST_HILBERT_SCALE * e["deconvolved_filtered"]["peakHilbert"],
            (1 + F.get(_c(flag("maxBottomToTopRatio")), e["pol"])) * F.get(_c(flag("minBottomToTopRatio")), e["pol"])
            - BLAST_HILBERT_OFFSET,
        ),
    )
    c.all_of("isGood2", [f"newPayloadBlastCutPart{p}" for p in ("0A", "0B", "1", "2", "3")])
    return c


def _no_map(longitude: Column, latitude: Column) -> Column:
    raise ValueError("give on_continent: this package ships no terrain map")


def _blast_parts(c: Catalogue, power: Callable[[str, int], Column], max_ratio: Callable[[], Column]) -> None:
    mid, top = "middleOrBottomPower", "topPower"
    c.row("newPayloadBlastCutPart0A", lambda: lt(power(mid, 0), BLAST_SLOPE_0A * power(top, 0) + BLAST_OFFSET))
    c.row("newPayloadBlastCutPart0B", lambda: gt(power(mid, 0), BLAST_SLOPE_0B * (power(top, 0) - BLAST_OFFSET)))
    c.row("newPayloadBlastCutPart1", lambda: lt(power(mid, 1), BLAST_SLOPE_1 * power(top, 1)))
    c.row("newPayloadBlastCutPart2", lambda: lt(max_ratio(), BLAST_RATIO))


def flat_cuts(on_continent: Callable[[Column, Column], Column] | None = None) -> Catalogue:
    """Cuts for the flat one-row-per-event table and its side tables."""
    c = Catalogue()

    def d_phi(other: str) -> Column:
        return F.abs(delta_angle(_c("peak_phi") - _c(other)))

    def d_theta(other: str) -> Column:
        return F.abs(_c("peak_theta") + _c(other))

    c.row(
        "closeToMC",
        lambda: eq(_c("weight"), 1) | (lt(d_phi("mc_phi"), CLOSE_PHI) & lt(d_theta("mc_theta"), CLOSE_THETA)),
    )
    c.row("closeToWais", lambda: lt(d_phi("wais_phi"), CLOSE_PHI) & lt(d_theta("wais_theta"), CLOSE_THETA))
    c.row("closeToHiCal", lambda: gt(_c("duringHiCal"), 0) & lt(d_phi("hiCalPhi"), CLOSE_HICAL))
    c.row(
        "smallDeltaRough",
        lambda: lt(F.abs(_c("peak_dphi_rough")), ROUGH_DEGREES) & lt(F.abs(_c("peak_dtheta_rough")), ROUGH_DEGREES),
    )
    c.row("isAboveHorizontal", lambda: gt(_c("peak_theta"), 0))
    c.row("quietTime", lambda: half_open(_c("realTime"), *QUIET_TIME))
    c.row("isNotTaggedAsPulser", lambda: eq(_c("flags_pulser"), 0))
    c.row("isTaggedAsWaisPulser", lambda: eq(_c("flags_pulser"), 1) & _c("run").between(*WAIS_RUNS))
    c.row("realSnr", lambda: finite(_c("coherent_filtered_snr")) & finite(_c("deconvolved_filtered_snr")))
    c.row("isRF", lambda: gt(_c("flags_isRF"), 0))
    c.row("notShortWaveform", lambda: eq(_c("flags_isVarner2"), 0))
    c.row("goodGps", lambda: finite(_c("payloadLocation_heading")))
    _blast_parts(
        c,
        lambda name, k: _c(f"flags_{name}_{k}"),
        lambda: F.greatest(_c("flags_maxBottomToTopRatio_0"), _c("flags_maxBottomToTopRatio_1")),
    )

    def blast_limit(k: int) -> Column:
        return (1 + _c(f"flags_maxBottomToTopRatio_{k}")) * _c(f"flags_minBottomToTopRatio_{k}") - BLAST_HILBERT_OFFSET

    c.row(
        "newPayloadBlastCutPart3",
        lambda: gt(
            BLAST_HILBERT_SCALE * _c("deconvolved_filtered_peakHilbert"),
            F.when(_c("pol") == 0, blast_limit(0)).when(_c("pol") == 1, blast_limit(1)).otherwise(0.0),
        ),
    )
    c.row(
        "notInBlastRotatedCrossCorrelationRegion",
        lambda: ~(gt(_c("coherent_filtered_peakHilbert"), ROTATED_HILBERT) & lt(_c("peak_value"), ROTATED_PEAK)),
    )
    c.all_of(
        "notPayloadBlast",
        [f"newPayloadBlastCutPart{p}" for p in ("0A", "0B", "1", "2", "3")] + ["notInBlastRotatedCrossCorrelationRegion"],
    )
    c.all_of("passAllQualityCuts", ["notPayloadBlast", "notShortWaveform", "realSnr", "goodGps", "smallDeltaRough"])
    c.row("notAboveHorizontal", lambda: ~c["isAboveHorizontal"].column)
    c.all_of("analysisSample", ["isRF", "notAboveHorizontal", "isNotTaggedAsPulser"])
    c.all_of("thermalSideBand", ["isRF", "isAboveHorizontal", "isNotTaggedAsPulser"])
    for name, measure, higher in (
        ("higherHilbertPeakAfterDedispersion", "peakHilbert", True),
        ("higherImpulsivityMeasureAfterDedispersion", "impulsivityMeasure", True),
        ("lowerFracPowerWindowGradientAfterDedispersion", "fracPowerWindowGradient", False),
    ):
        compare = gt if higher else lt
        c.row(
            name,
            lambda m=measure, f=compare: f(_c(f"deconvolved_filtered_{m}"), _c(f"coherent_filtered_{m}")),
        )
    c.row("fisherCut", lambda: gt(linear_score(SCORE_INTERCEPT, SCORE_TERMS), SCORE_THRESHOLD))
    c.row(
        "continentNotIceShelf",
        lambda: (on_continent or _no_map)(_c("longitude"), _c("latitude")),
    )
    return c


def excluded_runs(run: Column, first: int = 257, last: int = 263) -> Column:
    return ~run.between(first, last)


def event_mode(mode: str, is_wais: Column, is_decimated: Column) -> Column:
    """Which events a pass over raw data handles: all, pulser-timed, or the decimated sample."""
    rules = {"all": F.lit(True), "wais": is_wais, "decimated": is_decimated}
    return rules[mode]
