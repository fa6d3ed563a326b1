"""Queries over a flat one-row-per-event table derived from ``lineitem``.

The derivation is plain arithmetic written once in SQL both engines share; the operators
under test are written in each engine's own way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from firn.functions import scores
from firn.functions.compare import where
from firn.operators.cutflow import cut_flow, efficiency, with_percent
from firn.operators.cuts import Catalogue, excluded_runs, flat_cuts
from firn.operators.learn import fisher, moments
from firn.plans.registry import query, table

# One expression per column of the flat table.
COLUMNS = {
    "run": "130 + l_partkey % 310",
    "eventNumber": "l_orderkey * 8 + l_linenumber",
    "realTime": "1419300000 + l_partkey * 100 + l_suppkey",
    "mc_weight": "CASE WHEN l_linestatus = 'O' THEN l_tax ELSE 0.0 END",
    "weight": "CASE WHEN l_linestatus = 'O' AND l_tax > 0 THEN l_tax ELSE 1.0 END",
    "mc_phi": "l_extendedprice % 360.0",
    "mc_theta": "25.0 - l_quantity",
    "wais_phi": "l_suppkey % 360 + l_discount",
    "wais_theta": "24.0 - l_quantity",
    "peak_value": "l_discount * 4.0 + l_tax",
    "peak_phi": "(l_extendedprice + l_linenumber * 3.0) % 360.0",
    "peak_theta": "l_quantity - 25.5",
    "peak_dphi_rough": "(l_suppkey % 100) * 0.1 - 4.5",
    "peak_dtheta_rough": "(l_partkey % 100) * 0.1 - 4.5",
    "pol": "CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END",
    "peakInd": "l_linenumber % 5",
    "coherent_filtered_fracPowerWindowGradient": "l_tax * 100.0 - 2.0",
    "deconvolved_filtered_fracPowerWindowGradient": "l_discount * 100.0 - 4.0",
    "coherent_filtered_impulsivityMeasure": "l_discount * 6.0",
    "deconvolved_filtered_impulsivityMeasure": "l_discount * 5.0 + l_tax * 3.0",
    "coherent_filtered_peakHilbert": "l_quantity * 4.0",
    "deconvolved_filtered_peakHilbert": "l_extendedprice * 0.005",
    "coherent_filtered_peakTime": "l_quantity",
    "deconvolved_filtered_peakTime": "l_quantity - l_discount * 250.0",
    "coherent_filtered_snr": "CASE WHEN l_suppkey % 13 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity * 0.25 END",
    "deconvolved_filtered_snr": "l_quantity * 0.3",
    "flags_middleOrBottomPower_0": "l_quantity * 0.01",
    "flags_middleOrBottomPower_1": "l_quantity * 0.01",
    "flags_topPower_0": "l_discount * 3.0",
    "flags_topPower_1": "l_discount * 3.0 + 0.05",
    "flags_maxBottomToTopRatio_0": "l_quantity * 0.055",
    "flags_maxBottomToTopRatio_1": "(51.0 - l_quantity) * 0.055",
    "flags_minBottomToTopRatio_0": "l_extendedprice * 0.01",
    "flags_minBottomToTopRatio_1": "l_extendedprice * 0.012",
    "flags_pulser": "l_linenumber % 3",
    "flags_isRF": "CASE WHEN l_linenumber = 4 THEN 0 ELSE 1 END",
    "flags_isPayloadBlast": "CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END",
    "flags_isVarner": "CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END",
    "flags_isVarner2": "CASE WHEN l_partkey % 17 = 0 THEN 1 ELSE 0 END",
    "payloadLocation_heading": "CASE WHEN l_partkey % 19 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_partkey % 360 END",
    "longitude": "(l_partkey % 3600) * 0.1 - 180.0",
    "latitude": "-60.0 - (l_suppkey % 300) * 0.1",
    "duringHiCal": "CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END",
    "hiCalPhi": "(l_extendedprice + 7.0) % 360.0",
}
# A land mask made of whole degrees stands in for the terrain map that is not shipped.
LAND_SQL = "floor(longitude) % 3 <> 0 AND latitude < -65"
FLAT_SQL = "WITH flat AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in COLUMNS.items()) + " FROM lineitem)"


def flat_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(*[F.expr(e).alias(n) for n, e in COLUMNS.items()])


def catalogue() -> Catalogue:
    return flat_cuts(lambda lon, lat: (F.floor(lon) % 3 != 0) & (lat < -65))


def _wrap(d: str) -> str:
    return f"({d} - 360.0 * floor(({d} + 180.0) / 360.0))"


_SCORE_SQL = (
    "0.898497 + 1.929594 * coherent_filtered_fracPowerWindowGradient / nullif(deconvolved_filtered_fracPowerWindowGradient, 0)"
    " - 0.195909 * deconvolved_filtered_fracPowerWindowGradient + 5.943355 * coherent_filtered_impulsivityMeasure"
    " + 0.826114 * deconvolved_filtered_impulsivityMeasure + 0.021763 * coherent_filtered_peakHilbert"
    " - 0.012670 * deconvolved_filtered_peakHilbert - 0.394201 * peak_value"
)
_P0A = "flags_middleOrBottomPower_0 < 30.0 / 7 * flags_topPower_0 + 0.06"
_P0B = "flags_middleOrBottomPower_0 > 7.0 / 30 * (flags_topPower_0 - 0.06)"
_P1 = "flags_middleOrBottomPower_1 < 1.0 / 0.28 * flags_topPower_1"
_P2 = "greatest(flags_maxBottomToTopRatio_0, flags_maxBottomToTopRatio_1) < 2.67"
_P3 = (
    "14.0 * deconvolved_filtered_peakHilbert > CASE WHEN pol = 0"
    " THEN (1 + flags_maxBottomToTopRatio_0) * flags_minBottomToTopRatio_0 - 1000"
    " ELSE (1 + flags_maxBottomToTopRatio_1) * flags_minBottomToTopRatio_1 - 1000 END"
)
_ROT = "NOT (coherent_filtered_peakHilbert > 100 AND peak_value < 0.15)"
_NOT_BLAST = " AND ".join(f"({p})" for p in (_P0A, _P0B, _P1, _P2, _P3, _ROT))
_SNR = "NOT isnan(coherent_filtered_snr) AND NOT isnan(deconvolved_filtered_snr) AND isfinite(coherent_filtered_snr)"
_ROUGH = "abs(peak_dphi_rough) < 4.0 AND abs(peak_dtheta_rough) < 4.0"
CUT_SQL = {
    "closeToMC": f"weight = 1 OR (abs({_wrap('(peak_phi - mc_phi)')}) < 5.5 AND abs(peak_theta + mc_theta) < 3.5)",
    "closeToWais": f"abs({_wrap('(peak_phi - wais_phi)')}) < 5.5 AND abs(peak_theta + wais_theta) < 3.5",
    "closeToHiCal": f"duringHiCal > 0 AND abs({_wrap('(peak_phi - hiCalPhi)')}) < 5",
    "smallDeltaRough": _ROUGH,
    "isAboveHorizontal": "peak_theta > 0",
    "quietTime": '"realTime" >= 1419320000 AND "realTime" < 1420250000',
    "isNotTaggedAsPulser": "flags_pulser = 0",
    "isTaggedAsWaisPulser": "flags_pulser = 1 AND run >= 331 AND run <= 354",
    "realSnr": _SNR,
    "isRF": "flags_isRF > 0",
    "notShortWaveform": "flags_isVarner2 = 0",
    "goodGps": "isfinite(payloadLocation_heading)",
    "newPayloadBlastCutPart0A": _P0A,
    "newPayloadBlastCutPart0B": _P0B,
    "newPayloadBlastCutPart1": _P1,
    "newPayloadBlastCutPart2": _P2,
    "newPayloadBlastCutPart3": _P3,
    "notInBlastRotatedCrossCorrelationRegion": _ROT,
    "notPayloadBlast": _NOT_BLAST,
    "passAllQualityCuts": f"({_NOT_BLAST}) AND flags_isVarner2 = 0 AND {_SNR} AND isfinite(payloadLocation_heading) AND {_ROUGH}",
    "analysisSample": "flags_isRF > 0 AND NOT peak_theta > 0 AND flags_pulser = 0",
    "thermalSideBand": "flags_isRF > 0 AND peak_theta > 0 AND flags_pulser = 0",
    "higherHilbertPeakAfterDedispersion": "deconvolved_filtered_peakHilbert > coherent_filtered_peakHilbert",
    "higherImpulsivityMeasureAfterDedispersion": "deconvolved_filtered_impulsivityMeasure > coherent_filtered_impulsivityMeasure",
    "lowerFracPowerWindowGradientAfterDedispersion": "deconvolved_filtered_fracPowerWindowGradient < coherent_filtered_fracPowerWindowGradient",
    "fisherCut": f"({_SCORE_SQL}) > 5.800012",
    "continentNotIceShelf": LAND_SQL,
}
FLOW = ["isRF", "goodGps", "notPayloadBlast", "smallDeltaRough", "isNotTaggedAsPulser", "higherHilbertPeakAfterDedispersion"]


def _flow_sql(preselect: bool) -> str:
    rows = []
    flags = [f"coalesce(({CUT_SQL[n]}), false)" for n in FLOW]
    for i, name in enumerate(FLOW):
        first = flags[:1] if preselect else []
        seq = flags[: i + 1]
        only = first + ([flags[i]] if i or not preselect else [])
        without = first + [f for j, f in enumerate(flags) if j != i and not (preselect and j == 0)]
        sums = [
            f"round(CAST(sum(CASE WHEN {' AND '.join(c)} THEN weight ELSE 0 END) AS DOUBLE), 4) AS {label}"
            for label, c in (("in_sequence", seq), ("if_only", only), ("if_not", without))
        ]
        rows.append(f"SELECT {i} AS cut_index, '{name}' AS cut, {', '.join(sums)} FROM flat")
    return f"{FLAT_SQL} " + " UNION ALL ".join(rows)


def _flow(spark: SparkSession, folder: str, preselect: bool) -> DataFrame:
    cuts = catalogue()
    flow = cut_flow(flat_events(spark, folder), [(n, cuts[n].column) for n in FLOW], F.col("weight"), preselect)
    return flow.select("cut_index", "cut", *[F.round(c, 4).alias(c) for c in ("in_sequence", "if_only", "if_not")])


@query("cut_flow", _flow_sql(True))
def _cut_flow(spark, folder):
    return _flow(spark, folder, True)


@query("cut_flow_free", _flow_sql(False))
def _cut_flow_free(spark, folder):
    return _flow(spark, folder, False)


_PCT = ", ".join(
    f"format('{{:.2f}} ({{:.2f}}%)', {c}, 100 * {c} / total) AS {c}_text" for c in ("in_sequence", "if_only", "if_not")
)


@query(
    "fmt_pct",
    f"SELECT cut_index, cut, {_PCT} FROM ({_flow_sql(True)}) f CROSS JOIN "
    f"(SELECT in_sequence AS total FROM ({_flow_sql(True)}) WHERE cut_index = 0) t",
)
def _fmt_pct(spark, folder):
    return with_percent(_flow(spark, folder, True))


@query(
    "named_cuts",
    FLAT_SQL
    + " "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS cut, CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE NOT coalesce(({c}), false)) AS BIGINT) AS failed FROM flat"
        for n, c in CUT_SQL.items()
    ),
)
def _named_cuts(spark, folder):
    """Every named cut and its negation, counted in one scan."""
    cuts = catalogue()
    flags = flat_events(spark, folder).select(*[cuts[n].column.alias(n) for n in CUT_SQL])
    aggs = [
        F.struct(F.lit(n).alias("cut"), F.count_if(F.col(n)).alias("passed"), F.count_if(~F.col(n)).alias("failed")) for n in CUT_SQL
    ]
    return flags.agg(F.array(*aggs).alias("rows")).select(F.inline("rows"))


@query(
    "cut_scalar_and",
    f"{FLAT_SQL} SELECT run, CAST(count(*) AS BIGINT) AS n, round(CAST(sum(weight) AS DOUBLE), 4) AS weight FROM flat"
    f" WHERE {CUT_SQL['analysisSample']} AND {CUT_SQL['smallDeltaRough']} AND NOT ({CUT_SQL['closeToHiCal']})"
    " AND NOT (run BETWEEN 257 AND 263) GROUP BY run",
)
def _cut_scalar_and(spark, folder):
    c = catalogue()
    chosen = c["analysisSample"] & c["smallDeltaRough"] & ~c["closeToHiCal"]
    kept = where(flat_events(spark, folder), chosen.column, excluded_runs(F.col("run")))
    return kept.groupBy("run").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query(
    "cut_boxes",
    f"{FLAT_SQL} SELECT CAST(count(*) FILTER (WHERE longitude >= 150 AND longitude < 180 AND latitude >= -85 AND latitude < -75) AS BIGINT) AS near_station,"
    " CAST(count(*) FILTER (WHERE longitude >= -90 AND longitude < 90) AS BIGINT) AS sandbox,"
    " CAST(count(*) FILTER (WHERE longitude >= 150 OR longitude < 90) AS BIGINT) AS either FROM flat",
)
def _cut_boxes(spark, folder):
    near, box = scores.near_station(F.col("longitude"), F.col("latitude")), scores.in_sandbox(F.col("longitude"))
    wide = (F.col("longitude") >= 150) | (F.col("longitude") < 90)
    return flat_events(spark, folder).agg(
        F.count_if(near).alias("near_station"), F.count_if(box).alias("sandbox"), F.count_if(wide).alias("either")
    )


@query(
    "weight_expr",
    "SELECT l_returnflag AS flag, round(CAST(sum(CASE WHEN w > 0 THEN w WHEN w = 0 THEN 1 ELSE 0 END) AS DOUBLE), 4) AS weight FROM"
    " (SELECT l_returnflag, CASE WHEN l_linestatus = 'O' THEN l_tax ELSE l_discount - 0.05 END AS w FROM lineitem) GROUP BY 1",
)
def _weight_expr(spark, folder):
    raw = F.when(F.col("l_linestatus") == "O", F.col("l_tax")).otherwise(F.col("l_discount") - 0.05)
    df = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), scores.event_weight(raw).alias("w"))
    return df.groupBy("flag").agg(F.round(F.sum("w"), 4).alias("weight"))


@query(
    "linear_score",
    f'{FLAT_SQL} SELECT "eventNumber" % 100 AS bucket, CAST(count(s) AS BIGINT) AS n, round(avg(s), 6) AS mean_score, round(max(s), 6) AS top'
    f' FROM (SELECT "eventNumber", {_SCORE_SQL} AS s FROM flat) GROUP BY 1',
)
def _linear_score(spark, folder):
    score = scores.linear_score(scores.SCORE_INTERCEPT, scores.SCORE_TERMS)
    df = flat_events(spark, folder).select((F.col("eventNumber") % 100).alias("bucket"), score.alias("s"))
    return df.groupBy("bucket").agg(
        F.count("s").alias("n"), F.round(F.avg("s"), 6).alias("mean_score"), F.round(F.max("s"), 6).alias("top")
    )


@query(
    "score_cut",
    f'{FLAT_SQL} SELECT run, CAST(count(*) AS BIGINT) AS n FROM flat WHERE ({_SCORE_SQL}) > 5.800012 AND {CUT_SQL["isRF"]} GROUP BY run',
)
def _score_cut(spark, folder):
    c = catalogue()
    return flat_events(spark, folder).filter((c["fisherCut"] & c["isRF"]).column).groupBy("run").agg(F.count("*").alias("n"))


_FISHER_NAMES = ["peak_value", "coherent_filtered_impulsivityMeasure", "coherent_filtered_peakHilbert", "deconvolved_filtered_peakHilbert"]
_FISHER_SUMS = ", ".join(
    ["round(CAST(sum(weight) AS DOUBLE), 3) AS w"]
    + [f"round(CAST(sum(weight * {n}) AS DOUBLE), 3) AS s_{n}" for n in _FISHER_NAMES]
    + [
        f"round(CAST(sum(weight * {a} * {b}) AS DOUBLE), 2) AS s_{a}_{b}"
        for i, a in enumerate(_FISHER_NAMES)
        for b in _FISHER_NAMES[i:]
    ]
)


@query("fisher_moments", f"{FLAT_SQL} SELECT CASE WHEN mc_weight > 0 THEN 1 ELSE 0 END AS label, {_FISHER_SUMS} FROM flat GROUP BY 1")
def _fisher_moments(spark, folder):
    made = _fisher_table(spark, folder)
    squares = {f"s_{a}_{b}" for a in _FISHER_NAMES for b in _FISHER_NAMES}
    return made.select("label", *[F.round(c, 2 if c in squares else 3).alias(c) for c in made.columns if c != "label"])


def _fisher_table(spark: SparkSession, folder: str) -> DataFrame:
    df = flat_events(spark, folder)
    label = F.when(F.col("mc_weight") > 0, 1).otherwise(0)
    return moments(df, label, {n: F.col(n) for n in _FISHER_NAMES}, F.col("weight"))


@query("fisher_train")
def _fisher_train(spark, folder):
    """Train on simulated against data rows, then the mean score of each class."""
    trained = fisher(_fisher_table(spark, folder), _FISHER_NAMES)
    df = flat_events(spark, folder).select(F.when(F.col("mc_weight") > 0, 1).otherwise(0).alias("label"), trained.score().alias("s"))
    return df.groupBy("label").agg(F.avg("s").alias("mean_score"), F.stddev_pop("s").alias("spread"))


@query(
    "efficiency",
    f"{FLAT_SQL} SELECT CAST(floor(coherent_filtered_peakHilbert / 20) AS BIGINT) AS bin,"
    f" round(CAST(sum(CASE WHEN {CUT_SQL['higherHilbertPeakAfterDedispersion']} THEN weight ELSE 0 END) AS DOUBLE), 4) AS passed,"
    f" round(CAST(sum(weight) AS DOUBLE), 4) AS total,"
    f" round(CAST(sum(CASE WHEN {CUT_SQL['higherHilbertPeakAfterDedispersion']} THEN weight ELSE 0 END) / sum(weight) AS DOUBLE), 6) AS efficiency FROM flat GROUP BY 1",
)
def _efficiency(spark, folder):
    passed = catalogue()["higherHilbertPeakAfterDedispersion"].column
    out = efficiency(flat_events(spark, folder), F.floor(F.col("coherent_filtered_peakHilbert") / 20), passed, F.col("weight"))
    return out.select("bin", F.round("passed", 4).alias("passed"), F.round("total", 4).alias("total"), F.round("efficiency", 6).alias("efficiency"))


@query(
    "resolution_model",
    "SELECT l_quantity AS q, round(exp(-2.50414e-01 * (l_quantity * 0.25) + 3.02406e-01) + 2.43376e-01, 6) AS phi3,"
    " round(exp(-3.83773e-01 * (l_quantity * 0.25) - 3.00964e-01) + 1.64537e-01, 6) AS theta3,"
    " round(5.09057 / (pow(l_quantity * 0.25, 8.01369e-01) + 1), 6) AS phi4,"
    " round(1.34307 / (pow(l_quantity * 0.25, 7.09382e-01) + 1), 6) AS theta4, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_quantity",
)
def _resolution_model(spark, folder):
    snr = F.col("q") * 0.25
    df = table(spark, folder, "lineitem").groupBy(F.col("l_quantity").alias("q")).agg(F.count("*").alias("n"))
    models = {f"{axis}{m}": F.round(scores.resolution(snr, axis, m), 6) for m in (3, 4) for axis in ("phi", "theta")}
    return df.select("q", *[c.alias(n) for n, c in models.items()], "n")


@query(
    "pulser_flags",
    "WITH t AS (SELECT 130 + l_partkey % 60 AS run, CAST(l_suppkey * 2500000 + l_linenumber * 300 AS BIGINT) AS trig,"
    " CAST(l_suppkey * 2500000 + l_partkey % 3000 AS BIGINT) AS wais, CAST((l_suppkey % 20) * 2500000 + 400 AS BIGINT) AS ldb FROM lineitem),"
    " f AS (SELECT *, wais < 1e6 / 0.3 AND abs(trig - wais) < 1200 AS isw, ldb < 1e6 / 0.3 AND"
    " abs((trig - ldb) % 199996850 - CASE WHEN run < 150 THEN 25000000 WHEN run < 172 THEN 50000000 ELSE 0 END - 500) < 1200 AS isl FROM t)"
    " SELECT run, CASE WHEN isw THEN 1 WHEN isl THEN 2 ELSE 0 END AS pulser, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2",
)
def _pulser_flags(spark, folder):
    df = table(spark, folder, "lineitem").select(
        (130 + F.col("l_partkey") % 60).alias("run"),
        (F.col("l_suppkey") * 2500000 + F.col("l_linenumber") * 300).alias("trig"),
        (F.col("l_suppkey") * 2500000 + F.col("l_partkey") % 3000).alias("wais"),
        ((F.col("l_suppkey") % 20) * 2500000 + 400).alias("ldb"),
    )
    flag = scores.pulser_flag(F.col("run"), F.col("trig"), F.col("wais"), F.col("ldb"))
    return df.groupBy("run", flag.alias("pulser")).agg(F.count("*").alias("n"))


@query(
    "run_profile",
    f"{FLAT_SQL} SELECT run, round(avg(peak_value), 6) AS mean, round(stddev_pop(peak_value), 6) AS spread, CAST(count(*) AS BIGINT) AS entries FROM flat"
    " WHERE NOT run BETWEEN 257 AND 263 GROUP BY 1",
)
def _run_profile(spark, folder):
    df = flat_events(spark, folder).filter(excluded_runs(F.col("run")))
    return df.groupBy("run").agg(
        F.round(F.avg("peak_value"), 6).alias("mean"), F.round(F.stddev_pop("peak_value"), 6).alias("spread"), F.count("*").alias("entries")
    )
