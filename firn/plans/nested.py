"""Queries over nested event summaries derived from ``embeddings``.

Each vector of 64 numbers becomes one summary: ten [polarisation][direction] elements of
six numbers, and four numbers for the event. Also element cuts over ``lineitem`` grouped by
order, where elements are rows and every step is a map-side-combined aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from firn.functions.angles import delta_angle
from firn.functions.scores import event_weight, window_gradient
from firn.operators.cuts import nested_cuts
from firn.operators.elements import (
    any_pass,
    best_element,
    explode_elements,
    flatten_first,
    kth_best,
    linear_elements,
    max_over,
    skim,
    survivors_per_cut,
)
from firn.operators.histogram import Axis, hist1d
from firn.plans.registry import query, table

PER_ELEMENT = 6
DIRECTIONS = 5
ELEMENTS = 10
WINDOWS = 5


def summaries_from_vectors(vectors: DataFrame) -> DataFrame:
    """Nested summary rows: peak, coherent_filtered, deconvolved_filtered, flags, mc, payloadLocation."""
    e = F.col("embedding")

    def v(i: int, k: int) -> Column:
        return e[i * PER_ELEMENT + k].cast("double")

    def peak(i: int) -> Column:
        return F.struct(
            F.abs(v(i, 0)).alias("value"), (v(i, 1) * 360.0).alias("phi"), (v(i, 2) * 50.0).alias("theta"),
            (v(i, 3) * 20.0).alias("dphi_rough"), (v(i, 4) * 20.0).alias("dtheta_rough"),
            (v(i, 1) * 180.0).alias("longitude"), (v(i, 2) * 30.0 - 75.0).alias("latitude"),
            v(i, 5).alias("theta_adjustment_needed"), (v(i, 3) * 10.0).alias("hwAngle"), (v(i, 4) * 10.0).alias("hwAngleXPol"),
        )

    def waveform(i: int, a: int, b: int, c: int) -> Column:
        return F.struct(
            (F.abs(v(i, a)) * 500.0).alias("peakHilbert"), F.abs(v(i, b)).alias("impulsivityMeasure"),
            (v(i, c) * 50.0).alias("peakTime"), (F.abs(v(i, b)) * 40.0).alias("snr"),
            F.array(*[v(i, a) * (w + 1) for w in range(WINDOWS)]).alias("fracPowerWindowBegins"),
            F.array(*[F.abs(v(i, c)) * (w + 2) for w in range(WINDOWS)]).alias("fracPowerWindowEnds"),
        )

    def nested(build) -> Column:
        return F.array(*[F.array(*[build(p * DIRECTIONS + d) for d in range(DIRECTIONS)]) for p in range(2)])

    def spare(k: int) -> Column:
        return e[60 + k].cast("double")

    return vectors.select(
        (130 + F.col("label")).alias("run"),
        F.col("vec_id").alias("eventNumber"),
        (F.col("vec_id") * 2000 + 1419300000).alias("realTime"),
        nested(peak).alias("peak"),
        nested(lambda i: waveform(i, 4, 5, 3)).alias("coherent_filtered"),
        nested(lambda i: waveform(i, 1, 2, 0)).alias("deconvolved_filtered"),
        F.struct(
            F.when(F.col("label") == 9, 0).otherwise(1).alias("isRF"), (F.col("label") % 4).alias("pulser"),
            F.when(spare(0) > 0.1, 1).otherwise(0).alias("isVarner"), F.when(spare(0) > 0, 1).otherwise(0).alias("isGood"),
            F.when(spare(1) > 0.15, 1).otherwise(0).alias("isPayloadBlast"),
            F.array(F.abs(spare(0)), F.abs(spare(1))).alias("middleOrBottomPower"),
            F.array(F.abs(spare(2)), F.abs(spare(3))).alias("topPower"),
            F.array(F.abs(spare(0)) * 20.0, F.abs(spare(1)) * 20.0).alias("maxBottomToTopRatio"),
            F.array(F.abs(spare(2)) * 5000.0, F.abs(spare(3)) * 5000.0).alias("minBottomToTopRatio"),
        ).alias("flags"),
        F.struct((spare(3) * 180.0).alias("heading")).alias("payloadLocation"),
        F.struct(
            F.when(F.col("label") < 3, F.abs(spare(2))).otherwise(0.0).alias("weight"), (spare(0) * 360.0).alias("phi"),
            (spare(1) * 50.0).alias("theta"),
        ).alias("mc"),
        F.struct((spare(2) * 360.0).alias("phi"), (spare(3) * 50.0).alias("theta")).alias("wais"),
    )


def _events(spark: SparkSession, folder: str) -> tuple[DataFrame, Column]:
    df = summaries_from_vectors(table(spark, folder, "embeddings"))
    return df, linear_elements(["peak", "coherent_filtered", "deconvolved_filtered"], DIRECTIONS)


def _d(i: str, k: int) -> str:
    return f"CAST(embedding[{i} * 6 + {k + 1}] AS DOUBLE)"


def _sp(k: int) -> str:
    return f"CAST(embedding[{61 + k}] AS DOUBLE)"


def _gradient_sql(start: int, stop: int) -> str:
    def width(w: int) -> str:
        return f"(abs({_d('i', stop)}) * {w + 2} - {_d('i', start)} * {w + 1})"

    return f"10.0 * (-0.2 * {width(0)} - 0.1 * {width(1)} + 0.1 * {width(3)} + 0.2 * {width(4)})"


NESTED_SQL = f"""WITH el AS (
 SELECT vec_id AS "eventNumber", label, 130 + label AS run, i, i // 5 AS pol, i % 5 AS ind,
 abs({_d('i', 0)}) AS value, {_d('i', 1)} * 360.0 AS phi, {_d('i', 2)} * 50.0 AS theta,
 {_d('i', 3)} * 20.0 AS dphi, {_d('i', 4)} * 20.0 AS dtheta,
 abs({_d('i', 4)}) * 500.0 AS c_hil, abs({_d('i', 5)}) AS c_imp, {_d('i', 3)} * 50.0 AS c_time,
 abs({_d('i', 1)}) * 500.0 AS d_hil, abs({_d('i', 2)}) AS d_imp, {_d('i', 0)} * 50.0 AS d_time,
 {_gradient_sql(4, 3)} AS c_grad, {_gradient_sql(1, 0)} AS d_grad,
 {_sp(0)} AS s0, {_sp(1)} AS s1, {_sp(2)} AS s2, {_sp(3)} AS s3,
 CASE WHEN label < 3 THEN abs({_sp(2)}) ELSE 0.0 END AS mc_weight
 FROM embeddings, range(0, 10) AS r(i)),
 e AS (SELECT *, max(value) OVER (PARTITION BY "eventNumber") AS top, max(d_imp) OVER (PARTITION BY "eventNumber") AS top_imp,
  CASE WHEN pol = 0 THEN (1 + abs(s0) * 20) * abs(s2) * 5000 ELSE (1 + abs(s1) * 20) * abs(s3) * 5000 END - 1000 AS blast3 FROM el)"""
ROW_CUT_SQL = {
    "isRfTrigger": "label <> 9",
    "isNotTaggedAsPulser": "label % 4 = 0",
    "newPayloadBlastCutPart0A": "abs(s0) < 30.0 / 7 * abs(s2) + 0.06",
    "newPayloadBlastCutPart0B": "abs(s0) > 7.0 / 30 * (abs(s2) - 0.06)",
    "newPayloadBlastCutPart1": "abs(s1) < 1.0 / 0.28 * abs(s3)",
    "newPayloadBlastCutPart2": "greatest(abs(s0), abs(s1)) * 20.0 < 2.67",
    "goodGPS": "isfinite(s3 * 180.0)",
    "isGood": "(mc_weight > 0 AND NOT s0 > 0.1 AND NOT s1 > 0.15) OR (mc_weight = 0 AND s0 > 0)",
    "isTaggedAsWaisPulser": "label % 4 = 1",
    "isTaggedAsLDBPulser": "label % 4 = 2",
    "isTaggedAsPulser": "label % 4 = 1 OR label % 4 = 2",
    "isTaggedAsPayloadBlast": "s1 > 0.15",
    "quietTime": '"eventNumber" * 2000 >= 20000 AND "eventNumber" * 2000 < 950000',
}
_BLAST = " AND ".join(f"({ROW_CUT_SQL[f'newPayloadBlastCutPart{p}']})" for p in ("0A", "0B", "1", "2"))
ELEMENT_CUT_SQL = {
    "highestPeak": "value = top",
    "mostImpulsivePeak": "d_imp = top_imp",
    "smallDeltaRough": "abs(dphi) < 4.0 AND abs(dtheta) < 4.0",
    "higherHilbertPeakAfterDedispersion": "d_hil > c_hil",
    "higherImpulsivityMeasureAfterDedispersion": "d_imp > c_imp",
    "lowerFracPowerWindowGradientAfterDedispersion": "d_grad < c_grad",
    "reasonableHilbertPeakTimeShiftAfterDedispersion": "c_time - d_time > 0 AND c_time - d_time < 20",
    "isAboveHorizontal": "theta > 0",
    "isBelowHorizontal": "theta < 0",
    "hasSourceLocation": "true",
    "isOnContinent": "phi * 0.5 > -30 AND theta * 0.6 - 75 < -72",
    "newPayloadBlastCutPart3": "14.0 * d_hil > blast3",
    "isGood2": f"{_BLAST} AND 14.0 * d_hil > blast3",
}


def _projected(spark: SparkSession, folder: str) -> tuple[DataFrame, Column]:
    """Events with their elements as a column, so that cuts that look at all elements don't build them again."""
    df, elements = _events(spark, folder)
    return df.withColumn("_el", elements), F.col("_el")


def _cuts(elements: Column):
    return nested_cuts(elements, lambda lon, lat: (lon > -30) & (lat < -72))


@query(
    "named_cuts_nested",
    NESTED_SQL
    + " "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS cut, CAST(count(DISTINCT \"eventNumber\") FILTER (WHERE {c}) AS BIGINT) AS events FROM e"
        for n, c in (ROW_CUT_SQL | ELEMENT_CUT_SQL).items()
    ),
)
def _named_cuts_nested(spark, folder):
    """Events passing each nested cut (some element passing, for element cuts), in one scan."""
    df, elements = _events(spark, folder)
    cuts = _cuts(F.col("_el"))
    rows = [
        F.struct(
            F.lit(n).alias("cut"),
            F.count_if(any_pass(F.col("_el"), [cuts[n]]) if cuts[n].per_element else cuts[n].column).alias("events"),
        )
        for n in ROW_CUT_SQL | ELEMENT_CUT_SQL
    ]
    return df.withColumn("_el", elements).agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


_SKIM_ROW = ["isRfTrigger", "newPayloadBlastCutPart0A"]
_SKIM_EL = ["smallDeltaRough", "isBelowHorizontal", "higherHilbertPeakAfterDedispersion"]


def _where(names: list[str]) -> str:
    return " AND ".join(f"({(ROW_CUT_SQL | ELEMENT_CUT_SQL)[n]})" for n in names)


@query(
    "elem_any_pass",
    f'{NESTED_SQL} SELECT DISTINCT "eventNumber", run FROM e WHERE {_where(_SKIM_ROW + _SKIM_EL)}',
)
def _elem_any_pass(spark, folder):
    """Skim: events where one single element passes all element cuts."""
    df, elements = _projected(spark, folder)
    cuts = _cuts(elements)
    return skim(df, elements, [cuts[n].column for n in _SKIM_ROW], [cuts[n] for n in _SKIM_EL]).select("eventNumber", "run")


@query(
    "elem_survivors",
    f'{NESTED_SQL} SELECT "eventNumber", '
    + ", ".join(f"CAST(count(*) FILTER (WHERE {_where(_SKIM_EL[: k + 1])}) AS INT) AS after_{k}" for k in range(3))
    + ' FROM e GROUP BY "eventNumber"',
)
def _elem_survivors(spark, folder):
    df, elements = _projected(spark, folder)
    cuts = _cuts(elements)
    counts = survivors_per_cut(elements, [cuts[n] for n in _SKIM_EL])
    return df.select("eventNumber", counts.alias("c")).select("eventNumber", *[F.col("c")[k].alias(f"after_{k}") for k in range(3)])




@query(
    "thermal_flatten",
    f"""{NESTED_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY "eventNumber" ORDER BY i) AS rn FROM e WHERE value = top AND label <> 9)
 SELECT run, "eventNumber", CAST(i AS INT) AS "Iteration", CAST(pol AS INT) AS pol, CAST(ind AS INT) AS "peakInd", value AS peak_value, phi AS peak_phi,
 theta AS peak_theta, round(c_grad, 9) AS coherent_filtered_fracPowerWindowGradient, round(d_grad, 9) AS deconvolved_filtered_fracPowerWindowGradient,
 c_imp AS coherent_filtered_impulsivityMeasure, d_imp AS deconvolved_filtered_impulsivityMeasure, c_hil AS coherent_filtered_peakHilbert,
 d_hil AS deconvolved_filtered_peakHilbert, c_time AS coherent_filtered_peakTime, d_time AS deconvolved_filtered_peakTime,
 CASE WHEN mc_weight > 0 THEN mc_weight WHEN mc_weight = 0 THEN 1 ELSE 0 END AS weight, s0 * 360.0 AS mc_phi, s1 * 50.0 AS mc_theta,
 CAST(label % 4 AS INT) AS flags_pulser, abs(s0) AS flags_middleOrBottomPower_0, abs(s3) AS flags_topPower_1 FROM p WHERE rn = 1""",
)
def _thermal_flatten(spark, folder):
    """Nested summaries to one flat row per event, at the highest peak."""
    df, elements = _projected(spark, folder)
    cuts = _cuts(elements)
    return thermal_columns(df, elements, [cuts["isRfTrigger"].column], [cuts["highestPeak"]])


def thermal_columns(df: DataFrame, elements: Column, row_cuts: list[Column], element_cuts: list) -> DataFrame:
    def gradient(waveform: str):
        return lambda e: F.round(window_gradient(e[waveform]["fracPowerWindowBegins"], e[waveform]["fracPowerWindowEnds"]), 9)

    columns: dict = {
        "run": F.col("run"), "eventNumber": F.col("eventNumber"), "Iteration": lambda e: e["i"].cast("int"), "pol": lambda e: e["pol"],
        "peakInd": lambda e: e["ind"].cast("int"),
    }
    columns |= {f"peak_{c}": (lambda e, c=c: e["peak"][c]) for c in ("value", "phi", "theta")}
    for w in ("coherent_filtered", "deconvolved_filtered"):
        columns[f"{w}_fracPowerWindowGradient"] = gradient(w)
        columns |= {f"{w}_{c}": (lambda e, w=w, c=c: e[w][c]) for c in ("impulsivityMeasure", "peakHilbert", "peakTime")}
    columns |= {
        "weight": event_weight(F.col("mc.weight")), "mc_phi": F.col("mc.phi"), "mc_theta": F.col("mc.theta"),
        "flags_pulser": F.col("flags.pulser"), "flags_middleOrBottomPower_0": F.col("flags.middleOrBottomPower")[0],
        "flags_topPower_1": F.col("flags.topPower")[1],
    }
    return flatten_first(df, elements, row_cuts, element_cuts, columns)


_REDUCTION = [
    "highestPeak", "isRfTrigger", "isNotTaggedAsPulser", "newPayloadBlastCutPart0A", "newPayloadBlastCutPart0B",
    "newPayloadBlastCutPart1", "newPayloadBlastCutPart2", "newPayloadBlastCutPart3", "smallDeltaRough", "goodGPS", "isBelowHorizontal",
    "reasonableHilbertPeakTimeShiftAfterDedispersion", "higherHilbertPeakAfterDedispersion",
    "higherImpulsivityMeasureAfterDedispersion", "lowerFracPowerWindowGradientAfterDedispersion",
]


@query(
    "data_reduction",
    NESTED_SQL
    + " "
    + " UNION ALL ".join(
        f"SELECT {k} AS cuts, '{_REDUCTION[k]}' AS last_cut, CAST(count(DISTINCT \"eventNumber\") AS BIGINT) AS events FROM e WHERE {_where(_REDUCTION[: k + 1])}"
        for k in range(len(_REDUCTION))
    ),
)
def _data_reduction(spark, folder):
    """The full skim list, counted after each cut: fused into one scan."""
    df, elements = _events(spark, folder)
    cuts = _cuts(F.col("_el"))
    listed = list(enumerate(cuts[n] for n in _REDUCTION))

    def first_failure(e: Column) -> Column:
        """Number of the first element cut that fails, so every cut is evaluated at most once per element."""
        return F.coalesce(*[F.when(~F.coalesce(c(e), F.lit(False)), F.lit(k)) for k, c in listed if c.per_element], F.lit(len(listed)))

    rowwise = [F.when(~F.coalesce(c.column, F.lit(False)), F.lit(k)) for k, c in listed if not c.per_element]
    deepest = F.coalesce(F.array_max(F.transform("_el", first_failure)), F.lit(-1))
    reached = df.withColumn("_el", elements).select(F.least(deepest, F.coalesce(*rowwise, F.lit(len(listed)))).alias("_k"))
    rows = [F.struct(F.lit(k).alias("cuts"), F.lit(_REDUCTION[k]).alias("last_cut"), F.count_if(F.col("_k") > k).alias("events")) for k, _ in listed]
    return reached.agg(F.array(*rows).alias("r")).select(F.inline("r"))


@query(
    "elem_index",
    f"{NESTED_SQL} SELECT CAST(i AS INT) AS i, CAST(pol AS INT) AS pol, CAST(ind AS INT) AS ind, CAST(count(*) AS BIGINT) AS n,"
    " round(avg(value), 6) AS mean_value, round(avg(theta) + 0.0, 6) AS mean_theta FROM e GROUP BY 1, 2, 3",
)
def _elem_index(spark, folder):
    df, elements = _events(spark, folder)
    rows = explode_elements(df, elements, ["eventNumber"])
    return rows.groupBy(F.col("i").cast("int").alias("i"), "pol", F.col("ind").cast("int").alias("ind")).agg(
        F.count("*").alias("n"), F.round(F.avg("peak.value"), 6).alias("mean_value"), F.round(F.avg("peak.theta"), 6).alias("mean_theta")
    )


@query("elem_max", f'{NESTED_SQL} SELECT "eventNumber", max(value) AS top_value, max(abs(theta)) AS top_theta FROM e GROUP BY 1')
def _elem_max(spark, folder):
    df, elements = _events(spark, folder)
    return df.select(
        "eventNumber",
        max_over(elements, lambda e: e["peak"]["value"]).alias("top_value"),
        max_over(elements, lambda e: F.abs(e["peak"]["theta"])).alias("top_theta"),
    )


@query(
    "argmax_elem",
    f"""{NESTED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY "eventNumber" ORDER BY value DESC, i) AS r1,
 row_number() OVER (PARTITION BY "eventNumber" ORDER BY d_imp DESC, i) AS r2 FROM e)
 SELECT "eventNumber", CAST(max(CASE WHEN r1 = 1 THEN i END) AS INT) AS highest, CAST(max(CASE WHEN r1 = 2 THEN i END) AS INT) AS second,
 CAST(max(CASE WHEN r2 = 1 THEN i END) AS INT) AS most_impulsive FROM k GROUP BY 1""",
)
def _argmax_elem(spark, folder):
    df, elements = _events(spark, folder)
    return df.select(
        "eventNumber",
        best_element(elements, lambda e: e["peak"]["value"])["i"].cast("int").alias("highest"),
        kth_best(elements, lambda e: e["peak"]["value"], 1)["i"].cast("int").alias("second"),
        best_element(elements, lambda e: e["deconvolved_filtered"]["impulsivityMeasure"])["i"].cast("int").alias("most_impulsive"),
    )


_RES_BIN = "CASE WHEN d < -60 THEN 0 WHEN d >= 60 THEN 25 ELSE CAST(floor((d + 60.0) * 24.0 / 120.0) AS INT) + 1 END"


@query(
    "mc_residuals",
    f"""{NESTED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY "eventNumber" ORDER BY value DESC, i) AS r1,
 row_number() OVER (PARTITION BY "eventNumber" ORDER BY d_imp DESC, i) AS r2 FROM e),
 f AS (SELECT 'highest' AS rule, *, CASE WHEN mc_weight = 0 THEN 1 ELSE mc_weight END AS w FROM k WHERE r1 = 1 UNION ALL
  SELECT 'impulsive' AS rule, *, CASE WHEN mc_weight = 0 THEN 1 ELSE mc_weight END AS w FROM k WHERE r2 = 1),
 g AS (SELECT rule || '_phi' AS hist, phi - s0 * 360.0 - 360.0 * floor((phi - s0 * 360.0 + 180.0) / 360.0) AS d, w FROM f UNION ALL
  SELECT rule || '_theta' AS hist, theta + s1 * 50.0 AS d, w FROM f)
 SELECT hist, {_RES_BIN} AS bin, round(sum(w), 6) AS content, CAST(count(*) AS BIGINT) AS entries FROM g GROUP BY 1, 2""",
)
def _mc_residuals(spark, folder):
    """Weighted angle residuals for several peak rules, all histograms in one aggregate."""
    df, elements = _events(spark, folder)
    rules = {
        "highest": best_element(elements, lambda e: e["peak"]["value"])["peak"],
        "impulsive": best_element(elements, lambda e: e["deconvolved_filtered"]["impulsivityMeasure"])["peak"],
    }
    values = []
    for name, peak in rules.items():
        values.append(F.struct(F.lit(f"{name}_phi").alias("hist"), delta_angle(peak["phi"] - F.col("mc.phi")).alias("d")))
        values.append(F.struct(F.lit(f"{name}_theta").alias("hist"), (peak["theta"] + F.col("mc.theta")).alias("d")))
    rows = df.select(event_weight(F.col("mc.weight")).alias("w"), F.explode(F.array(*values)).alias("r")).select("w", "r.*")
    filled = hist1d(rows, F.col("d"), Axis(24, -60.0, 60.0), F.col("w"), by=["hist"])
    return filled.select("hist", "bin", F.round("content", 6).alias("content"), "entries")


_LINES = (
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS top FROM lineitem"
)


@query(
    "first_passing_elem",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey"
    f" ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM ({_LINES}) WHERE l_discount < 0.05 AND l_extendedprice = top) WHERE rn = 1",
)
def _first_passing_elem(spark, folder):
    """Highest element of each order, kept if it also passes a second cut; first in order.

    Elements are rows here, so an order of any size is two max/min aggregates, never a
    collected list.
    """
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"
    )
    passing = F.col("l_discount") < 0.05
    best = F.min(
        F.when(passing, F.struct((-F.col("l_extendedprice")).alias("m"), "l_linenumber", "l_partkey", "l_suppkey"))
    )
    grouped = lines.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("top"), best.alias("b"))
    return grouped.filter(-F.col("b.m") == F.col("top")).select(
        "l_orderkey", F.col("b.l_linenumber").alias("l_linenumber"), F.col("b.l_partkey").alias("l_partkey"), F.col("top").alias("l_extendedprice")
    )


@query(
    "elem_any_pass_rows",
    "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount < 0.03 AND l_quantity > 30 AND l_tax >= 0.02",
)
def _elem_any_pass_rows(spark, folder):
    """Orders where one single line passes all cuts: a filter before the aggregate."""
    kept = table(spark, folder, "lineitem").filter((F.col("l_discount") < 0.03) & (F.col("l_quantity") > 30) & (F.col("l_tax") >= 0.02))
    return kept.select("l_orderkey").distinct()


@query("bool_arith_guarded", f"{NESTED_SQL} SELECT CAST(pol AS INT) AS pol, round(avg(CASE WHEN abs(dphi * 0.5) < abs(dtheta * 0.5) THEN abs(dphi * 0.5) ELSE abs(dtheta * 0.5) END), 6) AS min_abs_angle FROM e GROUP BY 1")
def _bool_arith_guarded(spark, folder):
    """Smaller of two angles by condition rather than by multiplying flags, which NaN would poison."""
    df, elements = _events(spark, folder)
    rows = explode_elements(df, elements, [])
    a, b = F.abs(F.col("peak.hwAngle")), F.abs(F.col("peak.hwAngleXPol"))
    return rows.groupBy("pol").agg(F.round(F.avg(F.when(a < b, a).otherwise(b)), 6).alias("min_abs_angle"))


