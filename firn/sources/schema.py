"""Declared schemas. Out-of-band NULL replaces in-band sentinels at ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

POLARISATIONS = 2
DIRECTIONS = 5
ANTENNAS = 48
SECTORS = 16

POINTING = (
    "struct<value:double,phi:double,theta:double,chisq:double,dphi_rough:double,dtheta_rough:double,"
    "phi_separation:double,longitude:double,latitude:double,altitude:double,theta_adjustment_needed:double,"
    "distanceToSource:double,hwAngle:double,hwAngleXPol:double,triggered:boolean,triggered_xpol:boolean,"
    "masked:boolean,masked_xpol:boolean>"
)
WAVEFORM = (
    "struct<snr:double,peakHilbert:double,peakVal:double,xPolPeakHilbert:double,xPolPeakVal:double,peakTime:double,"
    "impulsivityMeasure:double,totalPower:double,totalPowerXpol:double,I:double,Q:double,U:double,V:double,"
    "max_dI:double,max_dQ:double,max_dU:double,max_dV:double,spectrumSlope:double,spectrumIntercept:double,"
    "fracPowerWindowBegins:array<double>,fracPowerWindowEnds:array<double>,peakMoments:array<double>,"
    "bandwidth:array<double>,peakPower:array<double>,peakFrequency:array<double>>"
)
FLAGS = (
    "struct<isGood:int,isRF:int,isVarner:int,isVarner2:int,isPayloadBlast:int,pulser:int,"
    "nSectorsWhereBottomExceedsTop:int,maxBottomToTopRatio:array<double>,maxBottomToTopRatioSector:array<int>,"
    "minBottomToTopRatio:array<double>,minBottomToTopRatioSector:array<int>,topPower:array<double>,"
    "middleOrBottomPower:array<double>,middleOrBottomAnt:array<int>,middleOrBottomPol:array<int>>"
)


def per_direction(element: str) -> str:
    return f"array<array<{element}>>"


SUMMARY = (
    "run int, eventNumber bigint, realTime bigint, nPeaks array<int>, "
    f"peak {per_direction(POINTING)}, coherent {per_direction(WAVEFORM)}, "
    f"coherent_filtered {per_direction(WAVEFORM)}, deconvolved {per_direction(WAVEFORM)}, "
    f"deconvolved_filtered {per_direction(WAVEFORM)}, flags {FLAGS}, "
    "payloadLocation struct<longitude:double,latitude:double,altitude:double,heading:double>, "
    "mc struct<weight:double,energy:double,phi:double,theta:double>, "
    "wais struct<phi:double,theta:double>, sun struct<phi:double,theta:double>, "
    "channels array<array<struct<rms:double,avgPower:double,snr:double,peakHilbert:double>>>"
)
HICAL = "duringHiCal int, hiCalPhi double, hiCalTheta double, eventNumber2 bigint, run2 int"
SURFACE = (
    "longitude double, latitude double, altitude double, thetaAdjustmentRequired double, onContinent int, "
    "onIceShelf int, iceThickness double, eventNumber3 bigint, run3 int"
)
FLAG_TABLE = f"eventNumber bigint, flags {FLAGS}"
DATA_QUALITY = (
    "maxAbsSecondDeriv array<array<double>>, maxVolts array<array<double>>, numPoints array<array<int>>, "
    "eventNumber bigint"
)
SITES = "name string, latitude double, longitude double, altitude double"
CLUSTERED_EVENT = (
    "eventNumber bigint, run int, pol tinyint, peakIndex int, latitude double, longitude double, altitude double, "
    "easting double, northing double, payload struct<longitude:double,latitude:double,altitude:double,heading:double>, "
    "theta double, phi double, thetaAdjustmentRequired double, sigmaTheta double, sigmaPhi double, nThresholds int, "
    "cluster array<int>, dThetaCluster array<double>, dPhiCluster array<double>, eventEventClustering boolean, "
    "nearestKnownBaseLogLikelihood double, nearestKnownBaseSurfaceSeparationKm double, nearestKnownBaseCluster int, "
    "nearestKnownBaseClusterSurface int, selfLogLikelihood double, nearestEventSurfaceDistanceKm double, "
    "nearestEventSurfaceEventNumber bigint, nearestEventSurfaceLogLikelihood double, "
    "nearestEventSurfaceLLEventNumber bigint"
)
CLUSTER = (
    "latitude double, longitude double, altitude double, numDataEvents int, sumMcWeights double, knownBase int, "
    "index int, llEventCutInd int, llEventCut double"
)

# Fixed values: 'no value' markers in exported tables.
SENTINELS = (-9999.0, -999.0)


def nullify(df: DataFrame, columns: list[str], sentinels: tuple[float, ...] = SENTINELS) -> DataFrame:
    """Replace marker values by NULL in flat numeric columns."""
    return df.withColumns({c: F.when(~F.col(c).isin(*sentinels), F.col(c)) for c in columns})


def unsigned_event_number(value: Column) -> Column:
    """Event numbers stored as signed 32-bit wrap negative; undo that."""
    wide = value.cast("long")
    return F.when(wide < 0, wide + F.lit(1 << 32)).otherwise(wide)


def restore_types(df: DataFrame) -> DataFrame:
    """Flat tables keep pol and peakInd as float and counters as signed int."""
    fixes = {
        "pol": lambda c: c.cast("int"),
        "peakInd": lambda c: c.cast("int"),
        "eventNumber": unsigned_event_number,
        "realTime": unsigned_event_number,
    }
    return df.withColumns({n: f(F.col(n)) for n, f in fixes.items() if n in df.columns})
