"""Sources: Parquet scans by glob and run range, text geometry, and small config files."""

from __future__ import annotations

import math
import xml.etree.ElementTree as ElementTree
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from firn.functions.scores import event_weight
from firn.operators.joins import friend_join
from firn.operators.learn import Discriminant
from firn.operators.series import first_last
from firn.sources import schema


def summaries(spark: SparkSession, glob: str, declared: bool = True) -> DataFrame:
    """Nested event summaries. A declared schema skips inference and prunes nested fields."""
    reader = spark.read.schema(schema.SUMMARY) if declared else spark.read
    return reader.parquet(glob)


def run_range(df: DataFrame, first: int, last: int) -> DataFrame:
    """Runs first..last; a partition filter when the table is laid out by run."""
    return df.filter(F.col("run").between(first, last))


def extent(df: DataFrame) -> DataFrame:
    """Row count and the first and last event and time, in event order, in one aggregate."""
    return first_last(df, [], F.col("eventNumber"), ["eventNumber", "realTime"], F.count("*").alias("rows"))


def thermal(spark: SparkSession, path: str, table: str = "thermal", friends: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Flat table joined with its side tables.

    Side table paths come from replacing ``table`` in ``path``; ``friends`` maps each name
    to its (run, event) column names. Events without a side row keep NULLs.
    """
    friends = friends or {"hiCal": ("run2", "eventNumber2"), "surface": ("run3", "eventNumber3")}
    df = schema.restore_types(spark.read.parquet(path))
    for name, key in friends.items():
        df = friend_join(df, spark.read.parquet(path.replace(table, name)), key)
    return df


def two_class(spark: SparkSession, signal: str, background: str) -> DataFrame:
    """Signal (label 1) and background (label 0) in one table."""
    return (
        spark.read.parquet(signal)
        .withColumn("label", F.lit(1))
        .unionByName(spark.read.parquet(background).withColumn("label", F.lit(0)), allowMissingColumns=True)
    )


def clustered(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Events and clusters of an earlier clustering; thresholds are the cluster partitions."""
    return spark.read.parquet(f"{folder}/event"), spark.read.parquet(f"{folder}/cluster")


def rebuilt_event_number(coarse: Column, last_digits: Column, digits: int = 4) -> Column:
    """Ids stored as a rounded float plus their last digits."""
    step = 10**digits
    return F.floor(coarse.cast("double") / step).cast("long") * step + last_digits.cast("long")


def flat_exchange(spark: SparkSession, glob: str, simulated: bool) -> DataFrame:
    """Flat tables from another analysis: ids rebuilt, data cut to directions below the horizontal."""
    df = spark.read.parquet(glob).withColumn("eventNumber", rebuilt_event_number(F.col("eventNumber"), F.col("lastFewDigits")))
    weighted = df.withColumn("weight", event_weight(F.col("weight")) if simulated else F.lit(1.0))
    return weighted if simulated else weighted.filter(F.col("theta") > 0)


def sites(spark: SparkSession, path: str) -> DataFrame:
    """Known sites; an unknown altitude (-999) becomes NULL."""
    read = spark.read.schema(schema.SITES).option("header", "true").csv(path)
    return schema.nullify(read, ["altitude"])


def geometry_text(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated 'ant dr dz dPhi dt' corrections."""
    parts = F.split(F.btrim(F.col("value")), r"\s+")
    names = ("dr", "dz", "dphi", "dt")
    rows = spark.read.text(path).filter(F.size(parts) >= 5)
    return rows.select(parts[0].cast("int").alias("ant"), *[parts[i + 1].cast("double").alias(n) for i, n in enumerate(names)])


def corrected_geometry(nominal: DataFrame, corrections: DataFrame) -> DataFrame:
    """Nominal r, z, phi (radians) plus corrections, phi kept in [0, 2 pi)."""
    turn = F.lit(2 * math.pi)
    joined = nominal.join(corrections, "ant")
    phi = F.col("phi") + F.col("dphi")
    return joined.select(
        "ant",
        (F.col("r") + F.col("dr")).alias("r"),
        (F.col("z") + F.col("dz")).alias("z"),
        F.when(phi >= turn, phi - turn).when(phi < 0, phi + turn).otherwise(phi).alias("phi"),
        "dt",
    )


def discriminant_xml(text: str) -> Discriminant:
    """Weights file: ``Variable`` nodes carry expressions, ``Coefficient`` nodes weights (0 is the offset)."""
    expressions: dict[int, str] = {}
    weights: dict[int, float] = {}
    for node in ElementTree.fromstring(text).iter():
        if node.tag == "Variable" and "VarIndex" in node.attrib and "Expression" in node.attrib:
            expressions[int(node.attrib["VarIndex"])] = node.attrib["Expression"]
        elif node.tag == "Coefficient" and "Index" in node.attrib and "Value" in node.attrib:
            weights[int(node.attrib["Index"])] = float(node.attrib["Value"])
    missing = [k for k in weights if k and k - 1 not in expressions]
    if missing:
        raise ValueError(f"no expression for coefficients {missing}")
    return Discriminant(weights.get(0, 0.0), [(weights[k], expressions[k - 1]) for k in sorted(weights) if k])


def settings(text: str) -> dict[str, dict[str, str]]:
    """Sectioned key=value text; ``#`` starts a comment and the first of duplicate keys wins."""
    found: dict[str, dict[str, str]] = {}
    section = None
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].strip()
        if line.startswith("[") and "]" in line:
            section = line[1 : line.index("]")].strip()
            found.setdefault(section, {})
        elif line.count("=") == 1 and section is not None:
            key, value = (part.strip() for part in line.split("="))
            found[section].setdefault(key, value)
    return found


def synthetic_waveforms(spark: SparkSession, events: int, channels: int, samples: int, seed: int = 0, rate: float = 2.6) -> DataFrame:
    """Unit Gaussian noise, fixed by (seed, event, channel, sample) whatever the partitioning."""
    rows = spark.range(events).withColumnRenamed("id", "eventNumber").withColumn("chan", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))

    def uniform(k: int, i: Column) -> Column:
        h = F.xxhash64(F.lit(seed), F.lit(k), F.col("eventNumber"), F.col("chan"), i)
        return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

    def normal(i: Column) -> Column:
        return F.sqrt(-2.0 * F.ln(uniform(1, i))) * F.cos(2 * math.pi * uniform(2, i))

    numbers = F.sequence(F.lit(0), F.lit(samples - 1))
    return rows.select(
        "eventNumber", "chan", F.transform(numbers, lambda i: i / rate).alias("t"), F.transform(numbers, normal).alias("v")
    )


def division_of_task(task: int) -> tuple[int, int, int]:
    """(run, division, divisions) from an array-job number: plain, tenfold or hundredfold run."""
    for limit, parts in ((1_000, 1), (10_000, 10), (100_000, 100)):
        if task < limit:
            return task // parts, task % parts, parts
    raise ValueError("task number too large")


def input_bytes(df: DataFrame) -> DataFrame:
    """Files, bytes and bytes per row of a file-backed table."""
    files = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    per_file = files.groupBy("path").agg(F.first("size").alias("size"), F.count("*").alias("rows"))
    return per_file.agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.try_divide(F.sum("size"), F.sum("rows")).alias("bytes_per_row")
    )


def newest(spark: SparkSession, pattern: str) -> str | None:
    """Last matching path by name; names carry their time stamp."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return max((str(f.getPath().toString()) for f in found or []), default=None)
