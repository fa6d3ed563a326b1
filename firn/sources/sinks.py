"""Sinks: skims, flat tables, clustering outputs, flag overlays, with provenance."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from firn.operators.joins import merge_runs, only_ids, overlay


def write(df: DataFrame, path: str, by: Sequence[str] = (), compression: str = "zstd", mode: str = "errorifexists") -> None:
    """One file per task under the commit protocol; partitioned by run for later pruning."""
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def merge_indexed(path: str, *tables: DataFrame, key: Sequence[str] = ("run", "eventNumber")) -> None:
    """Union tables into one sorted by id, so row-group statistics serve id look-ups."""
    merged = merge_runs(*tables).repartitionByRange(*key).sortWithinPartitions(*key)
    write(merged, path)


def sub_run(folder: str, ids: DataFrame, tables: dict[str, DataFrame], key: Sequence[str] = ("run", "eventNumber")) -> None:
    """Chosen events of several tables written side by side."""
    for name, df in tables.items():
        write(only_ids(df, ids, key), f"{folder}/{name}")


def clustering(folder: str, events: DataFrame, clusters: DataFrame, simulated: DataFrame | None = None) -> None:
    """Events once, clusters per threshold, so one threshold can be read alone."""
    write(events, f"{folder}/event")
    write(clusters, f"{folder}/cluster", by=["z"])
    if simulated is not None:
        write(simulated, f"{folder}/mcEvent")


def flag_table(path: str, summary: DataFrame) -> None:
    write(summary.select("eventNumber", "flags"), path)


def overwrite_flags(path: str, summary: DataFrame, flags: DataFrame) -> None:
    """A new table with flags replaced where the overlay has the event."""
    write(overlay(summary, flags, ["eventNumber"], ["flags"]), path)


def output_name(program: str, args: Sequence[str], folder: str = ".", when: datetime | None = None) -> str:
    """``folder/program_args_YYYY-MM-DD_HH-MM-SS``."""
    stamp = (when or datetime.now(timezone.utc)).strftime("%Y-%m-%d_%H-%M-%S")
    stem = "_".join([program.rsplit("/", 1)[-1], *map(str, args), stamp])
    return f"{folder.rstrip('/')}/{stem}"


def provenance(spark: SparkSession, path: str, settings: dict, source: str) -> None:
    """A one-row JSON note beside the data: the settings used and where the input came from."""
    note = json.dumps({"settings": settings, "source": source}, sort_keys=True)
    spark.range(1).select(F.lit(note).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}.provenance")
