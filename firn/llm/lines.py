"""Registered queries of this package and the SQL that checks them; helpers to read and number rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from firn.operators.ordered import place
from firn.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for null. Gaps before words are counted, so no word list is built."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def same_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on equal keys, null equal to null; the right side's keys are dropped. ``small``: one row (per
    group, where groups are few by contract), which is broadcast."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    if small:
        renamed = F.broadcast(renamed)
    if not keys:
        return left.crossJoin(renamed)
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys], how).drop(*[f"_right_{k}" for k in keys])


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """0-based gapless number of each row in its group, by ``order``.

    Rows are range-partitioned by (group, order), so a group of any size spans many tasks. The
    groups must be few (a documented bound of each caller): one row per group is broadcast.
    Rows are written first, because range boundaries are sampled in a run of their own.
    """
    placed = place(materialize(df, "rows"), [*group, *order])
    bases = placed.groupBy(*group).agg(F.min("_g").alias("_first"))
    joined = same_join(placed, bases, group, small=True)
    return joined.select(*df.columns, (F.col("_g") - F.col("_first")).alias(out))
