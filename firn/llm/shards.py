"""Sharding by weighted rendezvous hashing (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from firn.llm.lines import numbered, query, table

SHARDS = 40
SEED = 40_507


def rendezvous(key: Column, weights: Sequence[float], seed: int = SEED) -> Column:
    """Shard 0..len(weights)-1 of each key: the one with the highest score -weight / ln(u), where u in
    (0, 1) is a hash of the key and the shard alone. A shard's score does not depend on the others,
    so one more shard takes keys only into itself, and a changed weight moves keys only to or
    from that shard. Equal scores go to the higher shard. Weights must be positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")

    def score(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(shard).alias("shard"))

    scores = [score(s, w) for s, w in enumerate(weights)]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def _record_key() -> Column:
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64(F.lit("text"), "text"))


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` of every row.

    ``doc_id`` is the stable record key; a null one is keyed by its text's hash instead, so such rows
    spread. ``size`` is the UTF-8 length of the text (null: none) plus 16. ``slot`` numbers a shard's
    rows from 0 without gaps, by doc_id, then crc32, then size; the order of wholly repeated rows is
    left open. ``grown_shard`` is the shard once there is one more of weight 1. Rows with one key share
    a shard by design. Other columns are not read; an empty table gives an empty result.

    Slots come from positions in range partitions, so a shard of any size spans many tasks; what is
    broadcast is one row per shard.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        _record_key().alias("_key"),
    )
    placed = rows.select(
        "doc_id", "size", "text_crc32",
        rendezvous(F.col("_key"), weights, seed).cast("int").alias("shard"),
        rendezvous(F.col("_key"), [*weights, 1.0], seed).cast("int").alias("grown_shard"),
    )
    return numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS, files: int = 16, seed: int = SEED) -> None:
    """Write whole rows of ``docs`` (a column ``shard`` is replaced) under ``path/shard=N``, each shard in at most ``files`` files.

    A row's place is computed where it is read, so its text is shuffled once. Rows of a shard are
    spread over its files by a hash of the key and text.
    """
    shard = rendezvous(_record_key(), weights, seed)
    placed = docs.drop("shard").withColumn("shard", shard)
    placed.repartition("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(files))).write.partitionBy("shard").parquet(path)


@query("op9_sharding")
def op9_sharding(spark, folder):
    found = assign_shards(table(spark, folder, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
