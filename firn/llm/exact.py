"""Exact deduplication with an extendible-hash index on shared files (DataFrame operations only).

Every text, without its white space, has a 64-bit key. The directory is a set of key
prefixes: it starts with one bucket and doubles wherever a bucket holds more than its share of
distinct keys, so a bucket is a range of keys of bounded size. Entries of the index are grouped
by (bucket, key, text): Spark's hash aggregate compares the bytes of texts that meet under
one key, combines copies before they are shuffled, and so chains texts that collide. Each text in
a chain has its own number; rows find their number by key alone where the chain has one text, by
comparing bytes where it has more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from firn.llm.lines import SPACE, query, table
from firn.session import materialize

BUCKETS = 4096
LEAST_BUCKET = 1024
STEP_BITS = 6
KEY_BITS = 63


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def text_key(norm: Column) -> Column:
    """63-bit key of a normalised text, so that prefixes are plain shifts."""
    return F.shiftrightunsigned(F.xxhash64(norm), 1)


def directory(keys: DataFrame, capacity: int) -> list[tuple[int, int]]:
    """(prefix, depth) of every bucket that covers the distinct ``_key`` values.

    A bucket with more than ``capacity`` distinct keys is split by its next bits, until none is
    overfull or the key has no more bits. A pass counts 2**STEP_BITS children of all overfull buckets
    at once and keeps the shallowest ones that fit. With capacity >= keys / BUCKETS there are at
    most BUCKETS overfull buckets a level, so what reaches the driver is bounded.
    """
    distinct = keys.select("_key").distinct()
    done: list[tuple[int, int]] = []
    open_buckets, depth = [0], 0
    while open_buckets:
        finer = min(depth + STEP_BITS, KEY_BITS)
        child = F.shiftright("_key", KEY_BITS - finer)
        rows = distinct.filter(F.shiftright(child, finer - depth).isin(open_buckets)) if depth else distinct
        counts = {r[0]: r[1] for r in rows.groupBy(child.alias("c")).count().collect()}
        level = {b: 0 for b in open_buckets}
        for d in range(depth, finer + 1):
            size: dict[int, int] = {}
            for c, n in counts.items():
                size[c >> (finer - d)] = size.get(c >> (finer - d), 0) + n
            fits = [b for b in level if size.get(b, 0) <= capacity or d == KEY_BITS]
            done += [(b, d) for b in fits]
            level = {b: 0 for b in level if b not in set(fits)}
            if d < finer:
                level = {child_of: 0 for b in level for child_of in (2 * b, 2 * b + 1)}
        open_buckets, depth = sorted(level), finer
    return sorted(done, key=lambda b: b[0] << (KEY_BITS - b[1]))


def _constants(values: list[int]) -> Column:
    return F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")")


def bucket_of(key: Column, buckets: list[tuple[int, int]]) -> Column:
    """Number of the bucket whose range holds the key: the directory as an array with one entry per
    prefix of a coarse common depth, and a short search among the buckets below that prefix."""
    starts = [p << (KEY_BITS - d) for p, d in buckets]
    depth = min(max((d for _, d in buckets), default=0), 12)
    if not depth:
        return F.lit(0).cast("long")
    first, width = [], 1 << (KEY_BITS - depth)
    at = 0
    for prefix in range(1 << depth):
        while at + 1 < len(starts) and starts[at + 1] <= prefix * width:
            at += 1
        first.append(at)
    slot = F.element_at(_constants(first), F.shiftright(key, KEY_BITS - depth).cast("int") + 1)
    deep = [s for i, s in enumerate(starts) if buckets[i][1] > depth and s % width]
    if not deep:
        return slot
    return slot + F.size(F.filter(_constants(deep), lambda s: (s <= key) & (F.shiftright(s, KEY_BITS - depth) == F.shiftright(key, KEY_BITS - depth))))


def duplicate_groups(
    docs: DataFrame, key: Callable[[Column], Column] = text_key, buckets: int = BUCKETS, least: int = LEAST_BUCKET
) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) as one row per row: ``doc_id``, ``n_chars``, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256``.

    Rows are copies when their texts are equal without white space. Of a group the row with the
    most code points stays, then the one with the smallest ``doc_id`` (null last). Null texts
    count as empty, and all empty texts form one group. Rows that repeat a doc_id and a text are
    rows of their own: exactly one of a group has ``kept``. Other columns are not read. An empty
    table gives an empty result.
    """
    placed, entries = _grouped(docs, key, buckets, least)
    return placed.join(entries, ["_key", "_chain"]).select(
        "doc_id",
        F.col("_points").alias("n_chars"),
        F.col("_keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_keep._row") == F.col("_row")).alias("kept"),
        "text_sha256",
    )


def _grouped(docs: DataFrame, key: Callable[[Column], Column], buckets: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Narrow rows with their place in the index, and the index with group sizes and the row that stays."""
    norm = normalised(F.col("text"))
    read = docs.select("doc_id", "text").select(
        "doc_id",
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("_points"),
        F.xxhash64("text").alias("_raw"),
        norm.alias("_norm"),
        key(norm).alias("_key"),
    )
    index = index_of(read, buckets, least)
    numbered = read.select("doc_id", "_points", "_raw", "_key", F.monotonically_increasing_id().alias("_row"))
    rows = materialize(numbered, "rows")
    chains = index.groupBy("_key").agg(F.count("*").alias("_chain")).filter("_chain > 1")
    placed = rows.withColumn("_chain", F.lit(0))
    if not chains.isEmpty():
        placed = _chained(read, index, rows, chains)
    order = F.struct((-F.col("_points")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_row"))
    best = placed.groupBy("_key", "_chain").agg(F.min(order).alias("_keep"), F.count("*").alias("group_size"))
    return placed, index.select("_key", "_chain", "text_sha256").join(best, ["_key", "_chain"])


def index_of(read: DataFrame, buckets: int = BUCKETS, least: int = LEAST_BUCKET) -> DataFrame:
    """The index on shared files, one entry per distinct text: ``_bucket``, ``_key``, ``_chain``,
    ``text_sha256``. Each bucket lies in one file, in key order."""
    grouped = read.groupBy("_key", "_norm").agg(F.count("*").alias("_count"))
    entries = materialize(grouped.select("_key", F.sha2("_norm", 256).alias("text_sha256")), "entries")
    number = entries.select(F.count("*")).head()[0]
    split = directory(entries, max(least, -(-number // buckets)))
    bucketed = entries.withColumn("_bucket", bucket_of(F.col("_key"), split))
    # A chain holds the distinct texts of one key: a handful for a 64-bit key.
    chain = F.row_number().over(Window.partitionBy("_bucket", "_key").orderBy("text_sha256")) - 1
    owned = bucketed.repartition("_bucket").withColumn("_chain", chain)
    return materialize(owned.select("_bucket", "_key", "_chain", "text_sha256"), "index")


def _chained(read: DataFrame, index: DataFrame, rows: DataFrame, chains: DataFrame) -> DataFrame:
    """Rows with their number in the chain. Only rows of colliding keys bring their texts again."""
    texts = read.join(chains.select("_key"), "_key").groupBy("_key", "_norm").agg(F.count("*").alias("_count"))
    numbered = texts.withColumn("text_sha256", F.sha2("_norm", 256)).join(index.drop("_bucket"), ["_key", "text_sha256"])
    again = read.select("doc_id", "_points", "_raw", "_norm", "_key", F.monotonically_increasing_id().alias("_row"))
    colliding = again.join(numbered.select("_key", "_norm", "_chain"), ["_key", "_norm"])
    alone = rows.join(chains.select("_key"), "_key", "left_anti").withColumn("_chain", F.lit(0))
    return materialize(alone.unionByName(colliding.select(*alone.columns)), "chained")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that repeat both doc_id and text are told apart by nothing, so one of them stays where
    the group's row that stays is among them.
    """
    placed, entries = _grouped(docs, text_key, BUCKETS, LEAST_BUCKET)
    best = entries.select(F.col("_keep._row").alias("_row"), F.col("_keep.doc_id").alias("_id"))
    kept = best.join(placed.select("_row", "_raw", "_key", "_chain"), "_row").select("_id", F.col("_raw").alias("_text"))
    kept = kept.distinct()
    # The whole row travels as one column, so its own column names cannot clash with these.
    marked = docs.select("doc_id", F.xxhash64("text").alias("_raw"), F.struct(*docs.columns).alias("_whole"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_raw") == F.col("_text"))
    repeat = Window.partitionBy("doc_id", "_raw").orderBy(F.lit(0))
    stays = marked.join(kept, same, "left_semi").withColumn("_nth", F.row_number().over(repeat)).filter("_nth = 1")
    return stays.select("_whole.*")


@query(
    "op8_exact_dedup",
    r"""
    WITH t AS (
        SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
        FROM documents
    )
    SELECT doc_id,
           first_value(doc_id) OVER w AS keep_id,
           count(*) OVER (PARTITION BY norm) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept,
           sha256(norm) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
    """,
)
def op8_exact_dedup(spark, folder):
    found = duplicate_groups(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
