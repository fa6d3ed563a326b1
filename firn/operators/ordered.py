"""Ordered operations that never place a whole key in one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, which fails
when one key holds a large share of the table. Here rows are range-partitioned by
(keys, order), so a heavy key spans as many partitions as it needs, and each row gets its
global position once. Later steps cut the line of positions into blocks of bounded size:

* fixed-reach windows (lag, lead, rolling) copy the few rows a block needs from its
  neighbours;
* unbounded windows (running sums, last known value) run inside a block and add a carry
  computed from one summary row per block and key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from firn.session import materialize

BLOCK_ROWS = 32_768
_WITHIN = (1 << 33) - 1


def place(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Add ``_g``, the 0-based position of each row under ``order`` (keys come first in it).

    The sorted rows are written once, because range boundaries come from a sample and
    would differ between two evaluations of the same plan. ``order`` should end in a
    unique column: fully tied rows stay in one partition.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "*",
            F.spark_partition_id().alias("_chunk"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN)).alias("_in_chunk"),
        )
    )
    kept = materialize(placed, "place")
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shuffle partition: bounded by the partition count, so safe to broadcast.
    bases = kept.groupBy("_chunk").agg(F.count("*").alias("_rows")).select(
        "_chunk", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base")
    )
    return (
        kept.join(F.broadcast(bases), "_chunk")
        .withColumn("_g", F.col("_base") + F.col("_in_chunk"))
        .drop("_chunk", "_in_chunk", "_base")
    )


def blocks(placed: DataFrame, size: int = BLOCK_ROWS, before: int = 0, after: int = 0) -> DataFrame:
    """Assign blocks of ``size`` rows, copying ``before``/``after`` rows across each edge."""
    if max(before, after) > size:
        raise ValueError("a block must be at least as long as the reach of its window")
    home, offset = F.floor(F.col("_g") / size), F.col("_g") % size
    if not before and not after:
        return placed.select("*", home.alias("_block"), F.lit(True).alias("_home"))
    targets = [home]
    if before:
        targets.append(F.when(offset >= size - before, home + 1))
    if after:
        targets.append(F.when((offset < after) & (home > 0), home - 1))
    spread = placed.select("*", home.alias("_home_block"), F.explode(F.array_compact(F.array(*targets))).alias("_block"))
    return spread.withColumn("_home", F.col("_block") == F.col("_home_block")).drop("_home_block")


def _same_key(keys: Sequence[str], offset: int, w) -> Column:
    lagged = [F.lag(k, offset).over(w).eqNullSafe(F.col(k)) for k in keys]
    exists = F.lag(F.lit(1), offset).over(w).isNotNull()
    return reduce(lambda a, b: a & b, lagged, exists)


def neighbours(
    placed: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, int]], size: int = BLOCK_ROWS
) -> DataFrame:
    """Values of rows at a fixed offset within the key: ``{"prev": ("value", -1)}``; NULL off the end."""
    reach_back = max([0] + [-o for _, o in wanted.values()])
    reach_on = max([0] + [o for _, o in wanted.values()])
    w = Window.partitionBy("_block").orderBy("_g")
    spread = blocks(placed, size, before=reach_back, after=reach_on)
    added = [
        F.when(_same_key(keys, -offset, w), F.lag(source, -offset).over(w)).alias(name)
        for name, (source, offset) in wanted.items()
    ]
    return spread.select("*", *added).filter("_home").drop("_home", "_block")


def rolling(
    placed: DataFrame, keys: Sequence[str], rows: int, wanted: dict[str, Column], size: int = BLOCK_ROWS
) -> DataFrame:
    """Aggregates over the current row and the ``rows`` - 1 before it within the key."""
    size = max(size, rows)
    w = Window.partitionBy("_block", *keys).orderBy("_g").rowsBetween(-(rows - 1), 0)
    spread = blocks(placed, size, before=rows - 1)
    return (
        spread.select("*", *[agg.over(w).alias(name) for name, agg in wanted.items()])
        .filter("_home")
        .drop("_home", "_block")
    )


def rolling_sums(
    placed: DataFrame, keys: Sequence[str], rows: int, wanted: dict[str, Column], size: int = BLOCK_ROWS
) -> DataFrame:
    """Sums over the current row and the ``rows`` - 1 before it: two prefix sums per row.

    A sliding frame would add up ``rows`` values at every row. NaN and infinities are counted beside the
    sums, so that they show in the windows that hold them and in no later one.
    """
    size = max(size, rows)
    w = Window.partitionBy("_block", *keys).orderBy("_g")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    spread = blocks(placed, size, before=rows)
    infinity = F.lit(float("inf"))
    sums: dict[str, Column] = {}
    fractional = {n for n, v in wanted.items() if spread.select(v.alias("v")).schema["v"].dataType.typeName() in ("double", "float")}
    for name, value in wanted.items():
        if name in fractional:
            odd = {"nan": F.isnan(value), "up": value == infinity, "down": value == -infinity}
            sums |= {f"_{label}_{name}": F.sum(F.when(rule, 1).otherwise(0)) for label, rule in odd.items()}
            value = F.when(odd["nan"] | odd["up"] | odd["down"], 0.0).otherwise(value)
        sums[f"_s_{name}"] = F.sum(value)
    summed = spread.withColumns({name: total.over(so_far) for name, total in sums.items()})

    def inside(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) - F.coalesce(F.lag(name, rows).over(w), F.lit(0))

    added = []
    for name in wanted:
        total = inside(f"_s_{name}")
        if name in fractional:
            nan, up, down = (inside(f"_{label}_{name}") > 0 for label in ("nan", "up", "down"))
            total = F.when(nan | (up & down), float("nan")).when(up, infinity).when(down, -infinity).otherwise(total)
        added.append(total.alias(name))
    return summed.select("*", *added).filter("_home").drop("_home", "_block", *sums)


def _with_carry(blocked: DataFrame, keys: Sequence[str], summary: Column, over: Column, reverse: bool) -> DataFrame:
    """Attach ``_carry``: the combined summary of this key's rows in all earlier (or later) blocks."""
    per_block = blocked.groupBy("_block", *keys).agg(summary.alias("_part"))
    # At most one row per block of a key, so this window is smaller than the data by the block size.
    # Later blocks come by descending order: a frame that ends at the partition's end is rescanned per row.
    order = F.desc("_block") if reverse else F.asc("_block")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"_of_{k}" for k in keys}
    carry = per_block.select(
        F.col("_block").alias("_of_block"), *[F.col(k).alias(n) for k, n in names.items()], over.over(w).alias("_carry")
    )
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    joined = blocked.join(carry, [F.col("_block") == F.col("_of_block"), *same], "left")
    return joined.drop("_of_block", *names.values())


def running_sum(
    placed: DataFrame, keys: Sequence[str], value: Column, out: str, size: int = BLOCK_ROWS
) -> DataFrame:
    """Inclusive running sum of ``value`` within the key."""
    blocked = blocks(placed, size).withColumn("_value", value)
    w = Window.partitionBy("_block", *keys).orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumn("_local", F.sum("_value").over(w))
    joined = _with_carry(local, keys, F.sum("_value"), F.sum("_part"), reverse=False)
    total = F.coalesce(F.col("_carry"), F.lit(0)) + F.coalesce(F.col("_local"), F.lit(0))
    return joined.withColumn(out, total).drop("_block", "_home", "_value", "_local", "_carry")


def number(placed: DataFrame, keys: Sequence[str], out: str = "rn", size: int = BLOCK_ROWS) -> DataFrame:
    """1-based row number within the key (within the whole table for no keys)."""
    if not keys:
        return placed.withColumn(out, F.col("_g") + 1)
    return running_sum(placed, keys, F.lit(1), out, size)


def nearest_known(
    placed: DataFrame, keys: Sequence[str], value: str, out: str, forward: bool = False, size: int = BLOCK_ROWS
) -> DataFrame:
    """Last non-NULL ``value`` at or before each row of the key; at or after it if ``forward``."""
    blocked = blocks(placed, size)
    order = F.desc("_g") if forward else F.asc("_g")
    w = Window.partitionBy("_block", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.col("_g"))
    here = F.last(value, ignorenulls=True).over(w)
    summary = F.min_by(value, known) if forward else F.max_by(value, known)
    over = F.last("_part", ignorenulls=True)
    joined = _with_carry(blocked.withColumn("_local", here), keys, summary, over, reverse=forward)
    return joined.withColumn(out, F.coalesce("_local", "_carry")).drop("_block", "_home", "_local", "_carry")
