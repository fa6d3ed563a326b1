"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from firn.llm.lines import query, same_join, table, word_count
from firn.operators.ordered import number, place
from firn.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_TOKENS = 64
SHARD_ROWS = 20_000
MOST_REPEATS = 3


def capped_targets(sources: DataFrame, most: float = MOST_REPEATS) -> DataFrame:
    """Share the sum of ``size`` by ``weight``: adds ``target``.

    A target stops at ``most`` times its source's size; the excess is shared again by weight until
    no target is above. Each round is one aggregate over the sources; rounds end when the share
    of a unit of weight no longer changes, after as many as there are steps of capped sources.
    """
    cap = F.col("size") * F.lit(float(most))
    total, weights = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).head()
    share = total / weights if weights else 0.0
    while True:
        full = cap <= F.col("weight") * F.lit(share)
        capped, left = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).head()
        if not left:
            break
        again = (total - (capped or 0.0)) / left
        if again <= share:
            break
        share = again
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(share)))


def apportion(items: DataFrame, by: Sequence[str], item: str, weight: str, seats: str, cap: str) -> DataFrame:
    """Sainte-Lague seats per item of each group: adds ``quota``.

    Seats go to the highest quotients weight / (2k + 1), k counting from 0; equal quotients go to the
    smaller ``item``. No item gets more than ``cap``, which must not be below its exact share. With m
    items in a group a quota cannot be further than m * share / seats + 1 from the exact share (the
    common divisor moves by at most that), so seats below this distance are given at once and only
    quotients within it are ranked: a few per item, over range partitions, never one task per group.
    """
    group = items.groupBy(*by).agg(F.sum(weight).alias("_all"), F.count("*").alias("_m"))
    wide = same_join(items, group, by, small=not by)
    share = F.when(F.col("_all") > 0, F.col(weight) * F.col(seats) / F.col("_all")).otherwise(0.0)
    reach = F.ceil(share / F.greatest(F.col(seats), F.lit(1)) * F.col("_m")) + 2
    ranged = wide.select("*", F.least(F.col(cap), F.greatest(F.lit(0), F.floor(share) - reach)).cast("long").alias("_base"), reach.alias("_reach"))
    ranged = materialize(ranged, "shares")
    last = F.least(F.col(cap), F.col("_base") + 2 * F.col("_reach") + 2) - 1
    open_seats = ranged.filter((last >= F.col("_base")) & (F.col(weight) > 0))
    quotients = open_seats.select(*by, item, F.col(weight).alias("_w"), F.explode(F.sequence("_base", last)).alias("_k"))
    quotients = quotients.select(*by, item, (-F.col("_w") / (2 * F.col("_k") + 1)).alias("_q"), "_k")
    ranked = number(place(materialize(quotients, "quotients"), [*by, "_q", item, "_k"]), list(by), "_rank")
    given = ranged.groupBy(*by).agg((F.max(seats) - F.sum("_base")).alias("_open"))
    won = same_join(ranked, given, by, small=not by).filter(F.col("_rank") <= F.col("_open"))
    won = won.groupBy(*by, item).agg(F.count("*").alias("_won"))
    quota = F.col("_base") + F.coalesce("_won", F.lit(0))
    return same_join(ranged, won, [*by, item], "left").select(*items.columns, quota.cast("long").alias("quota"))


def mix_sources(
    docs: DataFrame,
    size: Column,
    weights: Sequence[float] = WEIGHTS,
    block: int = BLOCK_TOKENS,
    seed: int = 17,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` of every row.

    Sources are weighted in turn by ``weights``, in code-point order, null last. The mix has as many
    tokens as all rows, shared as in ``capped_targets``, in blocks of ``block`` tokens: blocks go to
    sources by highest quotients and, within a source, to its shards. The rows of a shard stand in
    seeded order as one stream of tokens; the shard's quota is read from it in a circle, from a seeded block
    on, so a row is mostly taken whole, again in each further turn, and at most 3 times.

    Null or empty texts have size 0 and nothing taken. A null doc_id is placed by its text. Rows
    repeated in doc_id and text stand next to each other and are rows of their own. With no tokens at
    all every target is 0; an empty table gives an empty result. Equal input gives equal rows.

    A shard holds about ``shard_rows`` rows, so a source of any size spans many shards and tasks.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("_h"))
    rows = materialize(rows, "sizes")
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "sources")
    if sizes.isEmpty():
        return rows.select("doc_id", "source", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    order = place(sizes, [F.col("source").isNull(), "source"])
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = order.withColumn("weight", F.element_at(cycle, (F.col("_g") % len(weights)).cast("int") + 1))
    targets = materialize(capped_targets(weighted.drop("_g"), MOST_REPEATS), "targets")
    total = targets.agg(F.sum("size")).head()[0]
    blocks_of = F.ceil(F.col("size") * MOST_REPEATS / F.lit(block)).cast("long")
    per_source = targets.withColumn("_cap", blocks_of).withColumn("_seats", F.lit(round(total / block)).cast("long"))
    quotas = materialize(apportion(per_source, [], "source", "target", "_seats", "_cap"), "quotas")
    facts = quotas.select(
        "source", F.col("size").alias("source_size"), "target", F.col("quota").alias("_seats"), F.ceil(F.col("rows") / shard_rows).alias("_shards")
    )
    dealt = same_join(rows, facts, ["source"])
    dealt = dealt.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "_h"), "_shards")).drop("_shards")
    shards = dealt.groupBy("source", "_shard").agg(F.sum("size").alias("_length"), F.max("_seats").alias("_seats"))
    shards = shards.withColumn("_cap", F.ceil(F.col("_length") * MOST_REPEATS / F.lit(block)).cast("long"))
    shard_quotas = apportion(shards, ["source"], "_shard", "_length", "_seats", "_cap")
    run = F.least(F.col("quota") * block, F.col("_length") * MOST_REPEATS)
    begin = F.pmod(F.xxhash64(F.lit(seed + 1), "source", "_shard"), F.greatest(F.ceil(F.col("_length") / block), F.lit(1))) * block
    plan = shard_quotas.select("source", "_shard", "_length", run.alias("_run"), begin.alias("_begin"))
    stream = Window.partitionBy("source", "_shard").orderBy(F.xxhash64(F.lit(seed + 2), "_h"), "doc_id", "size")
    placed = dealt.withColumn("_end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    met = same_join(placed, plan, ["source", "_shard"])
    return met.select("doc_id", "source", "size", "source_size", "target", _taken().alias("taken"))


def _taken() -> Column:
    """Tokens of [end - size, end) read by a run of ``_run`` tokens in a circle of ``_length`` from ``_begin``."""
    length, run, begin = F.greatest(F.col("_length"), F.lit(1)), F.col("_run"), F.col("_begin")
    turns, rest = F.floor(run / length), run % length

    def overlap(start: Column) -> Column:
        low = F.greatest(start, F.col("_end") - F.col("size"))
        return F.greatest(F.lit(0), F.least(start + rest, F.col("_end")) - low)

    return (turns * F.col("size") + overlap(begin) + overlap(begin - length)).cast("long")


def mixed(docs: DataFrame, size: Column, seed: int = 17) -> DataFrame:
    """``docs`` in the mix: each row stands as often as its taken tokens make up whole texts, to the
    nearest number; rows of which less than half is taken are left out. Rows without tokens stay once.
    Rows that repeat a doc_id share the mean of their number."""
    found = mix_sources(docs, size, seed=seed).groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
    times = F.when(F.col("s") == 0, 1).otherwise(F.floor(F.col("t") / F.col("s") + 0.5)).cast("int")
    counts = found.select(F.col("doc_id").alias("_id"), times.alias("_times")).filter("_times > 0")
    # The whole row travels as one column, so its own column names cannot clash with these.
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("_whole"))
    joined = rows.join(counts, F.col("doc_id").eqNullSafe(F.col("_id")))
    return joined.select("_whole", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_whole.*")


@query("op5_mixing")
def op5_mixing(spark, folder):
    docs = table(spark, folder, "documents")
    return mix_sources(docs, word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken", "source")
