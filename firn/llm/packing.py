"""Packing into length buckets whose boundaries minimise padding, then into token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from firn.llm.lines import numbered, query, table, word_count

LONGEST = 2048
BUCKETS = 16
BUDGET = 65_536


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length ranges with the least padding in all.

    ``lengths`` ascend. best[k][j] is the least padding of the first j lengths in k ranges; the last
    range starts after some i < j and pads all its pieces to lengths[j - 1]. Fewer ranges win ties,
    and of equal splits the one whose last range is longest.
    """
    n = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    tokens = np.concatenate(([0], np.cumsum(np.multiply(lengths, counts)))).astype(np.int64)
    size = len(lengths)
    best = np.full(size + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    choices: list[np.ndarray] = []
    totals = []
    for _ in range(min(buckets, size)):
        now = np.full(size + 1, np.iinfo(np.int64).max // 4)
        came = np.zeros(size + 1, np.int64)
        for j in range(1, size + 1):
            cost = best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (tokens[j] - tokens[:j])
            came[j] = int(np.argmin(cost))
            now[j] = cost[came[j]]
        choices.append(came)
        totals.append(now[size])
        best = now
    if not choices:
        return []
    out, j = [], size
    for came in reversed(choices[: int(np.argmin(totals)) + 1]):
        out.append(int(lengths[j - 1]))
        j = int(came[j])
    return sorted(out)


def pack(docs: DataFrame, size: Column, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 29) -> DataFrame:
    """Pieces of all rows in padded batches: ``doc_id``, ``piece``, ``start``, ``n_tokens``, ``bucket``
    (padded length), ``batch``, ``slot``.

    A row of more than ``longest`` tokens is cut into pieces of ``longest`` and a last shorter one, so
    the global histogram has at most ``longest`` lengths and is what the driver reads. Dynamic
    programming over it gives the bucket bounds. In each bucket the pieces stand in seeded order
    and fill batches of budget // bucket slots (at least one). ``batch`` counts from 0 in its bucket, ``slot`` in its batch;
    only a bucket's last batch can have open slots.

    A row without tokens (null or empty text) is one piece of 0 tokens with null bucket, batch and
    slot. Repeated rows are packed each; a null doc_id is packed like any other. Columns other
    than those ``size`` reads and ``doc_id`` are not used. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", size.cast("long").alias("_size"))
    last = F.greatest(F.ceil(F.col("_size") / longest) - 1, F.lit(0))
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("piece") * longest
    cut = cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("_size") - start, F.lit(longest)).alias("n_tokens"))
    histogram = sorted((r[0], r[1]) for r in cut.groupBy("n_tokens").count().collect() if r[0])
    bounds = boundaries([h[0] for h in histogram], [h[1] for h in histogram], buckets)
    upper = F.coalesce(*[F.when(F.col("n_tokens") <= b, b) for b in bounds], F.lit(None)) if bounds else F.lit(None)
    bucketed = cut.withColumn("bucket", F.when(F.col("n_tokens") > 0, upper).cast("long"))
    order = [F.xxhash64(F.lit(seed), "doc_id", "piece"), "doc_id", "piece", "n_tokens"]
    placed = numbered(bucketed, ["bucket"], order, "_n")
    slots = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    return placed.select(
        "doc_id", "piece", "start", "n_tokens", "bucket",
        F.floor(F.col("_n") / slots).cast("long").alias("batch"),
        F.when(F.col("bucket").isNotNull(), F.col("_n") % slots).cast("long").alias("slot"),
    )


@query("op3_packing")
def op3_packing(spark, folder):
    return pack(table(spark, folder, "documents"), word_count(F.col("text")))
