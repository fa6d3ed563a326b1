"""Cut tables in one pass.

For n cuts the in-sequence, if-only and if-not counts are 3n conditional sums in a single
aggregate: one scan, one partial aggregate per task, one tiny shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from firn.functions.names import count_percent


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def cut_flow(
    df: DataFrame, cuts: list[tuple[str, Column]], weight: Column | None = None, preselect: bool = True
) -> DataFrame:
    """cut_index, cut, in_sequence, if_only, if_not.

    With ``preselect`` the first cut is required in all three counts.
    """
    w = F.lit(1.0) if weight is None else weight
    names = [name for name, _ in cuts]
    flags = [F.coalesce(c, F.lit(False)).alias(f"_c{i}") for i, (_, c) in enumerate(cuts)]
    flagged = df.select(*flags, w.cast("double").alias("_w"))
    passed = [F.col(f"_c{i}") for i in range(len(cuts))]
    always = passed[:1] if preselect else []
    sums: list[Column] = []
    for i in range(len(cuts)):
        only = always + ([passed[i]] if i or not preselect else [])
        without = always + [p for j, p in enumerate(passed) if j != i and not (preselect and j == 0)]
        for label, condition in (("seq", passed[: i + 1]), ("only", only), ("not", without)):
            sums.append(F.sum(F.when(_all(condition), F.col("_w")).otherwise(0.0)).alias(f"{label}{i}"))
    totals = flagged.agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("cut_index"),
                F.lit(name).alias("cut"),
                F.col(f"seq{i}").alias("in_sequence"),
                F.col(f"only{i}").alias("if_only"),
                F.col(f"not{i}").alias("if_not"),
            )
            for i, name in enumerate(names)
        ]
    )
    return totals.select(F.inline(rows))


def with_percent(table: DataFrame) -> DataFrame:
    """Adds 'n (p%)' texts relative to the first in-sequence count."""
    first = table.filter(F.col("cut_index") == 0).select(F.col("in_sequence").alias("_total"))
    joined = table.join(F.broadcast(first), F.col("cut_index") >= 0)
    texts = [count_percent(F.col(c), F.col("_total")).alias(f"{c}_text") for c in ("in_sequence", "if_only", "if_not")]
    return joined.select("cut_index", "cut", *texts)


def efficiency(df: DataFrame, group: Column, passed: Column, weight: Column | None = None) -> DataFrame:
    """Passed, total and their ratio per group, in one aggregate."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    hit = F.coalesce(passed, F.lit(False))
    sums = df.groupBy(group.alias("bin")).agg(
        F.sum(F.when(hit, w).otherwise(0.0)).alias("passed"), F.sum(w).alias("total")
    )
    return sums.withColumn("efficiency", F.try_divide("passed", "total"))
