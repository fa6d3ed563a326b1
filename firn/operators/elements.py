"""Cuts and projections over the [polarisation][direction] arrays inside each row.

Everything is a higher-order function on one row's bounded array, so a skim or a
flattening is a single narrow stage with no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from firn.functions.compare import where

Element = Callable[[Column], Column]
WAVEFORMS = ("coherent", "coherent_filtered", "deconvolved", "deconvolved_filtered")


def linear_elements(fields: Sequence[str], directions: int) -> Column:
    """Zip nested arrays into one array of structs with the linear index ``i``, ``pol`` and ``ind``."""
    flat = F.arrays_zip(*[F.flatten(F.col(f)).alias(f) for f in fields])
    return F.transform(
        flat,
        lambda e, i: F.struct(
            i.alias("i"),
            F.floor(i / directions).cast("int").alias("pol"),
            (i % directions).alias("ind"),
            *[e[f].alias(f) for f in fields],
        ),
    )


def max_over(elements: Column, value: Element) -> Column:
    """Row-level maximum of an element expression."""
    return F.array_max(F.transform(elements, value))


def both(cuts: Sequence[Element]) -> Element:
    """All cuts on the same element."""
    return lambda e: reduce(lambda a, b: a & b, [c(e) for c in cuts], F.lit(True))


def any_pass(elements: Column, cuts: Sequence[Element]) -> Column:
    """Does one single element satisfy every cut?"""
    return F.exists(elements, lambda e: F.coalesce(both(cuts)(e), F.lit(False)))


def survivors(elements: Column, cuts: Sequence[Element]) -> Column:
    return F.filter(elements, lambda e: F.coalesce(both(cuts)(e), F.lit(False)))


def first_survivor(elements: Column, cuts: Sequence[Element]) -> Column:
    """First passing element in linear order, NULL if none."""
    return F.get(survivors(elements, cuts), F.lit(0))


def survivors_per_cut(elements: Column, cuts: Sequence[Element]) -> Column:
    """How many elements remain after each cut in turn."""
    return F.array(*[F.size(survivors(elements, cuts[: k + 1])) for k in range(len(cuts))])


def best_element(elements: Column, key: Element) -> Column:
    """First element with the largest key (``highestPeak``, ``mostImpulsivePeak``)."""
    top = max_over(elements, key)
    return F.get(F.filter(elements, lambda e: key(e) == top), F.lit(0))


def kth_best(elements: Column, key: Element, k: int) -> Column:
    """The element with the k-th largest key (0-based), earlier index first on ties."""
    ranked = F.sort_array(F.transform(elements, lambda e: F.struct(key(e).alias("key"), (-e["i"]).alias("minus_i"))), asc=False)
    chosen = F.get(ranked, F.lit(k))["minus_i"]
    return F.get(F.filter(elements, lambda e: e["i"] == -chosen), F.lit(0))


def skim(df: DataFrame, elements: Column, scalar_cuts: Sequence[Column], element_cuts: Sequence[Element]) -> DataFrame:
    """Rows passing, unchanged. Scalar cuts come first so Parquet filters can use them."""
    kept = where(df, *scalar_cuts)
    return kept.filter(any_pass(elements, element_cuts)) if element_cuts else kept


def flatten_first(
    df: DataFrame,
    elements: Column,
    scalar_cuts: Sequence[Column],
    element_cuts: Sequence[Element],
    columns: dict[str, Column | Element],
) -> DataFrame:
    """One flat row per passing input row, evaluated at its first surviving element."""
    kept = where(df, *scalar_cuts)
    chosen = kept.withColumn("_e", first_survivor(elements, element_cuts)).filter(F.col("_e").isNotNull())
    return chosen.select(
        *[(c if isinstance(c, Column) else c(F.col("_e"))).alias(name) for name, c in columns.items()]
    )


def explode_elements(df: DataFrame, elements: Column, keep: Sequence[str]) -> DataFrame:
    """One row per element with its index, polarisation and direction."""
    return df.select(*keep, F.explode(elements).alias("_e")).select(*keep, "_e.*")
