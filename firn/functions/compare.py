"""Two-valued comparisons.

Cut expressions come from a world where any comparison with NaN is false and nothing
is NULL. Spark orders NaN above every number and propagates NULL, so cuts go through
these helpers: NaN or NULL on either side gives FALSE, and negation stays total.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _two_valued(*conjuncts: Column) -> Column:
    """TRUE where all hold, else FALSE. The conjuncts are kept beside it for filters."""
    whole = F.coalesce(reduce(lambda a, b: a & b, conjuncts), F.lit(False))
    whole.conjuncts = list(conjuncts)
    return whole


def conjuncts(condition: Column) -> list[Column]:
    """The condition as plain conjuncts. A filter drops NULL as it drops FALSE, so it needs no two-valued
    form, and plain comparisons reach the Parquet reader."""
    return vars(condition).get("conjuncts") or [condition]


def both(*conditions: Column) -> Column:
    """Conjunction that keeps the conjuncts of its parts."""
    whole = reduce(lambda a, b: a & b, conditions)
    whole.conjuncts = [part for c in conditions for part in conjuncts(c)]
    return whole


def where(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows on which every condition is TRUE."""
    return reduce(lambda d, part: d.filter(part), [part for c in conditions for part in conjuncts(c)], df)


def gt(a, b) -> Column:
    a, b = col(a), col(b)
    return _two_valued(a > b, ~F.isnan(a))


def lt(a, b) -> Column:
    return gt(b, a)


def ge(a, b) -> Column:
    a, b = col(a), col(b)
    return _two_valued(a >= b, ~F.isnan(a))


def le(a, b) -> Column:
    return ge(b, a)


def eq(a, b) -> Column:
    a, b = col(a), col(b)
    return _two_valued(a == b, ~F.isnan(a))


def finite(a) -> Column:
    a = col(a)
    infinity = F.lit(float("inf"))
    return _two_valued(a < infinity, a > -infinity)


def half_open(a, low, high) -> Column:
    """low <= a < high."""
    return both(ge(a, low), lt(a, high))


def sentinel_to_null(a: Column, *sentinels: float) -> Column:
    """In-band 'no value' markers become NULL."""
    return F.when(a.isin(*sentinels), None).otherwise(a)


def rounded(value: Column, places: int) -> Column:
    """``F.round(value, places)`` of a double, the same numbers without a decimal for each.

    A whole number over a power of ten is the nearest double to that decimal, so only values near a tie or
    too large for an exact whole number take the slow way.
    """
    scale = float(10**places)
    scaled = value * F.lit(scale)
    clear = (F.abs(scaled) < float(1 << 40)) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(clear, F.floor(scaled + 0.5).cast("double") / F.lit(scale)).otherwise(F.round(value, places))
