"""Two-class linear discriminant from one aggregate, and its score as a column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from firn.functions.scores import linear_score, score_text


def moments(df: DataFrame, label: Column, columns: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """Weighted sums per class: total weight, first and second moments.

    Map-side combined, so the shuffle carries two rows per task whatever the data size.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    names = list(columns)
    base = df.select(label.alias("label"), w.alias("_w"), *[c.cast("double").alias(n) for n, c in columns.items()])
    complete = base.filter(F.expr(" AND ".join(f"`{n}` IS NOT NULL AND NOT isnan(`{n}`)" for n in names)))
    aggs = [F.sum("_w").alias("w")]
    aggs += [F.sum(F.col("_w") * F.col(n)).alias(f"s_{n}") for n in names]
    aggs += [
        F.sum(F.col("_w") * F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[i:]
    ]
    return complete.groupBy("label").agg(*aggs)


@dataclass(frozen=True)
class Discriminant:
    intercept: float
    terms: list[tuple[float, str]]

    def score(self, columns: dict[str, Column] | None = None) -> Column:
        if columns is None:
            return linear_score(self.intercept, self.terms)
        total = F.lit(self.intercept)
        for weight, name in self.terms:
            total = total + F.lit(weight) * columns[name]
        return total

    def text(self) -> str:
        return score_text(self.intercept, self.terms)


def fisher(table: DataFrame, names: Sequence[str]) -> Discriminant:
    """Fisher direction from the two moment rows: within-class inverse times the mean difference.

    Scaled as sqrt(Ns*Nb)/(Ns+Nb), offset so the midpoint of the class means scores 0.
    """
    rows = {r["label"]: r for r in table.collect()}  # two rows
    if set(rows) != {0, 1}:
        raise ValueError("labels must be 0 (background) and 1 (signal)")
    n = len(names)
    mean, within, total = {}, np.zeros((n, n)), {}
    for k, r in rows.items():
        total[k] = r["w"]
        mean[k] = np.array([r[f"s_{a}"] for a in names]) / r["w"]
        for i, a in enumerate(names):
            for j in range(i, n):
                spread = r[f"s_{a}_{names[j]}"] - r["w"] * mean[k][i] * mean[k][j]
                within[i, j] += spread
                if i != j:
                    within[j, i] += spread
    within /= total[0] + total[1]
    direction = np.linalg.solve(within, mean[1] - mean[0]) * np.sqrt(total[0] * total[1]) / (total[0] + total[1])
    offset = -float(direction @ (mean[0] + mean[1])) / 2
    return Discriminant(offset, [(float(w), a) for w, a in zip(direction, names)])


def train(
    signal: DataFrame, background: DataFrame, columns: dict[str, Column], weight: Column | None = None
) -> Discriminant:
    """Train on two tables; only the needed columns are read."""
    kept = [c.cast("double").alias(n) for n, c in columns.items()]
    w = (F.lit(1.0) if weight is None else weight).cast("double").alias("_weight")
    both = signal.select(*kept, w, F.lit(1).alias("_label")).unionByName(
        background.select(*kept, w, F.lit(0).alias("_label"))
    )
    table = moments(both, F.col("_label"), {n: F.col(n) for n in columns}, F.col("_weight"))
    return fisher(table, list(columns))


def minimise_overlap(
    signal: DataFrame, background: DataFrame, names: Sequence[str], start: Sequence[float], bins: int = 1024,
    rounds: int = 3, steps: Sequence[float] = (-0.5, 0.0, 0.5),
) -> tuple[list[float], float]:
    """Coordinate search over score weights for the smallest overlap.

    The overlap is signal below the largest background score over signal above it. All
    trial weights of a coordinate are scored in one pass over each table.
    """
    best, merit, scale = list(start), float("inf"), 1.0
    for _ in range(rounds):
        for i in range(len(best)):
            trials = [best[:i] + [best[i] + scale * s * max(abs(best[i]), 1.0)] + best[i + 1 :] for s in steps]
            values = _overlaps(signal, background, names, trials)
            k = int(np.argmin(values))
            if values[k] < merit:
                merit, best = values[k], trials[k]
        scale /= 2
    return best, merit


def _overlaps(signal: DataFrame, background: DataFrame, names: Sequence[str], trials: list[list[float]]) -> list[float]:
    def scores() -> list[Column]:
        return [sum((F.lit(float(w)) * F.col(n) for w, n in zip(t, names)), F.lit(0.0)) for t in trials]

    edges = background.agg(*[F.max(s).alias(f"m{i}") for i, s in enumerate(scores())]).first()
    sums = signal.agg(
        *[
            F.sum(F.when(s <= edges[i], F.col("weight")).otherwise(0.0)).alias(f"b{i}")
            for i, s in enumerate(scores())
        ],
        *[F.sum(F.when(s > edges[i], F.col("weight")).otherwise(0.0)).alias(f"a{i}") for i, s in enumerate(scores())],
    ).first()
    return [sums[f"b{i}"] / sums[f"a{i}"] if sums[f"a{i}"] else float("inf") for i in range(len(trials))]


def exponential_tail(hist: DataFrame, centre: Column, width: float) -> DataFrame:
    """log-linear least squares of non-empty bins, and the integral beyond a given x as a rule.

    Result: slope, intercept (of ln content against x), bins used, reduced chi-square.
    """
    used = hist.filter(F.col("content") > 0).select(centre.alias("x"), F.ln("content").alias("y"), "content")
    fit = used.agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count("*").alias("bins"),
        F.sum("x").alias("_sx"),
    )
    expected = F.exp(F.col("intercept") + F.col("slope") * F.col("x"))
    joined = used.join(F.broadcast(fit), F.col("bins") > 0)
    chi = F.sum(F.pow(F.col("content") - expected, 2) / F.col("content"))
    out = joined.agg(
        F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.first("bins").alias("bins"), chi.alias("_chi")
    )
    return out.select("slope", "intercept", "bins", F.try_divide(F.col("_chi"), F.col("bins") - 2).alias("reduced_chi"))


def exponential_integral(slope: Column, intercept: Column, start: float, width: float) -> Column:
    """Expected entries above ``start`` for a falling exponential fitted per bin of ``width``."""
    return F.when(slope < 0, F.exp(intercept + slope * start) / (-slope * width))


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "component", value: str = "value") -> DataFrame:
    return df.select(*keys, *columns).unpivot(list(keys), list(columns), name, value)
