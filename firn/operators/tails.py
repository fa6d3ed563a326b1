"""Fits to binned data: falling tails from every start bin, and a Gaussian in every slice of a 2-D histogram.

Inputs are histograms, whose rows are bounded by their bins; the data are read once, to fill them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from firn.operators.histogram import Axis

# Fixed value: fits with a larger chi-square per degree of freedom are not used.
LARGEST_CHI = 1.5
MODELS = ("exponential", "power")


def tail_scan(hist: DataFrame, axis: Axis, threshold: float, by: Sequence[str] = (), largest_chi: float = LARGEST_CHI) -> DataFrame:
    """Exponential and power-law fit of the tail from every non-empty bin on: one row per ``by``, model and start bin.

    The logarithm of a bin's content has the error 1 / sqrt(content), so a line through ln(content) against x (exponential) or
    ln(x) (power law) is fitted with the contents as weights. Weighted sums from the last bin down to each bin give the fits of
    all starts in one pass. Columns: ``start`` (low edge), ``bins``, ``slope``, ``intercept``, ``reduced_chi`` (NULL under three bins), ``good``
    (reduced_chi below ``largest_chi``), ``at_threshold`` (fitted content of a bin there) and ``above`` (entries
    above the threshold if the tail goes on for ever; NULL where it would not end).

    Empty bins, and bins at x <= 0 for the power law, take no part.
    """
    centre = axis.centre(F.col("bin"))
    models = F.array(*[F.struct(F.lit(m).alias("model"), (centre if m == "exponential" else F.when(centre > 0, F.ln(centre))).alias("x")) for m in MODELS])
    points = hist.filter((F.col("content") > 0) & F.col("bin").between(1, axis.bins)).select(*by, "bin", "content", F.explode(models).alias("_m"))
    # Places are taken from the threshold's, which keeps the sums small.
    origin = F.when(F.col("_m.model") == "power", F.lit(float(np.log(threshold)))).otherwise(F.lit(float(threshold)))
    points = points.filter("_m.x is not null").select(*by, "bin", F.col("_m.model").alias("model"), "content", (F.col("_m.x") - origin).alias("x"), F.ln("content").alias("y"))
    # A histogram is bounded by its bins, so a group of bins is small.
    down = Window.partitionBy(*by, "model").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    w, x, y = F.col("content"), F.col("x"), F.col("y")
    sums = {"s0": w, "sx": w * x, "sy": w * y, "sxx": w * x * x, "sxy": w * x * y, "syy": w * y * y}
    summed = points.select(*by, "model", "bin", F.count("*").over(down).alias("bins"), *[F.sum(v).over(down).alias(k) for k, v in sums.items()])
    det = F.col("s0") * F.col("sxx") - F.col("sx") * F.col("sx")
    lines = summed.withColumn("slope", F.when(F.col("bins") >= 2, F.try_divide(F.col("s0") * F.col("sxy") - F.col("sx") * F.col("sy"), det)))
    lines = lines.withColumn("_at", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("s0"))
    chi = F.col("syy") - F.col("_at") * F.col("sy") - F.col("slope") * F.col("sxy")
    lines = lines.withColumn("reduced_chi", F.when(F.col("bins") >= 3, F.greatest(chi, F.lit(0.0)) / (F.col("bins") - 2)))
    value = F.exp("_at")
    power = F.col("model") == "power"
    # Contents are per bin, so integrals are divided by the width.
    endless = F.when(power, F.when(F.col("slope") < -1, value * F.lit(float(threshold)) / (-F.col("slope") - 1))).otherwise(F.when(F.col("slope") < 0, value / -F.col("slope")))
    intercept = F.col("_at") - F.col("slope") * F.when(power, F.lit(float(np.log(threshold)))).otherwise(F.lit(float(threshold)))
    return lines.select(
        *by, "model", axis.low_edge(F.col("bin")).alias("start"), "bins", "slope", intercept.alias("intercept"), "reduced_chi",
        F.coalesce(F.col("reduced_chi") < largest_chi, F.lit(False)).alias("good"), value.alias("at_threshold"), (endless / axis.width).alias("above"),
    )


def tail_estimates(scan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number, mean and spread of the good fits' estimates above the threshold, per model."""
    good = scan.filter("good and above is not null")
    return good.groupBy(*by, "model").agg(F.count("*").alias("fits"), F.avg("above").alias("mean"), F.stddev_pop("above").alias("spread"), F.min("above").alias("lowest"), F.max("above").alias("highest"))


def gaussian_fit(x: np.ndarray, content: np.ndarray, rounds: int = 100, tolerance: float = 1e-10) -> tuple[float, float, float, float, bool]:
    """Height, mean, width, chi-square and convergence of a Gaussian through non-empty bins with errors sqrt(content).

    Damped least squares from the moments of the bins.
    """
    total = content.sum()
    mean = float((content * x).sum() / total)
    width = float(np.sqrt(max((content * (x - mean) ** 2).sum() / total, 0.0)))
    if len(x) < 3 or width == 0.0:
        return float(content.max()), mean, width, float("nan"), False
    p = np.array([content.max(), mean, width])
    error = np.sqrt(content)

    def gap(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = np.exp(-0.5 * ((x - q[1]) / q[2]) ** 2)
        slope = np.stack([shape, q[0] * shape * (x - q[1]) / q[2] ** 2, q[0] * shape * (x - q[1]) ** 2 / q[2] ** 3], axis=1)
        return (content - q[0] * shape) / error, slope / error[:, None]

    r, j = gap(p)
    cost, damp, done = float(r @ r), 1e-3, False
    for _ in range(rounds):
        normal, right = j.T @ j, j.T @ r
        step = np.linalg.lstsq(normal + damp * np.diag(np.diag(normal)), right, rcond=None)[0]
        q = p + step
        q[2] = abs(q[2]) or p[2]
        r2, j2 = gap(q)
        new = float(r2 @ r2)
        if new <= cost:
            done = cost - new <= tolerance * max(1.0, cost) and damp < 1
            p, r, j, cost, damp = q, r2, j2, new, damp / 10
            if done:
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    return float(p[0]), float(p[1]), float(p[2]), cost, done


def fit_slices(hist: DataFrame, y_axis: Axis, least: int = 3) -> DataFrame:
    """Gaussian of every x slice of a 2-D histogram (``bin_x``, ``bin_y``, ``content``): one row per slice.

    ``height``, ``mean``, ``width``, ``reduced_chi`` (NULL without degrees of freedom), ``bins`` and ``converged``. Slices with fewer than ``least`` non-empty bins keep their moments and do
    not converge. Under- and overflow take no part. A slice is one group, bounded by the bins of the y axis.
    """
    points = hist.filter(F.col("bin_y").between(1, y_axis.bins) & (F.col("content") > 0)).select("bin_x", y_axis.centre(F.col("bin_y")).alias("y"), F.col("content").cast("double").alias("content"))
    kind = str(hist.schema["bin_x"].dataType.simpleString())

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("y")
        y, content = rows["y"].to_numpy(), rows["content"].to_numpy()
        height, mean, width, chi, converged = gaussian_fit(y, content)
        free = len(y) - 3
        return pa.table(
            {
                "bin_x": rows["bin_x"].slice(0, 1), "bins": pa.array([len(y)], pa.int64()), "height": [height], "mean": [mean], "width": [width],
                "reduced_chi": pa.array([chi / free if free > 0 and len(y) >= least else None], pa.float64()), "converged": [converged and len(y) >= least],
            }
        )

    return points.groupBy("bin_x").applyInArrow(fit, f"bin_x {kind}, bins long, height double, mean double, width double, reduced_chi double, converged boolean")
