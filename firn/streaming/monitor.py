"""Count-bounded noise monitor on Structured Streaming state.

State per channel: the last N (event, amplitude) pairs. Rows of a micro-batch are taken in
event order; ids not after the last one seen are skipped, which also drops repeats.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from firn.functions.rayleigh import fit_windows
from firn.operators.monitor import ROWS_AT_ONCE, WINDOW

OUTPUT = (
    "channel string, eventNumber bigint, amplitude double, window_rows int, mean_power double, "
    "scale double, chi_square double, ndf int, log10_prob double"
)
STATE = "last_event bigint, amplitudes array<double>"


def _update(rows: int):
    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, kept = (state.get if state.exists else (-1, []))
        new = pd.concat(list(batches)).sort_values("eventNumber").drop_duplicates("eventNumber")
        new = new[new["eventNumber"] > last]
        if new.empty:
            return
        values = new["amplitude"].to_numpy(dtype=float)
        line = np.concatenate([np.asarray(kept, dtype=float), values])
        padded = np.concatenate([np.full(rows - 1, np.nan), line])
        windows = np.lib.stride_tricks.sliding_window_view(padded, rows)[len(kept) :]
        state.update((int(new["eventNumber"].iloc[-1]), line[-(rows - 1) :].tolist() if rows > 1 else []))
        for start in range(0, len(values), ROWS_AT_ONCE):
            part, amps = windows[start : start + ROWS_AT_ONCE], values[start : start + ROWS_AT_ONCE]
            scale, chi, ndf = fit_windows(part)
            safe = np.where(scale > 0, scale, np.nan)
            yield pd.DataFrame(
                {
                    "channel": key[0],
                    "eventNumber": new["eventNumber"].to_numpy()[start : start + ROWS_AT_ONCE],
                    "amplitude": amps,
                    "window_rows": (~np.isnan(part)).sum(axis=1).astype("int32"),
                    "mean_power": np.nanmean(part**2, axis=1),
                    "scale": scale,
                    "chi_square": chi,
                    "ndf": ndf.astype("int32"),
                    "log10_prob": -0.5 * (amps / safe) ** 2 / np.log(10.0),
                }
            )

    return step


def monitor(stream: DataFrame, good: Column | None = None, rows: int = WINDOW) -> DataFrame:
    """Monitor rows for a stream of (channel, eventNumber, amplitude).

    Channels should be as fine as (polarisation, antenna, frequency): that bounds the
    state of a key to N amplitudes and spreads a busy antenna over many keys.
    """
    kept = stream if good is None else stream.filter(F.coalesce(good, F.lit(False)))
    return (
        kept.select(F.col("channel").cast("string"), "eventNumber", "amplitude")
        .groupBy("channel")
        .applyInPandasWithState(_update(rows), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    )


def history(batch: DataFrame, before: int, rows: int = WINDOW, margin: int = 200) -> DataFrame:
    """Rows to replay before event ``before``: the last N + margin events, across runs.

    Feed them ahead of the live rows to start with full windows.
    """
    ids = batch.filter(F.col("eventNumber") < before).select("eventNumber").distinct()
    # N + margin ids, fixed by the window: safe to broadcast.
    recent = ids.orderBy(F.desc("eventNumber")).limit(rows + margin)
    return batch.join(F.broadcast(recent), "eventNumber", "left_semi")


def noise_stream(stream: DataFrame, time: str, keys: list[str], rms: str, seconds: float = 10.0, late: str = "1 minute") -> DataFrame:
    """Mean noise per channel in ``seconds``-long windows, closed once the watermark passes."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    grouped = timed.groupBy(F.window("_t", f"{seconds} seconds"), *keys).agg(F.avg(rms).alias("noise"), F.count(rms).alias("n"))
    return grouped.select(F.col("window.start").alias("start"), *keys, "noise", "n")
