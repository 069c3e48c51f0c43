"""Operators that carry state along an unbounded stream.

A streaming signal has the columns of a signal and ``ts``, a timestamp that watermarks go by. Projections and spatial
filters need no version of their own: their column expressions work on streams as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.filters import System, butter_bandpass, from_coefficients, notch
from ..spec import Signal

STATS = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "range": lambda x: F.max(x) - F.min(x), "median": lambda x: F.percentile(x, F.lit(0.5))}


def linear_filter(s: Signal, system: System) -> Signal:
    """Causal filtering from an empty state; the filter's state is all that is kept of a recording.

    A trigger's samples are sorted by number. One that comes after a later one was filtered has no state to be
    filtered from: it stays, with null channels. The size of a trigger is the source's (``maxFilesPerTrigger``).
    """
    s.need("signal")
    channels, order = list(s.channels), system.order
    df = s.df.select("rec", "seq", "t", *channels)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        z, last = np.zeros((order, len(channels))), -1
        if state.exists:
            kept, last = state.get
            z = np.reshape(np.asarray(kept, np.float64), z.shape)
        frame = pd.concat(list(frames)).sort_values("seq", ignore_index=True)
        frame[channels] = frame[channels].astype(np.float64)
        fresh = frame["seq"].to_numpy() > last
        if fresh.any():
            y, z = system.run(frame.loc[fresh, channels].to_numpy(), z)
            frame.loc[fresh, channels] = y
            last = int(frame["seq"].max())
        frame.loc[~fresh, channels] = None
        state.update((z.ravel().tolist(), last))
        yield frame

    out = df.groupBy("rec").applyInPandasWithState(run, df.schema, "z array<double>, last bigint", "append", GroupStateTimeout.NoTimeout)
    return replace(s, df=out)


def butter(s: Signal, lowcut: float, highcut: float, order: int = 4) -> Signal:
    return linear_filter(s, from_coefficients(*butter_bandpass(order, lowcut, highcut, s.fs)))


def notch_filter(s: Signal, frequency: float, quality: float) -> Signal:
    return linear_filter(s, from_coefficients(*notch(frequency, quality, s.fs)))


def epoch_stat(s: Signal, stat: str, duration: str, interval: str, delay: str) -> DataFrame:
    """(rec, epoch_start, epoch_end, channels): a number for each sliding window and channel, given out once the
    watermark, ``delay`` behind the latest sample, has passed its end. Windows are aligned to the clock."""
    s.need("signal")
    if stat not in STATS:
        raise ValueError(f"{stat} is none of {', '.join(STATS)}")
    windows = s.df.withWatermark("ts", delay).groupBy("rec", F.window("ts", duration, interval).alias("w"))
    found = windows.agg(*[STATS[stat](F.nanvl(v, F.lit(None))).alias(c) for c, v in s.values().items()])
    return found.select("rec", F.col("w.start").alias("epoch_start"), F.col("w.end").alias("epoch_end"), *[F.col(f"`{c}`") for c in s.channels])


def stimulation_epochs(s: Signal, markers: DataFrame, stimulation: list[str], offset: float, duration: float, delay: str) -> DataFrame:
    """Samples of the window of ``duration`` seconds that begins ``offset`` after each wanted marker.

    ``markers``: (rec, mseq, ts, marker). Both sides' rows are kept only until the watermarks have passed the window.
    """
    s.need("signal")
    after = lambda seconds: F.make_dt_interval(secs=F.lit(float(seconds)))
    wanted = markers.where(F.col("marker").isin([str(x) for x in stimulation])).withWatermark("ts", delay)
    wanted = wanted.select(F.col("rec").alias("__rec"), F.col("mseq").alias("epoch_id"), F.col("ts").alias("__at"), F.col("marker").alias("label"))
    inside = (F.col("ts") >= F.col("__at") + after(offset)) & (F.col("ts") < F.col("__at") + after(offset + duration))
    both = s.df.withWatermark("ts", delay).join(wanted, (F.col("rec") == F.col("__rec")) & inside)
    return both.select("rec", "epoch_id", (F.col("__at") + after(offset)).alias("epoch_start"), "label", "seq", "t", "ts", *[F.col(f"`{c}`") for c in s.channels])
