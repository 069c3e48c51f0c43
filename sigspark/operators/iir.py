"""Recursive filters over recordings of any length.

A recording is cut into blocks of ``BLOCK`` samples (the last takes what is left, fewer than two blocks), each gathered
as arrays in one row. The input is read for that once; all passes go from rows of blocks to rows of blocks. Many blocks are
filtered at a time: those of one length, of any recordings, are columns of one matrix.

Recordings of more than one block need the state that enters a block. A pass filters their blocks from an empty
state and keeps each one's last state, one row a block; these rows are chained along the recording (what the earlier states
have become), and the filtering pass starts from them. Blocks, not recordings, are what a task must hold.
No job runs while a plan is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import System, butter_bandpass, chebyshev_lowpass, from_coefficients, notch, windowed_sinc
from ..spec import Signal

BLOCK = 65_536
#: Samples added at either end for a filter without phase: three times the taps of an eighth-order filter.
PAD = 27


def gathered(s: Signal, block: int) -> DataFrame:
    """(rec, block, blocks: how many the recording has, first: number of the block's first sample, t, c0, c1, ...), the
    last ones arrays over the block's samples."""
    bounds = s.df.groupBy("rec").agg(F.min("seq").alias("__a"), (F.max("seq") - F.min("seq") + 1).alias("__n"))
    blocks = F.greatest(F.floor(F.col("__n") / block), F.lit(1))
    place = F.least(F.floor((F.col("seq") - F.col("__a")) / block), blocks - 1)
    values = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(s.channels)]
    rows = s.df.join(bounds, "rec").select("rec", place.alias("block"), blocks.alias("blocks"), F.struct("seq", "t", *values).alias("x"))
    found = rows.groupBy("rec", "block").agg(F.max("blocks").alias("blocks"), F.array_sort(F.collect_list("x")).alias("x"))
    return found.select("rec", "block", "blocks", F.col("x")[0]["seq"].alias("first"), F.col("x.t").alias("t"), *[F.col(f"x.c{i}").alias(f"c{i}") for i in range(len(values))])


def _by_length(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of rows, samples x rows x channels) for each length of the blocks of a batch."""
    channels = [c for c in frame.columns if c.startswith("c")]
    lengths = frame["t"].map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.stack([np.stack(frame[c].iloc[at].to_list()) for c in channels], 2).transpose(1, 0, 2).astype(np.float64)


def _run(system: System, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``System.run`` for samples x rows x channels, and states order x rows x channels."""
    n, rows, channels = x.shape
    y, z = system.run(x.reshape(n, rows * channels), z.reshape(system.order, rows * channels))
    return y.reshape(n, rows, channels), z.reshape(system.order, rows, channels)


def _pass(blocks: DataFrame, system: System, steady: bool, back: bool = False) -> DataFrame:
    """Blocks filtered along each recording, or against it. ``steady``: the first sample begins as if it had always been."""
    wide = len([c for c in blocks.columns if c.startswith("c")])
    names = [f"c{i}" for i in range(wide)]
    shape, rec = blocks.schema, blocks.schema["rec"].dataType.simpleString()
    order = system.order

    def begin(frame: pd.DataFrame, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The states that enter blocks, where these are a recording's first ones."""
        first = (frame["blocks"] - 1 == frame["block"] if back else frame["block"] == 0).to_numpy()[at]
        z = np.zeros((order, len(at), wide))
        if steady:
            z[:, first] = system.steady()[:, None, None] * x[0][None, first]
        return z

    def states(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [None] * len(frame)
            for at, x in _by_length(frame):
                x = x[::-1] if back else x
                z = _run(system, x, begin(frame, at, x))[1]
                for k, i in enumerate(at):
                    out[i] = z[:, k].ravel()
            yield pd.DataFrame({"rec": frame["rec"], "block": frame["block"], "n": frame["t"].map(len), "z": out})

    def chained(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block", ascending=not back)
        z, found = np.zeros((order, wide)), []
        for n, last in zip(frame["n"], frame["z"], strict=True):
            found.append(z.ravel())
            z = system.advance(int(n)) @ z + np.reshape(last, (order, wide))
        return pd.DataFrame({"rec": frame["rec"], "block": frame["block"], "z": found})

    def outputs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: dict[str, list] = {c: [None] * len(frame) for c in names}
            for at, x in _by_length(frame):
                x = x[::-1] if back else x
                z = begin(frame, at, x)
                for k, i in enumerate(at):
                    if frame["z"].iloc[i] is not None:
                        z[:, k] += np.reshape(frame["z"].iloc[i], (order, wide))
                y = _run(system, x, z)[0]
                y = y[::-1] if back else y
                for c, name in enumerate(names):
                    for k, i in enumerate(at):
                        out[name][i] = y[:, k, c]
            yield frame.assign(**out)[shape.names]

    # A block's state matters only to blocks behind it: recordings of one block take no part in the first pass.
    ends = blocks.where("blocks > 1").mapInPandas(states, f"rec {rec}, block bigint, n bigint, z array<double>")
    entering = ends.groupBy("rec").applyInPandas(chained, f"rec {rec}, block bigint, z array<double>")
    return blocks.join(entering, ["rec", "block"], "left").select(*shape.names, "z").mapInPandas(outputs, shape)


def _samples(s: Signal, blocks: DataFrame, every: int = 1) -> DataFrame:
    """Rows of a signal again; of those numbers that ``every`` divides, and divided by it."""
    each = F.posexplode(F.arrays_zip("t", *[f"c{i}" for i in range(len(s.channels))]))
    rows = blocks.select("rec", "first", each.alias("i", "x")).withColumn("seq", F.col("first") + F.col("i"))
    rows = rows.where(F.col("seq") % every == 0) if every > 1 else rows
    return rows.select("rec", (F.col("seq") / every).cast("bigint").alias("seq") if every > 1 else "seq", "x.t", *[F.col(f"x.c{i}").alias(c) for i, c in enumerate(s.channels)])


def linear_filter(s: Signal, system: System, block: int = BLOCK) -> Signal:
    """Causal filtering from an empty state, sample by sample of each recording."""
    s.need("signal")
    return replace(s, df=_samples(s, _pass(gathered(s, block), system, False)))


def butter(s: Signal, lowcut: float, highcut: float, order: int = 4, block: int = BLOCK) -> Signal:
    return linear_filter(s, from_coefficients(*butter_bandpass(order, lowcut, highcut, s.fs)), block)


def notch_filter(s: Signal, frequency: float, quality: float, block: int = BLOCK) -> Signal:
    return linear_filter(s, from_coefficients(*notch(frequency, quality, s.fs)), block)


def fir_lowpass(s: Signal, taps: int, cutoff: float, block: int = BLOCK) -> Signal:
    return linear_filter(s, from_coefficients(windowed_sinc(taps, cutoff, s.fs), [1.0]), block)


def _turned(blocks: DataFrame, on: bool) -> DataFrame:
    """The first and the last block of each recording longer (``on``) or shorter by ``PAD`` samples, those that stand next
    to the end, turned about the end sample. Recordings of ``PAD`` samples or fewer have none to turn and give nothing."""
    wide = len([c for c in blocks.columns if c.startswith("c")])
    shape = blocks.schema

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            first, last = (frame["block"] == 0).astype(int).tolist(), (frame["block"] == frame["blocks"] - 1).astype(int).tolist()
            out = {}
            for c in ["t", *[f"c{i}" for i in range(wide)]]:
                found = []
                for x, head, tail in zip(frame[c], first, last, strict=True):
                    x = np.asarray(x, np.float64)
                    if on:
                        before, behind = 2 * x[0] - x[PAD:0:-1], 2 * x[-1] - x[-2 : -PAD - 2 : -1]
                        x = np.concatenate([*[before] * head, x, *[behind] * tail])
                    else:
                        x = x[PAD * head : len(x) - PAD * tail]
                    found.append(x)
                out[c] = found
            yield frame.assign(**out)

    return (blocks.where((F.col("blocks") > 1) | (F.size("t") > PAD)) if on else blocks).mapInPandas(ends, shape)


def _zero_phase(s: Signal, system: System, block: int) -> DataFrame:
    s.need("signal")
    if block <= PAD:
        raise ValueError(f"a block has more than {PAD} samples")
    forth = _pass(_turned(gathered(s, block), True), system, True)
    return _turned(_pass(forth, system, True, back=True), False)


def zero_phase(s: Signal, system: System, block: int = BLOCK) -> Signal:
    """Filtered forwards and backwards over whole recordings; those of ``PAD`` samples or fewer give no rows."""
    return replace(s, df=_samples(s, _zero_phase(s, system, block)))


def downsample(s: Signal, factor: int, block: int = BLOCK) -> Signal:
    """Every ``factor``-th sample behind a low-pass of eighth order without phase."""
    low = _zero_phase(s, chebyshev_lowpass(8, 0.05, 0.8 / factor), block)
    return replace(s, df=_samples(s, low, factor), fs=s.fs / factor)
