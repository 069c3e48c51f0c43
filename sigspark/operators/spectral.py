"""Spectra of epochs: each epoch's samples are gathered into an array, and a batch of epochs is transformed at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import Signal


def _gathered(s: Signal) -> DataFrame:
    """(rec, epoch_id, channel, x: the samples in order) of every epoch, one of bounded size."""
    samples = F.array_sort(F.collect_list(F.struct("seq", *[F.col(f"`{c}`") for c in s.channels])))
    df = s.df.groupBy("rec", "epoch_id").agg(samples.alias("samples"))
    each = F.array(*[F.struct(F.lit(c).alias("channel"), F.col("samples").getField(c).cast("array<double>").alias("x")) for c in s.channels])
    return df.select("rec", "epoch_id", F.explode(each).alias("e")).select("rec", "epoch_id", "e.channel", "e.x")


def _by_length(arrays: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and stacked samples of the epochs of each length in a batch."""
    sizes = arrays.map(len).to_numpy()
    for n in np.unique(sizes):
        places = np.flatnonzero(sizes == n)
        yield places, np.array([np.asarray(arrays.iloc[p], np.float64) for p in places])


def _spectrum(s: Signal, lines: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Signal:
    """``lines``: frequencies and values of stacked epochs, a row an epoch."""
    s.need("epoch")

    @F.pandas_udf("array<struct<freq:double,value:double>>")
    def of(arrays: pd.Series) -> pd.Series:
        out = np.empty(len(arrays), object)
        for places, x in _by_length(arrays):
            freq, values = lines(x)
            for p, row in zip(places, values, strict=True):
                out[p] = [{"freq": f, "value": v} for f, v in zip(freq.tolist(), row.tolist(), strict=True)]
        return pd.Series(out)

    df = _gathered(s).select("rec", "epoch_id", "channel", F.explode(of("x")).alias("l"))
    return replace(s, df=df.select("rec", F.col("epoch_id").cast("bigint").alias("epoch_id"), "channel", "l.freq", "l.value"), kind="spectrum")


def fft_amplitude(s: Signal, true_freq: bool = False) -> Signal:
    """2/n * |DFT| of the lower half. The frequency axis runs evenly from 0 to fs/2 unless ``true_freq``."""
    fs = s.fs

    def lines(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = x.shape[1]
        freq = np.arange(n // 2) * fs / n if true_freq else np.linspace(0, fs / 2, n // 2)
        return freq, 2 / n * np.abs(np.fft.fft(x, axis=1)[:, : n // 2])

    return _spectrum(s, lines)


def welch_psd(s: Signal) -> Signal:
    """Power density of one Hann segment as long as the epoch, without its mean, one-sided."""
    fs = s.fs

    def lines(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = x.shape[1]
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        power = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * w, axis=1)) ** 2 / (fs * (w**2).sum())
        power[:, 1 : (n + 1) // 2] *= 2
        return np.fft.rfftfreq(n, 1 / fs), power

    return _spectrum(s, lines)


def envelope(x: np.ndarray, axis: int) -> np.ndarray:
    """The size of the analytic signal."""
    n = x.shape[axis]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    shape = [1, 1]
    shape[axis] = n
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=axis) * gain.reshape(shape), axis=axis))


def hilbert(s: Signal, axis: str = "channel") -> Signal:
    """The envelope across each row's channels, or along each epoch's time."""
    channels = list(s.channels)
    df = s.df.select(*s.keys, *channels)
    if axis == "channel":

        def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    frame[channels] = envelope(frame[channels].to_numpy(np.float64), 1)
                yield frame

        return replace(s, df=df.mapInPandas(rows, df.schema))
    s.need("epoch")

    def epoch(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        frame[channels] = envelope(frame[channels].to_numpy(np.float64), 0)
        return frame

    return replace(s, df=df.groupBy("rec", "epoch_id").applyInPandas(epoch, df.schema))


def latest_spectrum(s: Signal) -> Signal:
    """The spectrum of each recording's last epoch."""
    s.need("spectrum")
    last = s.df.groupBy("rec").agg(F.max("epoch_id").alias("epoch_id"))
    return replace(s, df=s.df.join(last, ["rec", "epoch_id"]).select(*s.df.columns))
