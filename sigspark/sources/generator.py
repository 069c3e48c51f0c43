"""Synthetic signals, as column expressions over any rows that have numbers and times: a range, a table, or a stream.

Drawn values come from hashes of the sample's number, so that a sample is the same whenever and wherever it is made.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import Signal


def uniform(seed: int) -> Column:
    """Between 0 and 1, by the sample's number."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("seq")), F.lit(1 << 53)) / float(1 << 53)


def values_of(kind: str, channels: int, seed: int = 1) -> dict[str, Column]:
    """``random``: uniform in [-10, 10); ``oscillator``: sin(2 pi (5+i) t) (5 + 5/(i+1)) for channel i from 0;
    ``simulation``: one to four waves, a baseline and noise for each channel, drawn from ``seed``."""
    rng = np.random.default_rng(seed)

    def channel(i: int) -> Column:
        if kind == "random":
            return uniform(seed + i) * 20 - 10
        if kind == "oscillator":
            return F.sin(2 * math.pi * (5 + i) * F.col("t")) * (5 + 5 / (i + 1))
        if kind == "simulation":
            waves = [(rng.triangular(0, 15, 45), rng.triangular(10, 20, 30)) for _ in range(rng.integers(1, 5))]
            base = F.lit(float(rng.normal(0, 1e4)))
            return sum((F.sin(2 * math.pi * float(f) * F.col("t")) * float(a) for f, a in waves), base) + uniform(seed + i) * 20
        raise ValueError("kind is random, oscillator or simulation")

    return {f"Ch{i + 1}": channel(i) for i in range(channels)}


def _signal(df: DataFrame, kind: str, channels: int, fs: float, seed: int, *more: str) -> Signal:
    values = values_of(kind, channels, seed)
    return Signal(df.select("rec", "seq", "t", *more, *[v.alias(n) for n, v in values.items()]), tuple(values), fs)


def generate(spark: SparkSession, kind: str, channels: int, fs: float, rows: int, start: float = 0.0, seed: int = 1) -> Signal:
    """``rows`` samples of one recording; the first lies a period after ``start``."""
    df = spark.range(rows).select(F.lit("generator").alias("rec"), F.col("id").alias("seq"))
    return _signal(df.withColumn("t", start + (F.col("seq") + 1) / fs), kind, channels, fs, seed)


def on_times(s: Signal, kind: str, channels: int, seed: int = 1) -> Signal:
    """Generated channels at the samples of a signal, in place of its own."""
    s.need("signal")
    return replace(s.project(values_of(kind, channels, seed)), fs=s.fs)


def stream(spark: SparkSession, kind: str, channels: int, fs: float, start: float = 0.0, seed: int = 1, per_batch: int | None = None, tasks: int = 1) -> Signal:
    """An endless recording: ``fs`` samples a second as time passes, or ``per_batch`` a batch. A sample's values are those that
    ``generate`` gives it, also after a restart from a checkpoint."""
    source = spark.readStream.format("rate-micro-batch" if per_batch else "rate").option("numPartitions", tasks)
    source = source.option("rowsPerBatch", per_batch) if per_batch else source.option("rowsPerSecond", round(fs))
    df = source.load().select(F.lit("generator").alias("rec"), F.col("value").alias("seq")).withColumn("t", start + (F.col("seq") + 1) / fs)
    return _signal(df.withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("bigint"))), kind, channels, fs, seed, "ts")
