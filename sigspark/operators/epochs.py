"""Epochs: sliding windows, windows between markers, and windows after a matching marker.

An epoch is complete, and kept, if a sample later than its end exists in its recording. Bounds of recordings come
from a grouping that pre-aggregates, so that a long recording is no task's alone.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import Signal
from .joins import between, latest


def _bounds(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min("t").alias("__first"), F.max("t").alias("__last"))


def windows_of(t: Column, first: Column, duration: float, interval: float) -> Column:
    """The numbers k of the windows [first + k * interval, ... + duration) that hold ``t``; an empty array without any."""
    high = F.floor((t - first) / interval)
    low = F.greatest(F.floor((t - first - duration) / interval) + 1, F.lit(0))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def time_epochs(s: Signal, duration: float, interval: float) -> Signal:
    """Sliding windows from each recording's first sample, or within each epoch from the epoch's first sample.

    Epochs of epochs are numbered epoch by epoch: ``parent`` keeps the outer number.
    """
    s.need("signal", "epoch")
    by = ["rec"] if s.kind == "signal" else ["rec", "epoch_id"]
    df = s.df.join(_bounds(s.df, by), by)
    df = df.withColumn("__k", F.explode(windows_of(F.col("t"), F.col("__first"), duration, interval)))
    start = F.col("__first") + F.col("__k") * interval
    df = df.where(start + duration < F.col("__last"))
    label = F.col("label") if s.kind == "epoch" else F.lit(None).cast("string")
    parent = [F.col("epoch_id").alias("parent")] if s.kind == "epoch" else []
    df = df.select("rec", F.col("__k").alias("epoch_id"), start.alias("epoch_start"), (start + duration).alias("epoch_end"), label.alias("label"), *parent, "seq", "t", *s.channels)
    return replace(s, df=df, kind="epoch", epoch_fs=1 / interval)


def marker_epochs(s: Signal, markers: DataFrame, width: float) -> Signal:
    """Windows from marker to marker, labelled by the marker that opens them; the first is ``first epoch``.

    Of markers at one time the first counts. ``width``: the block of time that a task sorts.
    """
    s.need("signal")
    first = markers.groupBy("rec", "t").agg(F.min_by("marker", "mseq").alias("marker"))
    by_time = Window.partitionBy("rec").orderBy("t")
    numbered = first.select("rec", "t", F.row_number().over(by_time).cast("bigint").alias("number"), "marker", F.lead("t").over(by_time).alias("until"))
    opening = first.groupBy("rec").agg(F.min("t").alias("__opening"))
    df = latest(s.df, numbered, width, "__mark").join(_bounds(s.df, ["rec"]), "rec").join(opening, "rec")
    mark = F.col("__mark")
    end = F.when(mark.isNull(), F.col("__opening")).otherwise(mark["until"])
    df = df.where(end < F.col("__last"))
    df = df.select(
        "rec",
        F.coalesce(mark["number"], F.lit(0)).alias("epoch_id"),
        F.coalesce(mark["t"], F.col("__first")).alias("epoch_start"),
        end.alias("epoch_end"),
        F.coalesce(mark["marker"], F.lit("first epoch")).alias("label"),
        "seq",
        "t",
        *s.channels,
    )
    return replace(s, df=df, kind="epoch", epoch_fs=0.0)


def stimulation_epochs(s: Signal, markers: DataFrame, stimulation, offset: float, duration: float) -> Signal:
    """Windows of ``duration`` that begin ``offset`` after each marker that equals ``stimulation`` (or is one of them)."""
    s.need("signal")
    wanted = [str(x) for x in (stimulation if isinstance(stimulation, (list, tuple, set)) else [stimulation])]
    begin = F.col("t") + offset
    spans = markers.where(F.col("marker").isin(wanted)).select("rec", F.col("mseq").alias("epoch_id"), begin.alias("begin"), (begin + duration).alias("end"), F.col("marker").alias("label"))
    spans = spans.join(_bounds(s.df, ["rec"]), "rec").where(F.col("end") < F.col("__last")).drop("__first", "__last")
    df = between(s.df, spans, duration)
    df = df.select("rec", "epoch_id", F.col("begin").alias("epoch_start"), F.col("end").alias("epoch_end"), "label", "seq", "t", *s.channels)
    return replace(s, df=df, kind="epoch", epoch_fs=0.0)
