"""Signals and markers from tables, and the driver's tables as such."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import BLOCK, numbered
from ..spec import Signal


def from_table(df: DataFrame, rec: str, time: str, channels: list[str], fs: float = 0.0, order: list[str] | None = None, block: int = BLOCK) -> Signal:
    """A table as a signal: samples numbered by time (and ``order``) within each recording, in parts of some ``block`` rows."""
    order = order or []
    rows = df.select(F.col(rec).alias("rec"), F.col(time).cast("double").alias("t"), *[F.col(c).alias(f"__order{i}") for i, c in enumerate(order)], *[F.col(c).cast("double").alias(c) for c in channels])
    rows = numbered(rows, "rec", "t", [f"__order{i}" for i in range(len(order))], block)
    return Signal(rows.select("rec", "seq", "t", *channels), tuple(channels), fs)


def shift_clock(s: Signal, offset: float) -> Signal:
    """Times moved by a clock's offset."""
    from dataclasses import replace

    return replace(s, df=s.df.withColumn("t", F.col("t") + offset))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select("event_id", F.col("user_id").alias("rec"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_type", "value")


def event_signal(spark: SparkSession, sf_dir: str) -> Signal:
    """``value`` of each user's events over time."""
    return from_table(events(spark, sf_dir), "rec", "t", ["value"], 250.0, ["event_id"])


def event_markers(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    rows = events(spark, sf_dir)
    rows = rows.where(F.col("event_type") == kind) if kind else rows
    return rows.select("rec", F.col("event_id").alias("mseq"), "t", F.col("event_type").alias("marker"))


def item_signal(spark: SparkSession, sf_dir: str) -> Signal:
    """Four channels of the order lines."""
    names = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    df = df.select(F.col("l_orderkey").alias("rec"), F.col("l_linenumber").cast("bigint").alias("seq"), F.col("l_partkey").cast("double").alias("t"), *[F.col(c).cast("double").alias(n) for n, c in names.items()])
    return Signal(df, tuple(names), 250.0)


def vector_epochs(spark: SparkSession, sf_dir: str) -> Signal:
    """Every embedding as an epoch of 64 samples."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    df = df.select(F.col("label").cast("bigint").alias("rec"), F.col("vec_id").alias("epoch_id"), F.posexplode("embedding").alias("seq", "x"))
    df = df.select("rec", "epoch_id", F.col("seq").cast("bigint").alias("seq"), (F.col("seq") / 64.0).alias("t"), F.col("x").cast("double").alias("x"))
    return Signal(df, ("x",), 64.0, "epoch")


def vector_signal(spark: SparkSession, sf_dir: str, channels: int = 64) -> Signal:
    """The embeddings' values as channels, by vector number, one recording a label."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    names = tuple(f"e{i}" for i in range(channels))
    df = df.select(F.col("label").cast("bigint").alias("rec"), F.col("vec_id").alias("seq"), (F.col("vec_id") / 250.0).alias("t"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return Signal(df, names, 250.0)
