"""Messages of a remote data access stream, one a row, as a signal and its markers.

A collector lands messages in a table or topic as (rec, message: bytes with their head); decoding is spread over the
cluster, batch or stream. Samples are numbered by the blocks before them, one row a block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import Signal

#: Fixed values of the format: id, size with this head, type; types of messages.
HEAD, HEAD_SIZE = "<16sLL", 24
START, DATA = 1, 4
DECODED = "rec string, block bigint, points bigint, samples array<double>, markers array<struct<position:bigint,marker:string>>"


@dataclass(frozen=True)
class Start:
    fs: float
    names: tuple[str, ...]
    resolutions: tuple[float, ...]


def split_messages(raw: bytes) -> tuple[list[bytes], bytes]:
    """The whole messages at the start of ``raw``, and what is left."""
    out, at = [], 0
    while len(raw) - at >= HEAD_SIZE and len(raw) - at >= (size := struct.unpack_from(HEAD, raw, at)[1]) >= HEAD_SIZE:
        out.append(raw[at : at + size])
        at += size
    return out, raw[at:]


def start_of(message: bytes) -> Start:
    """Channels and rate; channels without names are Ch1, Ch2, ..."""
    if struct.unpack_from(HEAD, message)[2] != START:
        raise ValueError("not a start message")
    n, interval = struct.unpack_from("<Ld", message, HEAD_SIZE)
    at = HEAD_SIZE + 12
    names = [x.decode() for x in message[at + 8 * n :].split(b"\0") if x]
    return Start(1e6 / interval, tuple(names or (f"Ch{i + 1}" for i in range(n))), struct.unpack_from(f"<{n}d", message, at))


def data_of(message: bytes, channels: int, text_share: int = 1) -> tuple[int, int, np.ndarray, list[tuple[int, str]]]:
    """(block, points, samples flat by point, markers) of a data message.

    ``text_share``: 2 where a marker's size counts its text twice, as the viewer's port does.
    """
    block, points, marks = struct.unpack_from("<LLL", message, HEAD_SIZE)
    at = HEAD_SIZE + 12
    samples = np.frombuffer(message, "<f4", points * channels, at).astype(np.float64)
    at, found = at + 4 * points * channels, []
    for _ in range(marks):
        size, position = struct.unpack_from("<LL", message, at)
        size = (size - 16) // text_share + 16
        parts = message[at + 16 : at + size].split(b"\0")
        found.append((position, (parts[1] if len(parts) > 1 else parts[0]).decode()))
        at += size
    return block, points, samples, found


def decode(messages: DataFrame, start: Start, text_share: int = 1) -> DataFrame:
    """One row for each data message of (rec, message); other messages, and null ones, give none."""
    channels = len(start.names)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for rec, message in zip(frame["rec"], frame["message"], strict=True):
                if message is not None and struct.unpack_from(HEAD, message)[2] == DATA:
                    block, points, samples, marks = data_of(bytes(message), channels, text_share)
                    out.append((rec, block, points, samples, [{"position": p, "marker": m} for p, m in marks]))
            yield pd.DataFrame(out, columns=["rec", "block", "points", "samples", "markers"])

    return messages.select(F.col("rec").cast("string").alias("rec"), "message").mapInPandas(rows, DECODED)


def read_rda(messages: DataFrame, start: Start, offset: float = 0.0, text_share: int = 1) -> tuple[Signal, DataFrame]:
    """The signal and its markers; times begin at ``-offset``, and lost blocks leave no gap in them."""
    before = Window.partitionBy("rec").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = decode(messages, start, text_share)
    # The sum runs over one small row a block; samples themselves are joined to it, not sorted.
    begins = blocks.select("rec", "block", "points").select("rec", "block", F.coalesce(F.sum("points").over(before), F.lit(0)).alias("begin"))
    placed = blocks.join(begins, ["rec", "block"])
    n = len(start.names)
    points = F.transform(F.sequence(F.lit(0), F.col("points").cast("int") - 1), lambda i: F.slice("samples", i * n + 1, F.lit(n)))
    rows = placed.where("points > 0").select("rec", "begin", F.posexplode(points).alias("i", "x"))
    seq = (F.col("begin") + F.col("i")).alias("seq")
    df = rows.select("rec", seq, (seq / start.fs - offset).alias("t"), *[F.col("x")[c].alias(name) for c, name in enumerate(start.names)])
    marks = placed.select("rec", "begin", "block", F.posexplode("markers").alias("i", "m"))
    by_time = Window.partitionBy("rec").orderBy("block", "i")
    t = (F.col("begin") + F.col("m.position") + 1) / start.fs - offset
    return Signal(df, start.names, start.fs), marks.select("rec", (F.row_number().over(by_time) - 1).cast("bigint").alias("mseq"), t.alias("t"), F.col("m.marker").alias("marker"))
