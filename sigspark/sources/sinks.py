"""Where streams go: separated text, tables by key, and text over a network. Each works on batches and on streams."""

from __future__ import annotations

import os
import socket
import struct
import uuid
from collections.abc import Callable
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..spec import Signal


def _numbers_as_text(s: Signal, decimal: str) -> DataFrame:
    def shown(name: str) -> Column:
        text = F.col(f"`{name}`").cast("string")
        return (F.replace(text, F.lit("."), F.lit(decimal)) if decimal != "." else text).alias(name)

    kinds = dict(s.df.dtypes)
    return s.df.select(*[shown(c) if kinds[c] == "double" else F.col(f"`{c}`") for c in (*s.keys, *s.channels)])


def write_csv(s: Signal, path: str, sep: str = ";", decimal: str = ",", mode: str = "overwrite", checkpoint: str | None = None) -> StreamingQuery | None:
    """A folder of separated text with a header, one file a task. A stream needs ``checkpoint``, and its query is returned."""
    df = _numbers_as_text(s, decimal)
    if df.isStreaming:
        return df.writeStream.format("csv").option("sep", sep).option("header", True).option("checkpointLocation", checkpoint).outputMode("append").start(path)
    df.write.mode(mode).csv(path, sep=sep, header=True)
    return None


def read_csv(spark: SparkSession, path: str, channels: list[str], fs: float = 0.0, sep: str = ";", decimal: str = ",") -> Signal:
    """What ``write_csv`` wrote for a signal."""
    schema = ", ".join(["rec string", "seq bigint", "t string", *[f"`{c}` string" for c in channels]])
    df = spark.read.csv(path, schema=schema, sep=sep, header=True)
    number = lambda c: F.replace(F.col(f"`{c}`"), F.lit(decimal), F.lit(".")).cast("double").alias(c)
    return Signal(df.select("rec", "seq", *map(number, ("t", *channels))), tuple(channels), fs)


def write_table(s: Signal, folder: str, key: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery | None:
    """Columnar files under ``folder``/``key``; several streams share a folder by keys of their own."""
    if s.df.isStreaming:
        return s.df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(f"{folder}/{key}")
    s.df.write.mode(mode).parquet(f"{folder}/{key}")
    return None


def lines_of(s: Signal, sep: str = " ") -> DataFrame:
    """(line) one text a row: its channels."""
    return s.df.select(F.concat_ws(sep, *[F.coalesce(v.cast("string"), F.lit("NaN")) for v in s.values().values()]).alias("line"))


def frames_of(s: Signal) -> DataFrame:
    """(line) the bytes of a row for a serial line: 0, then a byte for each channel. Values other than 0 to 255 are an error."""
    wrong = F.raise_error(F.lit("a serial line takes whole numbers from 0 to 255")).cast("string")
    byte = lambda v: F.when((v >= 0) & (v <= 255) & (v == F.floor(v)), F.lpad(F.hex(v.cast("bigint")), 2, "0")).otherwise(wrong)
    return s.df.select(F.unhex(F.concat(F.lit("00"), *[byte(v) for v in s.values().values()])).alias("line"))


def datagrams(host: str, port: int) -> Callable[[], Callable[[bytes], None]]:
    """Opens a sender of datagrams; called once in each task."""

    def connect() -> Callable[[bytes], None]:
        out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        return lambda message: out.sendto(message, (host, port))

    return connect


class _Sender:
    """Sends lines from the task that holds them."""

    def __init__(self, connect: Callable[[], Callable[[bytes], None]]):
        self.connect = connect

    def open(self, partition_id: int, epoch_id: int) -> bool:
        self.send = self.connect()
        return True

    def process(self, row) -> None:
        self.send(row["line"].encode() if isinstance(row["line"], str) else bytes(row["line"]))


def send(s: Signal, connect: Callable[[], Callable[[bytes], None]], checkpoint: str | None = None, message: Callable[[Signal], DataFrame] = lines_of) -> StreamingQuery | None:
    """Each row as a ``message`` (text of its channels, or ``frames_of``) to the transport that ``connect`` opens
    (``datagrams``, or a caller's own for a serial line or a laboratory network). A task that is run again sends its
    rows again."""
    df, sender = message(s), _Sender(connect)
    if df.isStreaming:
        return df.writeStream.foreach(sender).option("checkpointLocation", checkpoint).start()

    def each(rows) -> None:
        sender.open(0, 0)
        for row in rows:
            sender.process(row)

    df.foreachPartition(each)
    return None


def _mat_element(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def _mat_variable(name: str, values: np.ndarray) -> bytes:
    """One named matrix, of doubles or of characters."""
    text = values.dtype.kind == "U"
    flags = _mat_element(6, struct.pack("<II", 4 if text else 6, 0))
    shape = _mat_element(5, struct.pack("<2i", *values.shape))
    data = _mat_element(4, np.frompyfunc(ord, 1, 1)(values).astype("<u2").tobytes("F")) if text else _mat_element(9, values.astype("<f8").tobytes("F"))
    return _mat_element(14, flags + shape + _mat_element(1, name.encode()) + data)


def mat_files(s: Signal, rows: int = 1 << 20) -> DataFrame:
    """(rec, part, content) files of the numeric format of level 5 with ``timestamps``, ``values`` and ``channels``, one for
    every ``rows`` samples of a recording, so that no task or file has to hold a recording."""
    s.need("signal")
    names, rec = list(s.channels), s.df.schema["rec"].dataType.simpleString()
    width = max(map(len, names))
    letters = np.array([list(n.ljust(width)) for n in names])

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H2s", 0x0100, b"IM")
        parts = {"timestamps": frame["t"].to_numpy(np.float64)[None], "values": frame[names].to_numpy(np.float64), "channels": letters}
        return pd.DataFrame({"rec": [key[0]], "part": [key[1]], "content": [head + b"".join(_mat_variable(n, v) for n, v in parts.items())]})

    return s.df.withColumn("part", F.floor(F.col("seq") / rows)).groupBy("rec", "part").applyInPandas(pack, f"rec {rec}, part bigint, content binary")


def write_mat(s: Signal, folder: str, rows: int = 1 << 20) -> None:
    """``mat_files`` as files ``<rec>-<part>.mat`` in a folder that all executors share; a task that runs again replaces its files."""

    def write(found) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in found:
            name = f"{folder}/{quote(str(row['rec']), safe='')}-{row['part']}.mat"
            with open(f"{name}.{uuid.uuid4().hex}", "wb") as f:
                f.write(row["content"])
            os.replace(f.name, name)

    mat_files(s, rows).foreachPartition(write)
