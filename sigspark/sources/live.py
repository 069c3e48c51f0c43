"""Sources of streams: a socket of remote data access, and recordings played again.

Both are data sources of Spark's own interface for Python. A reader on the driver hands out small rows (messages as they
came, or ranges of samples) with offsets that Spark keeps in the checkpoint; decoding and reading of samples are spread
over the cluster.

A socket can't be asked again for what it sent. So messages are written to a spool folder, which has to be one that a
restarted driver reaches, before their offset is given out; a batch that is run again reads the spool, and files are
removed once Spark has committed their batch. Offsets hold what the next message needs: how many messages and samples came
before, the last block, and the clock. Whole messages are handed out; a frame that has come in part is kept for later.
"""

from __future__ import annotations

import json
import os
import select
import socket
import struct
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..spec import Signal
from . import brainvision
from .rda import DATA, HEAD, HEAD_SIZE, START, Start, data_of, split_messages, start_of

MESSAGES = "rec string, nth bigint, begin bigint, clock double, message binary"
RANGES = "rec string, begin bigint, points bigint"
PLACE = "<qqdI"


class Spool:
    """Batches of messages in a folder, one file each, named by their first message's number."""

    def __init__(self, place: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(place if "://" in place else "file://" + os.path.abspath(place))
        self.fs.create_dir(self.root, recursive=True)
        self.kind = fs.FileType.File

    def files(self) -> list[tuple[int, str]]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.root))
        return sorted((int(f.base_name.split(".")[0]), f.path) for f in found if f.type == self.kind and f.base_name.endswith(".messages"))

    def put(self, first: int, end: dict, rows: list[tuple]) -> None:
        raw = json.dumps(end).encode()
        body = b"".join(struct.pack(PLACE, nth, begin, clock, len(m)) + m for nth, begin, clock, m in rows)
        path = f"{self.root}/{first:020d}.messages"
        with self.fs.open_output_stream(path + ".part") as out:
            out.write(struct.pack("<I", len(raw)) + raw + body)
        self.fs.move(path + ".part", path)

    def get(self, path: str) -> tuple[dict, list[tuple]]:
        with self.fs.open_input_stream(path) as f:
            raw = f.read()
        at = 4 + struct.unpack_from("<I", raw)[0]
        end, rows = json.loads(raw[4:at]), []
        while at < len(raw):
            nth, begin, clock, n = struct.unpack_from(PLACE, raw, at)
            at += struct.calcsize(PLACE)
            rows.append((nth, begin, clock, raw[at : at + n]))
            at += n
        return end, rows

    def drop_before(self, nth: int) -> None:
        for first, path in self.files():
            if first < nth and self.get(path)[0]["messages"] <= nth:
                self.fs.delete_file(path)


class Connection:
    """A socket that gives whole messages; the first one it hears has to tell of channels and rate."""

    def __init__(self, host: str, port: int, timeout: float):
        until = time.time() + timeout
        while True:
            try:
                self.socket = socket.create_connection((host, port), timeout=max(0.1, until - time.time()))
                break
            except OSError:
                if time.time() > until:
                    raise
                time.sleep(0.05)
        self.pending, self.closed, self.start = b"", False, None
        while self.start is None:
            for raw in self.messages(0.1):
                if struct.unpack_from(HEAD, raw)[2] == START:
                    self.start = start_of(raw)
            if self.start is None and (self.closed or time.time() > until):
                raise TimeoutError(f"{host}:{port} sent no start message")

    def messages(self, wait: float, most: int = 1 << 22) -> list[bytes]:
        """What has come within ``wait`` seconds, up to some ``most`` bytes."""
        until, size = time.time() + wait, 0
        while not self.closed and size < most and select.select([self.socket], [], [], max(0.0, until - time.time()))[0]:
            got = self.socket.recv(1 << 16)
            self.closed = not got
            self.pending += got
            size += len(got)
        found, self.pending = split_messages(self.pending)
        held, self.early = getattr(self, "early", []), []
        if self.start is None:  # data behind the start message belongs to the first batch
            at = next((i for i, m in enumerate(found) if struct.unpack_from(HEAD, m)[2] == START), len(found))
            self.early = found[at + 1 :]
            return found[: at + 1]
        return held + found


class RdaReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.spool, self.connection = options, Spool(options["spool"]), None
        self.rec, self.wait = options.get("rec", "live"), float(options.get("wait", 0.2))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"messages": 0, "samples": 0, "block": -1, "clock": None}

    def _connected(self) -> Connection | None:
        if self.connection is None or self.connection.closed:
            timeout = float(self.options.get("timeout", 10)) if self.connection is None else self.wait
            try:
                self.connection = Connection(self.options.get("host", "localhost"), int(self.options["port"]), timeout)
            except OSError:
                if self.connection is None:
                    raise
                return None
        return self.connection

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        for first, path in self.spool.files():
            if first == start["messages"]:  # received before a failure, but never handed out
                end, rows = self.spool.get(path)
                return iter([(self.rec, *r) for r in rows]), end
        link = self._connected()
        if link is None:
            return iter([]), start
        at, rows = dict(start), []
        for message in link.messages(self.wait):
            if struct.unpack_from(HEAD, message)[2] != DATA:
                continue
            block, points = struct.unpack_from("<LL", message, HEAD_SIZE)
            span = points / link.start.fs
            # A block that doesn't follow the last one resets the clock to the time of its arrival.
            if at["clock"] is None or block != at["block"] + 1:
                at["clock"] = time.time() - span
            rows.append((at["messages"], at["samples"], at["clock"], message))
            at = {"messages": at["messages"] + 1, "samples": at["samples"] + points, "block": block, "clock": at["clock"] + span}
        if rows:
            self.spool.put(start["messages"], at, rows)
        return iter([(self.rec, *r) for r in rows]), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for first, path in self.spool.files():
            if start["messages"] <= first < end["messages"]:
                yield from ((self.rec, *r) for r in self.spool.get(path)[1])

    def commit(self, end: dict) -> None:
        self.spool.drop_before(end["messages"])


class RdaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rda"

    def schema(self) -> str:
        return MESSAGES

    def simpleStreamReader(self, schema) -> RdaReader:  # noqa: N802
        return RdaReader(self.options)


def rda_messages(spark: SparkSession, port: int, spool: str, host: str = "localhost", rec: str = "live", timeout: float = 10.0, wait: float = 0.2) -> DataFrame:
    """A stream of data messages: (rec, nth: number from 0, begin: samples before it, clock: time of its first sample in
    seconds since 1970, message)."""
    spark.dataSource.register(RdaSource)
    options = {"port": str(port), "host": host, "spool": spool, "rec": rec, "timeout": str(timeout), "wait": str(wait)}
    return spark.readStream.format("rda").options(**options).load()


def announced(port: int, host: str = "localhost", timeout: float = 10.0) -> Start:
    """Channels and rate, by a connection of its own."""
    link = Connection(host, port, timeout)
    link.socket.close()
    return link.start


def rda_signal(messages: DataFrame, start: Start, offset: float = 0.0, text_share: int = 1) -> tuple[Signal, DataFrame]:
    """The signal (rec, seq, t, ts, channels) and the markers (rec, mseq, t, ts, marker) of ``rda_messages``.

    ``t`` are seconds since 1970 less ``offset``; without lost blocks they differ from those of ``rda.read_rda`` by one
    constant. ``mseq`` rises along the stream, with gaps.
    """
    names, channels = start.names, len(start.names)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for rec, nth, begin, clock, message in frame[["rec", "nth", "begin", "clock", "message"]].itertuples(index=False):
                _, points, samples, marks = data_of(bytes(message), channels, text_share)
                out.append((rec, nth, begin, clock, points, samples, [{"position": p, "marker": m} for p, m in marks]))
            yield pd.DataFrame(out, columns=["rec", "nth", "begin", "clock", "points", "samples", "markers"])

    decoded = messages.mapInPandas(rows, "rec string, nth bigint, begin bigint, clock double, points bigint, samples array<double>, markers array<struct<position:bigint,marker:string>>")
    at = lambda i: (F.col("clock") + i / start.fs - offset).alias("t")
    stamped = F.timestamp_micros(F.round(F.col("t") * 1e6).cast("bigint")).alias("ts")
    points = F.transform(F.sequence(F.lit(0), F.col("points").cast("int") - 1), lambda i: F.slice("samples", i * channels + 1, F.lit(channels)))
    samples = decoded.where("points > 0").select("rec", "begin", "clock", F.posexplode(points).alias("i", "x"))
    df = samples.select("rec", (F.col("begin") + F.col("i")).alias("seq"), at(F.col("i")), *[F.col("x")[c].alias(n) for c, n in enumerate(names)])
    marks = decoded.select("rec", "nth", "clock", F.posexplode("markers").alias("i", "m"))
    marks = marks.select("rec", (F.shiftleft("nth", 16) + F.col("i")).alias("mseq"), at(F.col("m.position") + 1), F.col("m.marker").alias("marker"))
    return Signal(df.select("rec", "seq", "t", stamped, *names), names, start.fs), marks.select("rec", "mseq", "t", stamped, "marker")


class ReplayReader(SimpleDataSourceStreamReader):
    """Ranges of a recording's samples: ``chunk`` samples a batch, or with a ``speed`` what its time has come for."""

    def __init__(self, options: dict):
        self.head = brainvision.read_header(options["path"])
        self.total, self.rec = brainvision.length_of(self.head), options["rec"]
        self.chunk, self.block, self.speed = int(options["chunk"]), int(options["block"]), float(options["speed"])
        self.began: tuple[float, int] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"sample": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = start["sample"] + self.chunk
        if self.speed > 0:
            self.began = self.began or (time.time(), start["sample"])
            end = self.began[1] + int((time.time() - self.began[0]) * self.speed * self.head.fs)
        end = {"sample": max(start["sample"], min(end, self.total))}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        a, b = start["sample"], end["sample"]
        return iter([(self.rec, i, min(self.block, b - i)) for i in range(a, b, self.block)])


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording_replay"

    def schema(self) -> str:
        return RANGES

    def simpleStreamReader(self, schema) -> ReplayReader:  # noqa: N802
        return ReplayReader(self.options)


def replay(spark: SparkSession, path: str, chunk: int, rec: str | None = None, speed: float = 0.0, block: int = 65_536, tasks: int = 1) -> tuple[Signal, DataFrame]:
    """A recording with a .vhdr header as a stream: its signal and its markers, each marker with the batch of its sample.

    Without ``speed`` every batch holds ``chunk`` samples; with it, samples come as time passes, ``speed`` times as fast as
    they were recorded. The offset is the number of samples handed out. A batch's samples are read by ``tasks`` tasks,
    ``block`` at a time; the file has to be one that executors reach.
    """
    spark.dataSource.register(ReplaySource)
    head, name = brainvision.read_header(path), rec or os.path.splitext(os.path.basename(path))[0]
    options = {"path": path, "rec": name, "chunk": str(chunk), "block": str(block), "speed": str(speed)}
    wide, length = len(head.names), brainvision.length_of(head)

    def samples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin, n in zip(frame["begin"], frame["points"], strict=True):
                seq, values = np.arange(begin, begin + n), brainvision.samples_of(head, begin, n)
                yield pd.DataFrame({"rec": name, "seq": seq, "t": seq / head.fs} | {f"c{c}": values[:, c] for c in range(wide)})

    def marks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin, n in zip(frame["begin"], frame["points"], strict=True):
                # Markers behind the last sample come with it.
                upto = begin + n if begin + n < length else np.inf
                found = [(name, k, s / head.fs, m) for k, s, m in brainvision.marks_of(head) if begin <= s < upto]
                yield pd.DataFrame(found, columns=["rec", "mseq", "t", "marker"])

    def ranges() -> DataFrame:
        rows = spark.readStream.format("recording_replay").options(**options).load()
        return rows.repartition(tasks, "begin") if tasks > 1 else rows

    ts = F.timestamp_micros(F.round(F.col("t") * 1e6).cast("bigint")).alias("ts")
    df = ranges().mapInPandas(samples, ", ".join(["rec string", "seq bigint", "t double", *[f"c{c} double" for c in range(wide)]])).toDF("rec", "seq", "t", *head.names)
    markers = ranges().mapInPandas(marks, "rec string, mseq bigint, t double, marker string")
    return Signal(df.select("rec", "seq", "t", ts, *[F.col(f"`{n}`") for n in head.names]), head.names, head.fs), markers.select("rec", "mseq", "t", ts, "marker")
