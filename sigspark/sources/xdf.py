"""Recordings of several streams in chunks of varying length (.xdf).

One task a file walks over the chunks' heads and skips their bodies; that index is then dealt over the cluster, and each chunk
is read and decoded on its own. Samples without a stamp follow the one before them by the stream's period: what a chunk
needs from those before it is one row a chunk. Stamps of regular streams are smoothed by a line over each stretch
without a gap, and clock offsets are lines over each stretch without a jump; both are sums that pre-aggregate.
The folder has to be one that executors reach.
"""

from __future__ import annotations

import os
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import latest
from ..spec import Signal

#: Fixed values of the format: kinds of chunks, numbers by their names.
STREAM, SAMPLES, OFFSET = 2, 3, 4
NUMBERS = {"float32": "<f4", "double64": "<f8", "int8": "<i1", "int16": "<i2", "int32": "<i4", "int64": "<i8"}
INDEX = "rec string, path string, nth bigint, tag int, stream bigint, at bigint, size bigint"
DECODED = "rec string, stream bigint, nth bigint, n bigint, t array<double>, x array<double>, text array<string>"
#: A stretch ends where stamps leave a gap of so many seconds and samples; a clock's, where offsets jump or pause by so many seconds.
GAP_SECONDS, GAP_SAMPLES, JUMP, PAUSE = 1.0, 500, 1.0, 60.0


@dataclass(frozen=True)
class Stream:
    number: int
    name: str
    fs: float
    format: str
    channels: tuple[str, ...]


def variable_length(f) -> int:
    """A number behind the count of its bytes."""
    size = f.read(1)
    return int.from_bytes(f.read(size[0]), "little") if size else -1


def chunks(path: str) -> Iterator[tuple[int, int, int, int]]:
    """(tag, stream or -1, place of the body, its size) of a file's chunks, without reading bodies."""
    with open(path, "rb") as f:
        if f.read(4) != b"XDF:":
            raise ValueError(f"{path}: not a file of this format")
        while (length := variable_length(f)) >= 0:
            (tag,), at, stream = struct.unpack("<H", f.read(2)), f.tell(), -1
            if tag in (STREAM, SAMPLES, OFFSET, 6):
                (stream,), at = struct.unpack("<I", f.read(4)), at + 4
            size = length - 2 - 4 * (stream >= 0)
            yield tag, stream, at, size
            f.seek(at + size)


def index_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row for each chunk of each file."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                rec = os.path.splitext(os.path.basename(path))[0]
                found = [(rec, path, k, *c) for k, c in enumerate(chunks(path))]
                yield pd.DataFrame(found, columns=["rec", "path", "nth", "tag", "stream", "at", "size"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path").mapInPandas(rows, INDEX)


def body(path: str, at: int, size: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(at)
        return f.read(size)


def stream_of(number: int, raw: bytes) -> Stream:
    info = ET.fromstring(raw.decode("utf-8"))
    n = int(info.findtext("channel_count"))
    told = [c.findtext("label") for c in info.iterfind("desc/channels/channel")]
    names = told if len(told) == n and all(told) else [f"Ch{i + 1}" for i in range(n)]
    return Stream(number, info.findtext("name") or "", float(info.findtext("nominal_srate") or 0), info.findtext("channel_format"), tuple(names))


def streams(path: str) -> list[Stream]:
    """What a file's stream headers say."""
    return [stream_of(s, body(path, at, size)) for tag, s, at, size in chunks(path) if tag == STREAM]


def decoded(raw: bytes, s: Stream) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(stamps, NaN where there is none; values flat by sample; texts flat by sample) of a chunk of samples."""
    width = raw[0]
    n, at, wide = int.from_bytes(raw[1 : 1 + width], "little"), 1 + width, len(s.channels)
    t, x, text = np.full(n, np.nan), [], []
    number = NUMBERS.get(s.format)
    for i in range(n):
        if raw[at]:
            (t[i],) = struct.unpack_from("<d", raw, at + 1)
        at += 1 + raw[at]
        if number:
            size = np.dtype(number).itemsize * wide
            x.append(raw[at : at + size])
            at += size
        else:
            for _ in range(wide):
                size = raw[at]
                length = int.from_bytes(raw[at + 1 : at + 1 + size], "little")
                at += 1 + size
                text.append(raw[at : at + length].decode("utf-8", "replace"))
                at += length
    return t, np.frombuffer(b"".join(x), number or "<f8").astype(np.float64), text


def samples_of(index: DataFrame, known: list[Stream]) -> DataFrame:
    """(rec, stream, nth, begin: samples of the stream before the chunk, t, x, text): every chunk with all its stamps."""
    by_number = {s.number: s for s in known}
    given = lambda t: t.isNotNull() & ~F.isnan(t)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                t, x, text = decoded(body(r.path, r.at, r.size), by_number[r.stream])
                out.append((r.rec, r.stream, r.nth, len(t), t, x, text))
            yield pd.DataFrame(out, columns=["rec", "stream", "nth", "n", "t", "x", "text"])

    wanted = index.where((F.col("tag") == SAMPLES) & F.col("stream").isin(list(by_number)))
    parts = wanted.repartition("rec", "stream", "nth").mapInPandas(rows, DECODED)
    # The last stamp of a chunk, and how many samples follow it; a chunk without stamps adds to those of an earlier one.
    stamped = F.array_max(F.filter(F.transform("t", lambda t, i: F.when(given(t), F.struct(i.alias("i"), t.alias("t")))), lambda s: s.isNotNull()))
    whole = Window.partitionBy("rec", "stream").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    heads = parts.select("rec", "stream", "nth", "n", stamped.alias("s")).withColumn("begin", F.coalesce(F.sum("n").over(whole), F.lit(0)))
    before = F.last(F.when(F.col("s").isNotNull(), F.struct((F.col("begin") + F.col("s.i")).alias("place"), "s.t")), ignorenulls=True).over(whole)
    heads = heads.select("rec", "stream", "nth", "begin", before.alias("before"))
    period = F.create_map(*[F.lit(v) for s in known for v in (s.number, 1 / s.fs if s.fs else 0.0)])
    step = period[F.col("stream")]

    def next_stamp(done, t):
        last = F.element_at(done, -1)
        return F.concat(done, F.array(F.when(given(t), t).otherwise(last + step)))

    # Without any stamp before it a stream begins at 0.
    start = F.coalesce(F.col("before.t") + (F.col("begin") - 1 - F.col("before.place")) * step, -step)
    filled = F.slice(F.aggregate("t", F.array(start), next_stamp), 2, F.greatest(F.size("t"), F.lit(1)))
    return parts.join(heads, ["rec", "stream", "nth"]).select("rec", "stream", "nth", "begin", filled.alias("t"), "x", "text")


def smoothed(rows: DataFrame, fs: float) -> DataFrame:
    """``rows`` (rec, seq, t, ...) with stamps on a line over each stretch without a gap."""
    gap = max(GAP_SECONDS, GAP_SAMPLES / fs)
    block = F.floor(F.col("seq") / 65_536)
    in_order = Window.partitionBy("rec", "__block").orderBy("seq")
    rows = rows.withColumn("__block", block)
    ends = rows.groupBy("rec", "__block").agg(F.max_by("t", "seq").alias("__t"), F.min_by("t", "seq").alias("__first"))
    ends = ends.select("rec", "__block", F.lag("__t").over(Window.partitionBy("rec").orderBy("__block")).alias("__before"))
    rows = rows.join(ends, ["rec", "__block"]).withColumn("__broken", F.coalesce(F.col("t") - F.coalesce(F.lag("t").over(in_order), F.col("__before")) > gap, F.lit(False)).cast("int"))
    counts = rows.groupBy("rec", "__block").agg(F.sum("__broken").alias("__n"))
    earlier = Window.partitionBy("rec").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("rec", "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__begin"))
    rows = rows.join(counts, ["rec", "__block"]).withColumn("__stretch", F.col("__begin") + F.sum("__broken").over(in_order))
    # Sums about the stretch's middle keep their digits.
    middle = rows.groupBy("rec", "__stretch").agg(F.avg("seq").alias("__ms"), F.avg("t").alias("__mt"))
    rows = rows.join(middle, ["rec", "__stretch"])
    a, b = F.col("seq") - F.col("__ms"), F.col("t") - F.col("__mt")
    slope = rows.groupBy("rec", "__stretch").agg((F.sum(a * b) / F.nullif(F.sum(a * a), F.lit(0.0))).alias("__slope"))
    return rows.join(slope, ["rec", "__stretch"]).withColumn("t", F.col("__mt") + F.coalesce(F.col("__slope"), F.lit(0.0)) * a).drop("__block", "__before", "__broken", "__begin", "__stretch", "__ms", "__mt", "__slope")


def clock_lines(index: DataFrame) -> DataFrame:
    """(rec, stream, t: where it begins, at, level, slope): a line for each stretch of a stream's clock offsets."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(r.rec, r.stream, *struct.unpack("<dd", body(r.path, r.at, 16))) for r in frame.itertuples()]
            yield pd.DataFrame(found, columns=["rec", "stream", "t", "offset"])

    told = index.where(F.col("tag") == OFFSET).mapInPandas(rows, "rec string, stream bigint, t double, offset double")
    by_time = Window.partitionBy("rec", "stream").orderBy("t")  # one row every few seconds
    new = (F.abs(F.col("offset") - F.lag("offset").over(by_time)) > JUMP) | (F.col("t") - F.lag("t").over(by_time) > PAUSE)
    told = told.withColumn("new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("part", F.sum("new").over(by_time))
    told = told.withColumns({"mt": F.avg("t").over(Window.partitionBy("rec", "stream", "part")), "mo": F.avg("offset").over(Window.partitionBy("rec", "stream", "part"))})
    a, b = F.col("t") - F.col("mt"), F.col("offset") - F.col("mo")
    lines = told.groupBy("rec", "stream", "part").agg(F.min("t").alias("t"), F.first("mt").alias("at"), F.first("mo").alias("level"), F.coalesce(F.sum(a * b) / F.nullif(F.sum(a * a), F.lit(0.0)), F.lit(0.0)).alias("slope"))
    # The first line holds for what comes before it, too.
    return lines.select("rec", "stream", F.when(F.col("part") == 0, F.lit(float("-inf"))).otherwise(F.col("t")).alias("t"), "at", "level", "slope")


def synchronized(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows`` (rec, t, ...) of one stream with times moved by its clock's offset at each."""
    first = lines.where(F.col("t") == float("-inf")).select("rec", F.struct("at", "level", "slope").alias("__first"))
    later = lines.where(F.col("t") > float("-inf")).select("rec", "t", "at", "level", "slope")
    found = latest(rows, later, 3600.0, "__line").join(first, "rec", "left")
    line = lambda f: F.coalesce(F.col(f"__line.{f}"), F.col(f"__first.{f}"), F.lit(0.0))
    return found.withColumn("t", F.col("t") + line("level") + line("slope") * (F.col("t") - line("at"))).drop("__line", "__first")


def read(spark: SparkSession, path: str, synchronize: bool = False, smooth: bool = True) -> tuple[dict[str, Signal], DataFrame]:
    """(signals by the names of regular streams, markers of all irregular ones). ``rec`` is the file's name; a marker is
    the text, or the number, of an irregular stream's first channel. ``synchronize`` moves times by clock offsets."""
    known = streams(path)
    index = index_of(spark, [path])
    chunked = samples_of(index, known)
    lines = clock_lines(index) if synchronize else None
    signals, marks = {}, None
    for s in known:
        own = chunked.where(F.col("stream") == s.number)
        n = len(s.channels)
        values = F.slice("x" if s.format in NUMBERS else "text", F.col("i") * n + 1, F.lit(n))
        rows = own.select("rec", "begin", "x", "text", F.posexplode("t").alias("i", "t")).select("rec", (F.col("begin") + F.col("i")).alias("seq"), "t", values.alias("v"))
        if s.fs and smooth:
            rows = smoothed(rows, s.fs)
        if lines is not None:
            rows = synchronized(rows, lines.where(F.col("stream") == s.number))
        if s.fs and s.format in NUMBERS:
            signals[s.name] = Signal(rows.select("rec", "seq", "t", *[F.col("v")[i].alias(c) for i, c in enumerate(s.channels)]), s.channels, s.fs)
        else:
            found = rows.select("rec", F.col("seq").alias("mseq"), "t", F.col("v")[0].cast("string").alias("marker"), F.lit(s.name).alias("stream"))
            marks = found if marks is None else marks.unionByName(found)
    empty = "rec string, mseq bigint, t double, marker string, stream string"
    return signals, marks if marks is not None else spark.createDataFrame([], empty)
