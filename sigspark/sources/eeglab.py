"""Data sets of structures (.set, .mat) as signals with markers, and back.

A file is one task's, as its structure has to be read as a whole; its samples leave the task as blocks of arrays. Long
recordings are packed as one file for every ``rows`` samples, so no file has to hold one. Times are seconds here and
milliseconds there; an event's latency is its sample's number from 0 here, and from 1 there.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import Signal
from . import level5

BLOCKS = "rec string, fs double, names array<string>, first bigint, t array<double>, x array<double>, events array<struct<mseq:bigint,latency:double,type:string>>"


def unpacked(raw: bytes, name: str = "EEG") -> dict:
    """data (channels x samples), times in seconds, fs, names of channels, types and latencies (from 0) of events."""
    found = level5.read(raw)
    s = found[name][0] if name in found else found  # newer files hold the fields as variables of their own
    one = lambda x: float(np.ravel(x)[0])
    data = np.atleast_2d(np.asarray(s["data"], np.float64))
    fs, times = one(s["srate"]), np.ravel(s.get("times", np.empty(0))).astype(np.float64) / 1000
    if len(times) != data.shape[1]:
        times = np.arange(data.shape[1]) / fs
    events = [e for e in s["event"] if isinstance(e, dict)] if isinstance(s.get("event"), list) else []
    places = s.get("chanlocs")
    names = [c["labels"] for c in places] if isinstance(places, list) and places else [f"Ch{i + 1}" for i in range(len(data))]
    types = [e["type"] if isinstance(e["type"], str) else f"{one(e['type']):g}" for e in events]
    return {"data": data, "times": times, "fs": fs, "names": names, "types": types, "latencies": [one(e["latency"]) - 1 for e in events]}


def packed(rec: str, data: np.ndarray, times: np.ndarray, fs: float, names: list[str], types: list[str], latencies: list[float], compress: bool = True) -> bytes:
    """A file of one structure, EEG; events are sorted by latency."""
    none = np.empty((0, 0))
    events = [{"type": types[i], "latency": latencies[i] + 1} for i in np.argsort(latencies, kind="stable")]
    body = {
        "setname": "", "filename": rec, "filepath": "", "data": data, "times": times * 1000, "nbchan": len(data), "pnts": data.shape[1], "trials": 1, "srate": fs,
        "xmin": times[0], "xmax": times[-1], "chanlocs": [{"labels": n} for n in names], "event": events or none, "icawinv": none, "icasphere": none, "icaweights": none, "icaact": none,
    }
    return level5.packed({"EEG": body}, compress)


def blocks_of(files: DataFrame, block: int = 65_536, name: str = "EEG") -> DataFrame:
    """Rows of ``BLOCKS`` of (rec, content); a file's events come with its first block."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rec, raw in zip(frame["rec"], frame["content"], strict=True):
                s = unpacked(bytes(raw), name)
                for begin in range(0, max(1, len(s["times"])), block):
                    part = slice(begin, begin + block)
                    events = [{"mseq": k, "latency": x, "type": e} for k, (x, e) in enumerate(zip(s["latencies"], s["types"], strict=True))] if begin == 0 else []
                    yield pd.DataFrame({"rec": [rec], "fs": s["fs"], "names": [s["names"]], "first": begin, "t": [s["times"][part]], "x": [s["data"][:, part].T.ravel()], "events": [events]})

    return files.select(F.col("rec").cast("string").alias("rec"), "content").mapInPandas(rows, BLOCKS)


def signal_of(blocks: DataFrame, names: list[str], fs: float) -> tuple[Signal, DataFrame]:
    """The signal and the markers of ``blocks_of``; files with other channels are an error."""
    n = len(names)
    same = F.when(F.col("names") == F.array(*map(F.lit, names)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("other channels in "), F.col("rec"))))
    samples = F.transform("t", lambda t, i: F.struct(t.alias("t"), F.slice("x", i * n + 1, F.lit(n)).alias("x")))
    rows = blocks.where(same).select("rec", "first", F.posexplode(samples).alias("i", "s"))
    df = rows.select("rec", (F.col("first") + F.col("i")).alias("seq"), "s.t", *[F.col("s.x")[c].alias(name) for c, name in enumerate(names)])
    marks = blocks.where("first = 0").select("rec", "fs", F.col("t")[0].alias("begin"), F.explode("events").alias("e"))
    return Signal(df, tuple(names), fs), marks.select("rec", "e.mseq", (F.coalesce("begin", F.lit(0.0)) + F.col("e.latency") / F.col("fs")).alias("t"), F.col("e.type").alias("marker"))


def read(spark: SparkSession, path: str, block: int = 65_536, name: str = "EEG") -> tuple[Signal, DataFrame]:
    """All files of a path (a file, a folder or a pattern), each a recording named by its file; one file's head is read first."""
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    files = spark.read.format("binaryFile").load(path).select(stem.alias("rec"), "content")
    blocks = blocks_of(files, block, name)
    head = blocks.select("names", "fs").first()
    if head is None:
        raise ValueError(f"no files in {path}")
    return signal_of(blocks, list(head["names"]), head["fs"])


def files_of(s: Signal, markers: DataFrame, rows: int = 1 << 20, compress: bool = True) -> DataFrame:
    """(rec, part, content): a file for every ``rows`` samples of a recording, with the events among these samples.

    An event belongs to the sample nearest to its time; those outside their recording are left out.
    """
    s.need("signal")
    names, rec, fs = list(s.channels), s.df.schema["rec"].dataType.simpleString(), s.fs
    bounds = s.df.groupBy("rec").agg(F.min("t").alias("__begin"), F.min("seq").alias("__first"), F.max("seq").alias("__last"))
    place = F.round((F.col("t") - F.col("__begin")) * fs).cast("bigint") + F.col("__first")
    marks = markers.join(bounds, "rec").withColumn("__place", place).where((F.col("__place") >= F.col("__first")) & (F.col("__place") <= F.col("__last")))
    # New names, as markers may stem from the very samples they meet.
    marks = marks.select("rec", F.floor(F.col("__place") / rows), "mseq", "__place", "marker").toDF("of", "of_part", "mseq", "place", "marker")
    samples = s.df.select("rec", F.floor(F.col("seq") / rows).alias("part"), "seq", "t", *names)

    def pack(key: tuple, frame: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({"rec": [], "part": [], "content": []})
        frame, events = frame.sort_values("seq"), events.sort_values(["place", "mseq"])
        first = int(frame["seq"].iloc[0])
        raw = packed(str(key[0]), frame[names].to_numpy(np.float64).T, frame["t"].to_numpy(np.float64), fs, names, events["marker"].astype(str).tolist(), (events["place"] - first).tolist(), compress)
        return pd.DataFrame({"rec": [key[0]], "part": [key[1]], "content": [raw]})

    return samples.groupBy("rec", "part").cogroup(marks.groupBy("of", "of_part")).applyInPandas(pack, f"rec {rec}, part bigint, content binary")


def write(s: Signal, markers: DataFrame, folder: str, rows: int = 1 << 20) -> None:
    """``files_of`` as ``<rec>-<part>.set`` in a folder that all executors share; a task that runs again replaces its files."""

    def save(found) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in found:
            name = f"{folder}/{quote(str(row['rec']), safe='')}-{row['part']}.set"
            with open(f"{name}.{uuid.uuid4().hex}", "wb") as f:
                f.write(row["content"])
            os.replace(f.name, name)

    files_of(s, markers, rows).foreachPartition(save)
