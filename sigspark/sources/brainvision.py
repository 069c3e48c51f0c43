"""Recordings as a text header (.vhdr), a binary file of samples and a text file of markers (.vmrk).

Only the header is read on the driver. Samples are read by tasks, each a range of bytes, so a file of any length is
spread over the cluster; the folder has to be one that executors reach.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import Signal

#: Fixed values of the format.
FORMATS = {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4"}
MARK = r"^Mk(\d+)=([^,]*),([^,]*),(\d+)"
UNITS = {"V": 1.0, "mV": 1e-3, "µV": 1e-6, "μV": 1e-6, "uV": 1e-6, "nV": 1e-9, "": 1e-6}


@dataclass(frozen=True)
class Header:
    data: str
    markers: str | None
    fs: float
    names: tuple[str, ...]
    scales: tuple[float, ...]
    format: str
    by_channel: bool


def read_header(path: str) -> Header:
    """What a header says; names may hold ``\\1`` for a comma."""
    with open(path, "rb") as f:
        raw = f.read()
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    found: dict[str, dict[str, str]] = {}
    section: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            section = found.setdefault(line[1:-1], {})
        elif "=" in line and not line.startswith(";"):
            name, value = line.split("=", 1)
            section[name.strip()] = value.strip()
    common = found.get("Common Infos", {})
    kind = found.get("Binary Infos", {}).get("BinaryFormat")
    if common.get("DataFormat", "BINARY") != "BINARY" or kind not in FORMATS:
        raise ValueError(f"{path}: samples are not of a binary format that is known")
    infos = found.get("Channel Infos", {})
    rows = [(infos[f"Ch{i + 1}"].split(",") + [""] * 4)[:4] for i in range(int(common["NumberOfChannels"]))]
    folder, stem = os.path.split(path)
    beside = lambda name: os.path.join(folder, name.replace("$b", os.path.splitext(stem)[0]))
    return Header(
        beside(common["DataFile"]),
        beside(common["MarkerFile"]) if common.get("MarkerFile") else None,
        1e6 / float(common["SamplingInterval"]),
        tuple(r[0].replace("\\1", ",") for r in rows),
        tuple((float(r[2]) if r[2] else 1.0) * UNITS.get(r[3], 1.0) for r in rows),
        FORMATS[kind],
        common.get("DataOrientation", "MULTIPLEXED") == "VECTORIZED",
    )


def samples_of(head: Header, begin: int, n: int) -> np.ndarray:
    """``n`` samples from number ``begin`` on, samples x channels, in volts."""
    dtype, wide = np.dtype(head.format), len(head.names)
    if head.by_channel:
        total = os.path.getsize(head.data) // (dtype.itemsize * wide)
        values = np.stack([np.fromfile(head.data, dtype, n, offset=(c * total + begin) * dtype.itemsize) for c in range(wide)], 1)
    else:
        values = np.fromfile(head.data, dtype, n * wide, offset=begin * wide * dtype.itemsize).reshape(n, wide)
    return values * np.array(head.scales)


def length_of(head: Header) -> int:
    """How many samples there are. An incomplete last sample is an error."""
    samples, rest = divmod(os.path.getsize(head.data), np.dtype(head.format).itemsize * len(head.names))
    if rest:
        raise ValueError(f"{head.data}: {rest} bytes behind the last whole sample")
    return samples


def read_signal(spark: SparkSession, path: str, rec: str | None = None, block: int = 262_144) -> Signal:
    """The samples in volts; ``block`` samples are a task's at a time. An incomplete last sample is an error."""
    head = read_header(path)
    wide, name, samples = len(head.names), rec or os.path.splitext(os.path.basename(path))[0], length_of(head)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in frame["id"] * block:
                n = min(block, samples - begin)
                values, seq = samples_of(head, begin, n), np.arange(begin, begin + n)
                yield pd.DataFrame({"rec": name, "seq": seq, "t": seq / head.fs} | {f"c{c}": values[:, c] for c in range(wide)})

    blocks = -(-samples // block)
    df = spark.range(0, blocks, 1, max(1, blocks)).mapInPandas(rows, ", ".join(["rec string", "seq bigint", "t double", *[f"c{c} double" for c in range(wide)]]))
    return Signal(df.toDF("rec", "seq", "t", *head.names), head.names, head.fs)


def marks_of(head: Header) -> list[tuple[int, int, str]]:
    """(number, sample, kind/description) of each line of the marker file, as ``read_markers`` gives them."""
    if not head.markers:
        return []
    with open(head.markers, "rb") as f:
        lines = f.read().decode("utf-8", "replace").splitlines()
    found = [re.match(MARK, line) for line in lines]
    return [(int(m[1]) - 1, int(m[4]) - 1, "/".join((m[2].replace("\\1", ","), m[3].replace("\\1", ",")))) for m in found if m]


def read_markers(spark: SparkSession, path: str, rec: str | None = None) -> DataFrame:
    """(rec, mseq, t, marker) of a header's marker file; ``marker`` is kind/description, ``t`` its sample over fs."""
    head = read_header(path)
    if not head.markers:
        return spark.createDataFrame([], "rec string, mseq bigint, t double, marker string")
    name = rec or os.path.splitext(os.path.basename(path))[0]
    part = lambda i: F.regexp_extract("value", MARK, i)
    rows = spark.read.text(head.markers).where(F.col("value").rlike(MARK))
    comma = lambda c: F.replace(c, F.lit("\\1"), F.lit(","))
    return rows.select(
        F.lit(name).alias("rec"),
        (part(1).cast("bigint") - 1).alias("mseq"),
        ((part(4).cast("bigint") - 1) / head.fs).alias("t"),
        F.concat_ws("/", comma(part(2)), comma(part(3))).alias("marker"),
    )
