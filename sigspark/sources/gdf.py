"""Recordings in the general data format for biosignals (.gdf), versions 1 and 2.

Only the head is read on the driver. Data records are read by tasks, each a range of them; the events, a few numbers each
behind the last record, by one. The folder has to be one that executors reach.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..spec import Signal

#: Fixed values of the format: numbers by their kind, the widths of a channel's fields by version, factors of voltage units.
NUMBERS = {1: "<i1", 2: "<u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<i8", 8: "<u8", 16: "<f4", 17: "<f8"}
FIELDS = {
    1: [("label", 16), ("transducer", 80), ("unit", 8), ("low", 8), ("high", 8), ("digital_low", 8), ("digital_high", 8), ("filter", 80), ("samples", 4), ("kind", 4), ("rest", 32)],
    2: [("label", 16), ("transducer", 80), ("old_unit", 6), ("unit", 2), ("low", 8), ("high", 8), ("digital_low", 8), ("digital_high", 8), ("filter", 68), ("lowpass", 4), ("highpass", 4), ("notch", 4), ("samples", 4), ("kind", 4), ("place", 12), ("rest", 20)],
}
UNITS = {4256: 1.0, 4274: 1e-3, 4275: 1e-6, 4276: 1e-9, b"V": 1.0, b"mV": 1e-3, b"uV": 1e-6, b"nV": 1e-9}


@dataclass(frozen=True)
class Head:
    version: float
    begin: int
    records: int
    fs: float
    names: tuple[str, ...]
    kinds: tuple[str, ...]
    per_record: int
    scales: tuple[float, ...]
    offsets: tuple[float, ...]

    @property
    def record(self) -> np.dtype:
        """A data record: each channel's samples behind one another."""
        return np.dtype([(f"c{i}", kind, (self.per_record,)) for i, kind in enumerate(self.kinds)])


def read_head(path: str) -> Head:
    """What a file's head says. Channels of several rates, and numbers of 24 bits, are an error."""
    with open(path, "rb") as f:
        fixed = f.read(256)
        if fixed[:4] != b"GDF ":
            raise ValueError(f"{path}: not a file of this format")
        version = float(fixed[4:8])
        n = struct.unpack_from("<H" if version >= 1.9 else "<I", fixed, 252)[0]
        begin = struct.unpack_from("<H", fixed, 184)[0] * 256 if version >= 1.9 else struct.unpack_from("<q", fixed, 184)[0]
        raw = f.read(256 * n)
    records, (num, den) = struct.unpack_from("<q", fixed, 236)[0], struct.unpack_from("<II", fixed, 244)
    fields, at = {}, 0
    for name, width in FIELDS[2 if version >= 1.9 else 1]:
        fields[name] = [raw[at + i * width : at + (i + 1) * width] for i in range(n)]
        at += n * width
    numbers = lambda name, kind: [struct.unpack("<" + kind, x)[0] for x in fields[name]]
    digits = "d" if version >= 1.9 else "q"
    samples, kinds = numbers("samples", "I"), numbers("kind", "I")
    if len(set(samples)) > 1 or any(k not in NUMBERS for k in kinds):
        raise ValueError(f"{path}: channels of several rates, or of kinds of numbers that are not known")
    low, high, dlow, dhigh = numbers("low", "d"), numbers("high", "d"), numbers("digital_low", digits), numbers("digital_high", digits)
    units = numbers("unit", "H") if version >= 1.9 else [x.strip(b"\0 ") for x in fields["unit"]]
    factor = [UNITS.get(u, 1.0) for u in units]
    gain = [(b - a) / (d - c) for a, b, c, d in zip(low, high, dlow, dhigh, strict=True)]
    names = [x.split(b"\0")[0].decode("latin-1").strip() or f"Ch{i + 1}" for i, x in enumerate(fields["label"])]
    offsets = [(a - c * g) * u for a, c, g, u in zip(low, dlow, gain, factor, strict=True)]
    return Head(version, begin, records, samples[0] * den / num, tuple(names), tuple(NUMBERS[k] for k in kinds), samples[0], tuple(g * u for g, u in zip(gain, factor, strict=True)), tuple(offsets))


def records_of(path: str, head: Head) -> int:
    """How many whole data records there are; a file that was not closed tells -1."""
    return head.records if head.records >= 0 else (os.path.getsize(path) - head.begin) // head.record.itemsize


def read_signal(spark: SparkSession, path: str, rec: str | None = None, block: int = 262_144) -> Signal:
    """The samples, in volts where the unit is one of voltage; some ``block`` samples are a task's at a time."""
    head, name = read_head(path), rec or os.path.splitext(os.path.basename(path))[0]
    total, many = records_of(path, head), max(1, block // max(1, head.per_record))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in frame["id"] * many:
                n = min(many, total - first)
                found = np.fromfile(path, head.record, n, offset=head.begin + first * head.record.itemsize)
                seq = np.arange(first * head.per_record, (first + n) * head.per_record)
                values = {f"c{i}": found[f"c{i}"].astype(np.float64).ravel() * a + b for i, (a, b) in enumerate(zip(head.scales, head.offsets, strict=True))}
                yield pd.DataFrame({"rec": name, "seq": seq, "t": seq / head.fs} | values)

    tasks = -(-total // many)
    shape = ", ".join(["rec string, seq bigint, t double", *[f"c{i} double" for i in range(len(head.names))]])
    return Signal(spark.range(0, tasks, 1, max(1, tasks)).mapInPandas(rows, shape).toDF("rec", "seq", "t", *head.names), head.names, head.fs)


def events_of(path: str, head: Head) -> list[tuple[int, int]]:
    """(sample from 0, kind) of the event table, in its order."""
    with open(path, "rb") as f:
        f.seek(head.begin + records_of(path, head) * head.record.itemsize)
        raw = f.read()
    if len(raw) < 8:
        return []
    n = int.from_bytes(raw[1:4], "little") if head.version >= 1.94 else struct.unpack_from("<I", raw, 4)[0]
    places, kinds = np.frombuffer(raw, "<u4", n, 8), np.frombuffer(raw, "<u2", n, 8 + 4 * n)
    return [(int(p) - 1, int(k)) for p, k in zip(places, kinds, strict=True)]


def read_markers(spark: SparkSession, path: str, rec: str | None = None) -> DataFrame:
    """(rec, mseq, t, marker): the number of an event's kind, at its sample over fs."""
    head, name = read_head(path), rec or os.path.splitext(os.path.basename(path))[0]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _ in frame["id"]:
                yield pd.DataFrame([(name, k, p / head.fs, str(kind)) for k, (p, kind) in enumerate(events_of(path, head))], columns=["rec", "mseq", "t", "marker"])

    return spark.range(1).mapInPandas(rows, "rec string, mseq bigint, t double, marker string")
