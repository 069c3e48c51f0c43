"""Structures of level 5: nested values, other byte orders, and data sets from a signal and back."""

import struct

import numpy as np
import pytest

from sigspark.sources import eeglab, level5
from sigspark.spec import Signal


@pytest.mark.parametrize("compress", [False, True])
def test_nested_values(compress):
    value = {"number": 1.5, "text": "Straße", "cells": ["a", np.eye(2), [{"q": "z"}]], "events": [{"type": "S 1", "latency": 3.0}, {"type": "R", "latency": 4.0}], "none": np.empty((0, 0)), "empty": ""}
    found = level5.read(level5.packed({"EEG": value, "plain": np.arange(6.0).reshape(2, 3)}, compress))
    np.testing.assert_array_equal(found["plain"], np.arange(6.0).reshape(2, 3))
    (one,) = found["EEG"]
    assert one["number"] == 1.5 and one["text"] == "Straße" and one["cells"][0] == "a" and one["cells"][2] == [{"q": "z"}]
    np.testing.assert_array_equal(one["cells"][1], np.eye(2))
    assert [(e["type"], float(e["latency"][0, 0])) for e in one["events"]] == [("S 1", 3.0), ("R", 4.0)] and one["none"].size == 0 and one["empty"] == ""


def test_files_of_others():
    """Big-endian, with short elements, numbers stored as smaller ones than their class, and text of several rows."""
    element = lambda kind, body: struct.pack(">II", kind, len(body)) + body + b"\0" * (-len(body) % 8)
    short = lambda kind, body: struct.pack(">HH", len(body), kind) + body.ljust(4, b"\0")
    numbers = element(14, element(6, struct.pack(">II", 6, 0)) + element(5, struct.pack(">2i", 1, 3)) + short(1, b"x") + short(1, bytes([1, 2, 255])))
    text = element(14, element(6, struct.pack(">II", 4, 0)) + element(5, struct.pack(">2i", 2, 2)) + short(1, b"t") + short(16, b"acbd"))
    whole = element(14, element(6, struct.pack(">II", 10, 0)) + element(5, struct.pack(">2i", 1, 1)) + short(1, b"i") + short(3, struct.pack(">h", -7)))
    found = level5.read(b"x".ljust(124) + struct.pack(">H", 0x0100) + b"MI" + numbers + text + whole)
    assert found["x"].tolist() == [[1.0, 2.0, -1.0]] and found["t"] == ["ab", "cd"] and found["i"].tolist() == [[-7]] and found["i"].dtype == np.int16
    with pytest.raises(ValueError):
        level5.read(b"\0" * 200)


@pytest.fixture
def recording(spark):
    rows = [(r, i, 0.5 + i / 250, float(i), -float(i)) for r in ("one", "t/wo") for i in range(25)]
    s = Signal(spark.createDataFrame(rows, "rec string, seq bigint, t double, a double, ecg double"), ("a", "ecg"), 250.0)
    marks = [("one", 0, 0.5 + 21 / 250, "S  1"), ("one", 1, 0.5 + 3 / 250, "R128"), ("one", 2, 0.5 + 10 / 250, "R128"), ("one", 3, 9.0, "late")]
    return s, spark.createDataFrame(marks, "rec string, mseq bigint, t double, marker string")


def test_round_trip(spark, recording, tmp_path):
    s, markers = recording
    eeglab.write(s, markers, str(tmp_path / "sets"))
    assert sorted(p.name for p in (tmp_path / "sets").iterdir()) == ["one-0.set", "t%2Fwo-0.set"]
    got, marks = eeglab.read(spark, str(tmp_path / "sets"), block=7)
    assert got.fs == 250.0 and got.channels == ("a", "ecg")
    want = s.df.where("rec = 'one'").orderBy("seq").toPandas()
    found = got.df.where("rec = 'one-0'").orderBy("seq").toPandas()
    np.testing.assert_allclose(found[["seq", "t", "a", "ecg"]], want[["seq", "t", "a", "ecg"]])
    assert got.df.count() == 50
    told = [(r.mseq, r.marker, round(r.t, 9)) for r in marks.orderBy("mseq").collect()]
    assert told == [(0, "R128", round(0.5 + 3 / 250, 9)), (1, "R128", 0.54), (2, "S  1", round(0.5 + 21 / 250, 9))]
    raw = level5.read((tmp_path / "sets" / "one-0.set").read_bytes())["EEG"][0]
    assert [float(e["latency"][0, 0]) for e in raw["event"]] == [4.0, 11.0, 22.0] and raw["times"][0, 1] == 504.0 and raw["data"].shape == (2, 25) and raw["nbchan"] == 2


def test_long_recordings_are_cut(spark, recording):
    s, markers = recording
    files = eeglab.files_of(s, markers, rows=10).where("rec = 'one'").orderBy("part").collect()
    parts = [eeglab.unpacked(bytes(f["content"])) for f in files]
    assert [p["data"].shape[1] for p in parts] == [10, 10, 5] and np.concatenate([p["data"][0] for p in parts]).tolist() == list(range(25))
    assert [list(zip(p["types"], p["latencies"], strict=True)) for p in parts] == [[("R128", 3.0)], [("R128", 0.0)], [("S  1", 1.0)]]


def test_files_with_other_channels_are_an_error(spark, recording, tmp_path):
    s, markers = recording
    eeglab.write(Signal(s.df.where("rec = 'one'"), s.channels, s.fs), markers, str(tmp_path / "x"))
    eeglab.write(Signal(s.df.where("rec <> 'one'").withColumnRenamed("a", "b"), ("b", "ecg"), s.fs), markers, str(tmp_path / "x"))
    got, _ = eeglab.read(spark, str(tmp_path / "x"))
    with pytest.raises(Exception, match="other channels"):
        got.df.count()
