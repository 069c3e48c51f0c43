"""Chunks of several streams: unstamped samples, gaps, and clocks that drift and jump."""

import struct

import numpy as np
import pytest

from sigspark.sources import xdf


def chunk(tag: int, body: bytes) -> bytes:
    size = len(body) + 2
    head = bytes([1, size]) if size < 256 else bytes([4]) + struct.pack("<I", size)
    return head + struct.pack("<H", tag) + body


def header(number: int, name: str, fs: float, kind: str, labels=(), n=None) -> bytes:
    told = "".join(f"<channel><label>{x}</label></channel>" for x in labels)
    info = f"<info><name>{name}</name><channel_count>{n or len(labels)}</channel_count><nominal_srate>{fs}</nominal_srate><channel_format>{kind}</channel_format><desc><channels>{told}</channels></desc></info>"
    return chunk(2, struct.pack("<I", number) + info.encode())


def samples(number: int, stamps, values, kind: str) -> bytes:
    body = struct.pack("<I", number) + bytes([1, len(stamps)])
    for t, v in zip(stamps, values, strict=True):
        body += b"\0" if t is None else b"\x08" + struct.pack("<d", t)
        for x in v:
            body += bytes([1, len(x.encode())]) + x.encode() if kind == "s" else struct.pack("<" + kind, x)
    return chunk(3, body)


@pytest.fixture
def recording(tmp_path):
    """A stream of two channels at 100 Hz, 600 samples, few of them stamped, with a gap of 20 s; markers; whole numbers."""
    seq = np.arange(600)
    t = 5.0 + seq / 100 + np.where(seq >= 400, 20.0, 0.0)
    x = np.stack([seq * 1.0, -seq * 2.0], 1)
    raw = b"XDF:" + chunk(1, b"<info/>") + header(1, "eeg", 100.0, "float32", ("C3", "C4")) + header(2, "cues", 0, "string", n=1) + header(7, "steps", 50.0, "int16", n=1)
    parts = []
    for begin in range(0, 600, 25):
        # Only every other chunk opens with a stamp, and the one behind the gap.
        stamps = [t[i] if i == begin and begin % 50 == 0 else None for i in range(begin, begin + 25)]
        parts.append(samples(1, stamps, x[begin : begin + 25], "f"))
    parts.insert(3, samples(2, [5.5, 5.75], [["go"], ["stöp"]], "s"))
    parts.insert(9, samples(7, [None, None, None], [[1], [2], [-3]], "h"))
    parts.insert(12, chunk(5, b"\0" * 16))
    for k in range(30):  # the clock drifts by 1 ms a second, and jumps by 3 s after 12 s
        at = 5.0 + k
        parts.insert(2 * k + 1 if 2 * k + 1 < len(parts) else len(parts), chunk(4, struct.pack("<Idd", 1, at, 10 + 0.001 * at + (3 if at > 17 else 0))))
    path = tmp_path / "one.xdf"
    path.write_bytes(raw + b"".join(parts) + chunk(6, struct.pack("<I", 1) + b"<info/>"))
    return str(path), t, x


def test_streams(spark, recording):
    path, t, x = recording
    signals, markers = xdf.read(spark, path)
    assert set(signals) == {"eeg", "steps"} and signals["eeg"].channels == ("C3", "C4") and signals["eeg"].fs == 100.0
    got = signals["eeg"].df.orderBy("seq").toPandas()
    assert got["seq"].tolist() == list(range(600)) and set(got["rec"]) == {"one"}
    np.testing.assert_array_equal(got[["C3", "C4"]], x)
    np.testing.assert_allclose(got["t"], t, atol=1e-9)
    assert [(r.t, r.marker, r.stream) for r in markers.orderBy("mseq").collect()] == [(5.5, "go", "cues"), (5.75, "stöp", "cues")]
    steps = signals["steps"].df.orderBy("seq").toPandas()
    assert steps["Ch1"].tolist() == [1.0, 2.0, -3.0] and np.allclose(steps["t"], [0.0, 0.02, 0.04])


def test_clocks(spark, recording):
    """Drift and jump are recovered; streams without offsets stay."""
    path, t, _ = recording
    signals, markers = xdf.read(spark, path, synchronize=True)
    got = signals["eeg"].df.orderBy("seq").toPandas()
    np.testing.assert_allclose(got["t"], t + 10 + 0.001 * t + np.where(t > 17, 3.0, 0.0), atol=1e-6)
    assert [r.t for r in markers.orderBy("mseq").collect()] == [5.5, 5.75]


def test_jitter_is_smoothed(spark, tmp_path):
    rng = np.random.default_rng(1)
    seq = np.arange(240)
    true = 3 + seq / 100
    noisy = true + rng.normal(0, 0.002, 240)
    raw = b"XDF:" + header(1, "eeg", 100.0, "double64", ("a",)) + b"".join(samples(1, noisy[i : i + 10], seq[i : i + 10, None], "d") for i in range(0, 240, 10))
    path = str(tmp_path / "x.xdf")
    (tmp_path / "x.xdf").write_bytes(raw)
    got, _ = xdf.read(spark, path)
    slope, level = np.polyfit(seq, noisy, 1)
    np.testing.assert_allclose(got["eeg"].df.orderBy("seq").toPandas()["t"], level + slope * seq, atol=1e-9)
    raw, _ = xdf.read(spark, path, smooth=False)
    np.testing.assert_allclose(raw["eeg"].df.orderBy("seq").toPandas()["t"], noisy)
    (tmp_path / "y.xdf").write_bytes(b"none")
    with pytest.raises(ValueError):
        xdf.streams(str(tmp_path / "y.xdf"))
