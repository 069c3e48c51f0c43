"""Files of both versions, built field by field."""

import struct

import numpy as np
import pytest

from sigspark.sources import gdf

LABELS = [b"C3", b"C4", b""]


def built(version: str, values: np.ndarray, per_record: int, events: list[tuple[int, int]], closed: bool = True) -> bytes:
    """Records of ``per_record`` samples a channel, 0.5 s each; digital -100 to 100 stand for -1 to 3."""
    n, new = values.shape[1], float(version) >= 1.9
    records = len(values) // per_record
    fixed = bytearray(256)
    fixed[:8] = b"GDF " + version.encode()
    struct.pack_into("<H" if new else "<q", fixed, 184, (n + 1) if new else 256 * (n + 1))
    struct.pack_into("<qII", fixed, 236, records if closed else -1, 1, 2)
    struct.pack_into("<H" if new else "<I", fixed, 252, n)
    each = lambda f: b"".join(f(i) for i in range(n))
    ends = each(lambda i: struct.pack("<d", -1)) + each(lambda i: struct.pack("<d", 3))
    digital = "<d" if new else "<q"
    ends += each(lambda i: struct.pack(digital, -100)) + each(lambda i: struct.pack(digital, 100))
    head = each(lambda i: LABELS[i].ljust(16, b"\0")) + bytes(80 * n)
    tail = each(lambda i: struct.pack("<I", per_record)) + each(lambda i: struct.pack("<I", 3)) + bytes(32 * n)
    if new:
        head += bytes(6 * n) + each(lambda i: struct.pack("<H", 4275)) + ends + bytes(80 * n)
    else:
        head += each(lambda i: b"uV".ljust(8, b"\0")) + ends + bytes(80 * n)
    body = b"".join(values[r * per_record : (r + 1) * per_record].T.astype("<i2").tobytes() for r in range(records))
    count = struct.pack("<I", len(events))[:3] if float(version) >= 1.94 else bytes(3)
    table = b"\1" + count + (bytes(4) if float(version) >= 1.94 else struct.pack("<I", len(events)))
    table += b"".join(struct.pack("<I", p) for p, _ in events) + b"".join(struct.pack("<H", k) for _, k in events)
    return bytes(fixed) + head + tail + body + (table if closed else b"")


@pytest.mark.parametrize("version", ["1.25", "2.20"])
def test_samples_and_events(spark, tmp_path, version):
    values = np.arange(-60, 60).reshape(40, 3)
    path = str(tmp_path / "one.gdf")
    (tmp_path / "one.gdf").write_bytes(built(version, values, 4, [(1, 768), (21, 769), (40, 33025)]))
    s = gdf.read_signal(spark, path, block=10)
    assert s.fs == 8.0 and s.channels == ("C3", "C4", "Ch3")
    got = s.df.orderBy("seq").toPandas()
    assert got["seq"].tolist() == list(range(40)) and set(got["rec"]) == {"one"}
    np.testing.assert_allclose(got[["C3", "C4", "Ch3"]], ((values + 100) / 50 - 1) * 1e-6, rtol=1e-12)
    np.testing.assert_allclose(got["t"], np.arange(40) / 8)
    assert [(r.mseq, r.t, r.marker) for r in gdf.read_markers(spark, path).orderBy("mseq").collect()] == [(0, 0.0, "768"), (1, 2.5, "769"), (2, 39 / 8, "33025")]


def test_a_file_that_was_not_closed(spark, tmp_path):
    path = str(tmp_path / "open.gdf")
    (tmp_path / "open.gdf").write_bytes(built("2.20", np.zeros((12, 2), int), 4, [], closed=False) + b"\0" * 5)
    assert gdf.read_signal(spark, path, "x").df.count() == 12
    assert gdf.read_markers(spark, path).count() == 0
    (tmp_path / "other.gdf").write_bytes(b"\0" * 300)
    with pytest.raises(ValueError):
        gdf.read_head(str(tmp_path / "other.gdf"))
