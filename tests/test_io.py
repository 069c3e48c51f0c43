"""Sources and sinks on small files, and streams against the batch operators."""

import socket
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import epochs, iir
from sigspark.sources import brainvision, generator, rda, sinks
from sigspark.spec import Signal
from sigspark.streaming import epochs as sliding
from sigspark.streaming import stateful

from .test_streaming_artifacts import store  # noqa: F401


def message(kind: int, body: bytes) -> bytes:
    return struct.pack(rda.HEAD, b"i" * 16, rda.HEAD_SIZE + len(body), kind) + body


def test_rda(spark):
    start = rda.start_of(message(rda.START, struct.pack("<Ld2d", 2, 4000.0, 1.0, 1.0) + b"left\0right\0"))
    assert (start.fs, start.names) == (250.0, ("left", "right"))
    values = np.arange(20, dtype="<f4").reshape(10, 2)
    mark = b"Stimulus\0S 1\0"
    mark = struct.pack("<LLLl", 16 + len(mark), 2, 1, -1) + mark
    bodies = [struct.pack("<LLL", 7, 4, 0) + values[:4].tobytes(), struct.pack("<LLL", 8, 6, 1) + values[4:].tobytes() + mark]
    raw = b"".join(message(rda.DATA, b) for b in bodies)
    whole, rest = rda.split_messages(raw + raw[:30])
    assert len(whole) == 2 and rest == raw[:30]
    df = spark.createDataFrame([("r", bytearray(m)) for m in reversed(whole)] + [("r", None)], "rec string, message binary")
    signal, markers = rda.read_rda(df, start)
    got = signal.df.orderBy("seq").toPandas()
    np.testing.assert_array_equal(got[["left", "right"]], values)
    np.testing.assert_allclose(got["t"], np.arange(10) / 250)
    m = markers.collect()
    assert len(m) == 1 and m[0].marker == "S 1" and abs(m[0].t - 7 / 250) < 1e-12


@pytest.mark.parametrize("turned", [False, True])
def test_brainvision(spark, tmp_path, turned):
    values = np.arange(-30, 30, dtype="<i2").reshape(20, 3)
    (values.T if turned else values).astype("<i2").tofile(tmp_path / "one.eeg")
    (tmp_path / "one.vmrk").write_text("Brain Vision Data Exchange Marker File\n[Marker Infos]\n; note\nMk1=New Segment,,1,1,0\nMk2=Stimulus,S  1,11,1,0\n")
    (tmp_path / "one.vhdr").write_text(
        "[Common Infos]\nDataFile=$b.eeg\nMarkerFile=one.vmrk\nDataFormat=BINARY\n"
        f"DataOrientation={'VECTORIZED' if turned else 'MULTIPLEXED'}\nNumberOfChannels=3\nSamplingInterval=2000\n"
        "[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=Fp1,,0.5,µV\nCh2=a\\1b,,1,mV\nCh3=C3,,,\n",
        encoding="utf-8",
    )
    path = str(tmp_path / "one.vhdr")
    s = brainvision.read_signal(spark, path, block=7)
    got = s.df.orderBy("seq").toPandas()
    np.testing.assert_allclose(got[["Fp1", "a,b", "C3"]].to_numpy(), values * [0.5e-6, 1e-3, 1e-6])
    assert s.fs == 500 and got["seq"].tolist() == list(range(20))
    marks = [(r.t, r.marker) for r in brainvision.read_markers(spark, path).orderBy("mseq").collect()]
    assert marks == [(0.0, "New Segment/"), (0.02, "Stimulus/S  1")]


def test_text_and_tables(spark, tmp_path):
    s = generator.generate(spark, "oscillator", 2, 250.0, 40)
    want = s.df.select(F.col("rec").cast("string").alias("rec"), "seq", "t", *s.channels).orderBy("seq").collect()
    sinks.write_csv(s, str(tmp_path / "text"))
    assert sinks.read_csv(spark, str(tmp_path / "text"), list(s.channels)).df.orderBy("seq").collect() == want
    for _ in range(2):
        sinks.write_table(s, str(tmp_path / "tables"), "one")
    assert spark.read.parquet(str(tmp_path / "tables" / "one")).count() == 80


def test_datagrams(spark):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as inbox:
        inbox.bind(("127.0.0.1", 0))
        inbox.settimeout(20)
        df = spark.createDataFrame([("r", i, i / 250, float(i), None) for i in range(3)], "rec string, seq bigint, t double, a double, b double")
        sinks.send(Signal(df, ("a", "b"), 250.0), sinks.datagrams("127.0.0.1", inbox.getsockname()[1]))
        assert sorted(inbox.recv(100).decode() for _ in range(3)) == ["0.0 NaN", "1.0 NaN", "2.0 NaN"]


@pytest.fixture
def landed(spark, tmp_path):
    """A signal landed in files of 100 samples, in order, and as a stream of one file a trigger."""
    s = generator.generate(spark, "oscillator", 2, 250.0, 500)
    df = s.df.withColumn("ts", F.timestamp_millis((F.col("t") * 1000).cast("bigint")))
    folder = str(tmp_path / "landed")
    for i in range(5):
        df.where(F.col("seq").between(100 * i, 100 * i + 99)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return s, Signal(stream, s.channels, s.fs), Signal(df, s.channels, s.fs)


def shown(spark, df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name)


def test_streaming_filter(spark, landed, tmp_path):
    batch, stream, _ = landed
    got = shown(spark, stateful.butter(stream, 8.0, 30.0, 2).df, "filtered", tmp_path).orderBy("seq").toPandas()
    want = iir.butter(batch, 8.0, 30.0, 2).df.orderBy("seq").toPandas()
    np.testing.assert_allclose(got[["Ch1", "Ch2"]], want[["Ch1", "Ch2"]], atol=1e-9)


def test_streaming_epochs(spark, landed, tmp_path):
    _, stream, table = landed
    got = shown(spark, stateful.epoch_stat(stream, "mean", "400 milliseconds", "200 milliseconds", "0 seconds"), "means", tmp_path).collect()
    values = table.df.select(F.unix_millis("ts").alias("ms"), "Ch1").toPandas()
    assert len(got) >= 7
    for r in got:
        begin = round(r.epoch_start.timestamp() * 1000)
        inside = values[(values["ms"] >= begin) & (values["ms"] < begin + 400)]
        assert abs(r.Ch1 - inside["Ch1"].mean()) < 1e-9


def test_streaming_stimulations(spark, landed, tmp_path):
    _, stream, table = landed
    marks = spark.createDataFrame([(1, 0.5, "400"), (2, 0.9, "401")], "mseq bigint, t double, marker string")
    rec = table.df.first().rec
    marks = marks.select(F.lit(rec).alias("rec"), "mseq", F.timestamp_millis((F.col("t") * 1000).cast("bigint")).alias("ts"), "marker")
    marks.write.parquet(str(tmp_path / "marks"))
    markers = spark.readStream.schema(marks.schema).parquet(str(tmp_path / "marks"))
    got = shown(spark, stateful.stimulation_epochs(stream, markers, ["400"], 0.1, 0.4, "2 seconds"), "cues", tmp_path).collect()
    want = {r.seq for r in table.df.where("unix_millis(ts) >= 600 AND unix_millis(ts) < 1000").collect()}
    assert {r.seq for r in got} == want and len(got) == len(want) and {r.epoch_id for r in got} == {1}


def test_streaming_marker_epochs(spark, landed, tmp_path, store):  # noqa: F811
    batch, stream, table = landed
    rec = table.df.first().rec
    cues = [(0, 0.301, "a"), (1, 0.301, "b"), (2, 0.7, "c"), (3, 1.2004, "d"), (4, 1.9, "e"), (5, 2.5, "f")]
    marks = spark.createDataFrame(cues, "mseq bigint, t double, marker string").select(F.lit(rec).alias("rec"), "mseq", "t", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint")).alias("ts"), "marker")
    for i, (low, high) in enumerate([(0, 1), (1, 9)]):
        marks.where(F.col("t").between(low, high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "marks"))
    markers = spark.readStream.schema(marks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "marks"))
    got = shown(spark, sliding.marker_epochs(stream, markers, "1 second").df, "between", tmp_path).toPandas()
    seconds = table.df.withColumn("t", F.unix_millis("ts") / 1000)
    want = epochs.marker_epochs(Signal(seconds, batch.channels, batch.fs), marks.drop("ts"), 1.0).df.toPandas()
    # The stream's last watermark is a second behind its last row, so the last closed epochs are still held.
    done = want[want["epoch_id"] <= got["epoch_id"].max()]
    assert got["epoch_id"].max() >= 1 and len(got) == len(done) == len(got[["rec", "seq"]].drop_duplicates())
    both = got.merge(done, on=["rec", "seq"], suffixes=("", "_w"))
    assert len(both) == len(got) and (both["epoch_id"] == both["epoch_id_w"]).all() and (both["label"] == both["label_w"]).all()
    for c in ("epoch_start", "epoch_end", "Ch1", "Ch2"):
        np.testing.assert_allclose(both[c], both[f"{c}_w"], atol=1e-6)


def test_serial_frames(spark):
    df = spark.createDataFrame([("r", 0, 0.0, 7.0, 255.0), ("r", 1, 0.1, 0.0, 16.0)], "rec string, seq bigint, t double, a double, b double")
    s = Signal(df, ("a", "b"), 10.0)
    assert [bytes(r["line"]) for r in sinks.frames_of(s).collect()] == [b"\0\x07\xff", b"\0\0\x10"]
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as inbox:
        inbox.bind(("127.0.0.1", 0))
        inbox.settimeout(20)
        sinks.send(s, sinks.datagrams("127.0.0.1", inbox.getsockname()[1]), message=sinks.frames_of)
        assert sorted(inbox.recv(100) for _ in range(2)) == [b"\0\0\x10", b"\0\x07\xff"]
    with pytest.raises(Exception, match="whole numbers"):
        sinks.frames_of(s.project({"a": F.col("a") + 0.5})).collect()


def elements(raw: bytes):
    """(kind, body) of a file's elements, by their tags."""
    at = 0
    while at < len(raw):
        kind, n = struct.unpack_from("<II", raw, at)
        yield kind, raw[at + 8 : at + 8 + n]
        at += 8 + n + -n % 8


def test_numeric_files(spark, tmp_path):
    df = spark.createDataFrame([("r/1", i, i / 10, float(i), float(-i)) for i in range(5)], "rec string, seq bigint, t double, a double, long double")
    sinks.write_mat(Signal(df, ("a", "long"), 10.0), str(tmp_path / "mat"), 3)
    files = sorted((tmp_path / "mat").iterdir())
    assert [f.name for f in files] == ["r%2F1-0.mat", "r%2F1-1.mat"]
    for part, f in enumerate(files):
        raw = f.read_bytes()
        assert raw[124:128] == b"\x00\x01IM"
        found = {}
        for kind, body in elements(raw[128:]):
            flags, shape, name, data = elements(body)
            assert (kind, flags[0], shape[0], name[0]) == (14, 6, 5, 1)
            size = struct.unpack("<2i", shape[1])
            text = flags[1][0] == 4
            assert data[0] == (4 if text else 9)
            found[name[1].decode()] = np.frombuffer(data[1], "<u2" if text else "<f8").reshape(size, order="F")
        i = np.arange(3 * part, min(3 * part + 3, 5))
        np.testing.assert_allclose(found["timestamps"], i[None] / 10)
        np.testing.assert_array_equal(found["values"], np.stack([i, -i], 1))
        assert ["".join(map(chr, r)).rstrip() for r in found["channels"]] == ["a", "long"]
