"""Sources of streams: a socket server that sends frames in pieces, and a recording played again."""

import socket
import struct
import threading
import time

import numpy as np
import pytest

from sigspark.sources import brainvision, live, rda

START = struct.pack("<Ld2d", 2, 4000.0, 1.0, 1.0) + b"left\0right\0"


def message(kind: int, body: bytes) -> bytes:
    return struct.pack(rda.HEAD, b"i" * 16, rda.HEAD_SIZE + len(body), kind) + body


def data(block: int, values: np.ndarray, mark: tuple[int, str] | None = None) -> bytes:
    body = struct.pack("<LLL", block, len(values), 1 if mark else 0) + values.astype("<f4").tobytes()
    if mark:
        text = b"Stimulus\0" + mark[1].encode() + b"\0"
        body += struct.pack("<LLLl", 16 + len(text), mark[0], 1, -1) + text
    return message(rda.DATA, body)


class Recorder:
    """Sends the start message to whoever connects, then what ``say`` is given, to the last one that came."""

    def __init__(self):
        self.server = socket.create_server(("127.0.0.1", 0))
        self.port, self.client, self.came = self.server.getsockname()[1], None, 0
        threading.Thread(target=self._serve, daemon=True).start()

    def _serve(self):
        while True:
            try:
                client, _ = self.server.accept()
            except OSError:
                return
            client.sendall(message(rda.START, START))
            self.client, self.came = client, self.came + 1

    def say(self, raw: bytes):
        self.client.sendall(raw)

    def close(self):
        self.server.close()


@pytest.fixture
def recorder():
    r = Recorder()
    yield r
    r.close()


def wait_for(what, seconds=90):
    until = time.time() + seconds
    while not what():
        assert time.time() < until
        time.sleep(0.1)


def blocks():
    values = np.arange(60, dtype="<f4").reshape(30, 2)
    return values, [data(i, values[5 * i : 5 * i + 5], (i % 5, f"S {i}") if i != 2 else None) for i in range(6)]


def test_socket_in_three_batches_and_a_restart(spark, recorder, tmp_path):
    values, frames = blocks()
    start = live.announced(recorder.port, "127.0.0.1")
    assert (start.fs, start.names) == (250.0, ("left", "right"))
    seen = recorder.came

    def keep(batch, number):
        signal, markers = live.rda_signal(batch, start, offset=0.5)
        # A batch that was stopped half way is run again, and replaces what it left.
        signal.df.write.mode("overwrite").parquet(f"{tmp_path}/signal/batch={number}")
        markers.write.mode("overwrite").parquet(f"{tmp_path}/markers/batch={number}")

    def begun():
        messages = live.rda_messages(spark, recorder.port, f"{tmp_path}/spool", "127.0.0.1", "r")
        return messages.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="100 milliseconds").start()

    def there():
        try:
            return spark.read.parquet(f"{tmp_path}/signal").count()
        except Exception:
            return 0

    query = begun()
    wait_for(lambda: recorder.came > seen)
    recorder.say(frames[0] + frames[1][:20])  # a frame that comes in part
    wait_for(lambda: there() == 5)
    recorder.say(frames[1][20:] + frames[2])
    wait_for(lambda: there() == 15)
    query.processAllAvailable()
    query.stop()
    seen = recorder.came
    query = begun()
    wait_for(lambda: recorder.came > seen)
    recorder.say(frames[3] + frames[4] + frames[5])
    wait_for(lambda: there() == 30)
    query.processAllAvailable()
    query.stop()

    got = spark.read.parquet(f"{tmp_path}/signal").orderBy("seq").toPandas()
    assert got["seq"].tolist() == list(range(30)) and got["batch"].nunique() >= 3
    np.testing.assert_array_equal(got[["left", "right"]], values)
    whole, marks = rda.read_rda(spark.createDataFrame([("r", bytearray(f)) for f in frames], "rec string, message binary"), start, 0.5)
    want = whole.df.orderBy("seq").toPandas()
    since = got["t"].iloc[0] - want["t"].iloc[0]
    assert abs(since - time.time()) < 600
    np.testing.assert_allclose(got["t"] - since, want["t"], atol=1e-5)
    a, b = (sorted((r.marker, round(r.t - d, 5)) for r in x.collect()) for x, d in ((spark.read.parquet(f"{tmp_path}/markers"), since), (marks, 0)))
    assert [m for m, _ in a] == [m for m, _ in b]
    np.testing.assert_allclose([t for _, t in a], [t for _, t in b], atol=2e-5)


def reader(recorder, tmp_path):
    return live.RdaReader({"port": str(recorder.port), "host": "127.0.0.1", "spool": f"{tmp_path}/spool", "rec": "r", "wait": "0.5"})


def test_what_was_received_before_a_failure_comes_again(recorder, tmp_path):
    _, frames = blocks()
    one = reader(recorder, tmp_path)
    assert one.read(one.initialOffset())[1] == one.initialOffset()  # nothing has come yet
    recorder.say(frames[0] + frames[1])
    rows, end = one.read(one.initialOffset())
    rows = list(rows)
    assert [r[1:3] for r in rows] == [(0, 0), (1, 5)] and (end["messages"], end["samples"], end["block"]) == (2, 10, 1)
    two = reader(recorder, tmp_path)  # a new driver: the offset was never logged
    again, same = two.read(two.initialOffset())
    assert list(again) == rows and same == end and two.connection is None
    assert list(two.readBetweenOffsets(two.initialOffset(), end)) == rows
    two.commit(end)
    assert two.spool.files() == []


def test_a_lost_block_resets_the_clock(recorder, tmp_path):
    _, frames = blocks()
    r = reader(recorder, tmp_path)
    r.read(r.initialOffset())
    recorder.say(frames[0] + frames[1])
    _, at = r.read(r.initialOffset())
    time.sleep(0.3)
    recorder.say(frames[3] + frames[4])
    rows, end = r.read(at)
    third, fourth = list(rows)
    assert third[2] == 10 and third[3] > at["clock"] + 0.25  # samples are numbered on, times are not
    assert abs(fourth[3] - third[3] - 5 / 250) < 1e-6 and end["samples"] == 20


def test_replay(spark, tmp_path):
    values = np.arange(-90, 90, dtype="<i2").reshape(60, 3)
    values.tofile(tmp_path / "one.eeg")
    (tmp_path / "one.vmrk").write_text("[Marker Infos]\nMk1=New Segment,,1,1,0\nMk2=Stimulus,S\\1 1,11,1,0\nMk3=Stimulus,S  2,43,1,0\nMk4=Stimulus,end,61,1,0\n")
    (tmp_path / "one.vhdr").write_text(
        "[Common Infos]\nDataFile=$b.eeg\nMarkerFile=one.vmrk\nDataFormat=BINARY\nDataOrientation=MULTIPLEXED\nNumberOfChannels=3\nSamplingInterval=2000\n"
        "[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=a,,0.5,µV\nCh2=b,,1,mV\nCh3=c,,,\n"
    )
    path = str(tmp_path / "one.vhdr")
    signal, markers = live.replay(spark, path, chunk=25, block=10, tasks=2)
    seen = {}

    def played(df, name):
        query = df.writeStream.foreachBatch(lambda b, n: seen.setdefault(name, []).append(b.toPandas())).option("checkpointLocation", f"{tmp_path}/{name}").trigger(processingTime="50 milliseconds").start()
        query.processAllAvailable()
        query.stop()
        return [b for b in seen[name] if len(b)]

    batches, marks = played(signal.df, "s"), played(markers, "m")
    assert [sorted(b["seq"]) for b in batches] == [list(range(25)), list(range(25, 50)), list(range(50, 60))]
    assert [sorted(b["mseq"]) for b in marks] == [[0, 1], [2], [3]]
    import pandas as pd

    got = pd.concat(batches).sort_values("seq", ignore_index=True)
    want = brainvision.read_signal(spark, path).df.orderBy("seq").toPandas()
    pd.testing.assert_frame_equal(got[["rec", "seq", "t", "a", "b", "c"]], want, check_dtype=False)
    told = [(r.mseq, r.t, r.marker) for r in pd.concat(marks).sort_values("mseq").itertuples()]
    assert told == [(r.mseq, r.t, r.marker) for r in brainvision.read_markers(spark, path).orderBy("mseq").collect()]
    played(signal.df, "s")  # from the checkpoint: nothing comes twice
    assert sum(map(len, seen["s"])) == 60


def test_replay_in_its_own_time(tmp_path):
    np.zeros((500, 1), "<i2").tofile(tmp_path / "x.eeg")
    (tmp_path / "x.vhdr").write_text("[Common Infos]\nDataFile=x.eeg\nNumberOfChannels=1\nSamplingInterval=2000\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=a,,1,V\n")
    r = live.ReplayReader({"path": str(tmp_path / "x.vhdr"), "rec": "x", "chunk": "1", "block": "1000", "speed": "2.0"})
    _, at = r.read(r.initialOffset())
    time.sleep(0.2)
    _, at = r.read(at)
    assert 150 <= at["sample"] <= 400  # 0.2 s at 2 * 500 samples a second
    time.sleep(0.5)
    assert r.read(at)[1] == {"sample": 500}
