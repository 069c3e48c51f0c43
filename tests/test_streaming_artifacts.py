"""Artifact correction, detection and down-sampling over streams, against batch results and plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigspark.operators import artifacts, iir
from sigspark.plans.signals import small_detector
from sigspark.spec import Signal
from sigspark.streaming import artifacts as live

SHAPE = "rec string, seq bigint, t double, a double, ecg double"


@pytest.fixture(autouse=True)
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def beats(n: int, seed: int = 3) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    ecg = rng.normal(0, 0.05, n)
    for p in range(20, n, 45):
        ecg[p] += 3 + rng.normal(0, 0.1)
    a = rng.normal(0, 1, n) + np.roll(ecg, 3) * 2
    return pd.DataFrame({"rec": "r", "seq": np.arange(n), "t": np.arange(n) / 250, "a": a, "ecg": ecg})


def cut(frame: pd.DataFrame, triggers: int, seed: int = 1) -> list[pd.DataFrame]:
    """Uneven parts of consecutive rows, each shuffled."""
    rng = np.random.default_rng(seed)
    at = np.sort(rng.choice(np.arange(1, len(frame)), triggers - 1, replace=False))
    return [p.sample(frac=1, random_state=1) for p in np.split(frame, at)]


def stream_of(spark, folder, parts: list[pd.DataFrame], shape: str = SHAPE):
    for i, p in enumerate(parts):
        spark.createDataFrame(p, shape).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def run(df, name, folder):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(600)
    return df.sparkSession.table(name).toPandas(), query


@pytest.mark.parametrize("triggers", [1, 3, 7])
def test_gradient_templates(spark, tmp_path, triggers):
    frame = pd.concat([beats(900), beats(300, 8).assign(rec="s")])
    parts = [pd.concat(p) for p in zip(*[cut(g, triggers, i) for i, (_, g) in enumerate(frame.groupby("rec"))], strict=True)]
    s = Signal(stream_of(spark, tmp_path / "in", parts), ("a", "ecg"), 250.0)
    rows, _ = run(live.gradient_rows(s, None, None, 3, 4, 37 / 250), f"ga{triggers}", tmp_path)
    batch, markers = artifacts.gradient_correction(Signal(spark.createDataFrame(frame, SHAPE), ("a", "ecg"), 250.0), None, None, 3, 4, 37 / 250)
    want = batch.df.toPandas().sort_values(["rec", "seq"])
    got = rows[rows["marker"].isna()].sort_values(["rec", "seq"])
    assert len(got) == len(want) == 1200
    np.testing.assert_allclose(got[["a", "ecg"]], want[["a", "ecg"]], atol=1e-9)
    told = lambda x: sorted((r.rec, r.marker, round(r.t, 6)) for r in x.itertuples())
    assert told(rows[rows["marker"].notna()]) == told(markers.toPandas())


def test_gradient_templates_behind_a_marker(spark, tmp_path):
    frame = beats(400)
    parts = cut(frame, 4)
    marks = pd.DataFrame({"rec": ["r", "r"], "t": [0.3001, 0.9], "marker": ["go", "go"]})
    spark.createDataFrame(marks, "rec string, t double, marker string").coalesce(1).write.parquet(f"{tmp_path}/marks/0")
    markers = spark.readStream.schema("rec string, t double, marker string").parquet(f"{tmp_path}/marks/*")
    s = Signal(stream_of(spark, tmp_path / "in", parts), ("a", "ecg"), 250.0)
    rows, _ = run(live.gradient_rows(s, markers, "go", 2, 3, 20 / 250), "gate", tmp_path)
    batch, told = artifacts.gradient_correction(Signal(spark.createDataFrame(frame, SHAPE), ("a", "ecg"), 250.0), spark.createDataFrame(marks.assign(mseq=[0, 1])), "go", 2, 3, 20 / 250)
    got, want = rows[rows["marker"].isna()].sort_values("seq"), batch.df.toPandas().sort_values("seq")
    np.testing.assert_allclose(got[["a", "ecg"]], want[["a", "ecg"]], atol=1e-9)
    assert sorted(rows.loc[rows["marker"].notna(), "t"].round(6)) == sorted(told.toPandas()["t"].round(6))


def test_gradient_state_is_bounded(spark, tmp_path):
    """The state's rows stop growing once ``max_wins`` volumes are there."""
    frame = beats(3000)
    s = Signal(stream_of(spark, tmp_path / "in", np.split(frame, 10)), ("a", "ecg"), 250.0)
    _, query = run(live.gradient_rows(s, None, None, 3, 4, 37 / 250), "bounded", tmp_path)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"] and p["numInputRows"]]
    assert len(kept) == 10 and max(kept) <= 1 + (4 + 1) + 1 and kept[2] == kept[-1]


def test_late_samples_pass_with_null_channels(spark, tmp_path):
    frame = beats(200)
    late = frame.iloc[10:12]
    s = Signal(stream_of(spark, tmp_path / "in", [frame.drop(late.index).iloc[:100], late, frame.iloc[102:]]), ("a", "ecg"), 250.0)
    rows, _ = run(live.gradient_rows(s, None, None, 2, 3, 20 / 250), "late", tmp_path)
    assert rows.loc[rows["a"].isna() & rows["marker"].isna(), "seq"].tolist() == [10, 11]


@pytest.mark.parametrize("triggers", [1, 3, 7])
def test_pulse_templates(spark, tmp_path, triggers):
    frame, d = beats(700), small_detector(60)
    options = {"stride": 10, "min_wins": 3, "max_wins": 5, "min_hc": 0.12, "max_hc": 0.16, "threshold": 0.05}
    s = Signal(stream_of(spark, tmp_path / "in", cut(frame, triggers)), ("a", "ecg"), 250.0)
    rows, _ = run(live.pulse_rows(s, d, None, None, **options), f"pa{triggers}", tmp_path)
    batch, markers = artifacts.pulse_artifact(Signal(spark.createDataFrame(frame, SHAPE), ("a", "ecg"), 250.0), d, None, None, **options)
    want, got = batch.df.toPandas().sort_values("seq"), rows[rows["marker"].isna()].sort_values("seq")
    assert got["seq"].tolist() == list(range(640))  # all but the last window
    np.testing.assert_allclose(got[["a", "ecg"]], want[["a", "ecg"]].iloc[: len(got)], atol=1e-9)
    assert (abs(got["a"].to_numpy() - frame["a"].to_numpy()[: len(got)]) > 1e-9).any()
    told = lambda x: sorted((r.marker, round(r.t, 6)) for r in x.itertuples() if r.t < 640 / 250)
    assert told(rows[rows["marker"].notna()]) == told(markers.toPandas())


def test_pulse_templates_that_lag_by_a_margin(spark, tmp_path):
    """Every sample once, and as a plain loop over windows with a copied template has it, for any cut."""
    frame, d = beats(500), small_detector(60)
    options = {"stride": 10, "min_wins": 2, "max_wins": 5, "min_hc": 0.12, "max_hc": 0.16, "threshold": 0.05, "margin": 12 / 250}
    found = []
    for triggers in (1, 5):
        s = Signal(stream_of(spark, tmp_path / f"in{triggers}", cut(frame, triggers)), ("a", "ecg"), 250.0)
        rows, _ = run(live.pulse_rows(s, d, None, None, **options), f"margin{triggers}", tmp_path / str(triggers))
        found.append(rows[rows["marker"].isna()].sort_values("seq"))
    assert found[0]["seq"].tolist() == list(range(38 + 44 * 10))  # hold limit 60 - 10 - 12, and a stride for each of 44 windows
    np.testing.assert_allclose(found[0][["a", "ecg"]], found[1][["a", "ecg"]], atol=1e-12)
    np.testing.assert_array_equal(found[0]["a"].iloc[:38], frame["a"].iloc[:38])

    a, ecg = frame["a"].to_numpy(), frame["ecg"].to_numpy().astype(np.float32)
    scores = {w: d.predict(artifacts.scale_window(ecg[w : w + 60])[None].astype(float))[0] for w in range(0, 440, 10)}
    fixed, want = [], a[:38].tolist()
    for w in range(0, 440, 10):
        mean = np.array([np.mean([scores[v][i - v] for v in scores if v <= w and v <= i < v + 60]) for i in range(w, w + 60)])
        here = artifacts.peaks_of(ecg[w : w + 60].astype(float), mean, 0.05, 30) + w
        fixed += [p for p in here if p < w + 10]
        peaks = fixed + [p for p in here if w + 10 <= p < w + 48]
        for i in range(w + 38, w + 48):
            cycle = max((k for k, p in enumerate(peaks) if p <= i), default=None)
            same = []
            if cycle is not None and i - peaks[cycle] < 40:
                place = i - peaks[cycle]
                for k in range(max(0, cycle - 4), cycle + 1):
                    j = peaks[k] + place
                    if j < (peaks[k + 1] if k + 1 < len(peaks) else w + 48):
                        same.append(a[j])
            want.append(a[i] - np.mean(same) if len(same) > 2 else a[i])
    np.testing.assert_allclose(found[0]["a"], want, atol=1e-9)


@pytest.mark.parametrize("triggers", [1, 6])
def test_downsampling_by_blocks(spark, tmp_path, triggers):
    frame = beats(1000)
    x = frame[["a", "ecg"]].to_numpy()
    s = Signal(stream_of(spark, tmp_path / "in", cut(frame, triggers)), ("a", "ecg"), 250.0)
    out = live.downsample(s, 3, block=100, halo=60)
    rows, _ = run(out.df, f"low{triggers}", tmp_path)
    got = rows.sort_values("seq")
    from sigspark.functions.filters import chebyshev_lowpass

    low, want = chebyshev_lowpass(8, 0.05, 0.8 / 3), {}
    for begin in range(0, 1000 - 160 + 1, 100):
        a, b = max(0, begin - 60), begin + 160
        part = np.r_[2 * x[a] - x[a + 27 : a : -1], x[a:b], 2 * x[b - 1] - x[b - 2 : b - 29 : -1]]
        for _ in range(2):
            part = low.run(part, np.outer(low.steady(), part[0]))[0][::-1]
        part = part[27:-27]
        want |= {i // 3: part[i - a] for i in range(begin, begin + 100) if i % 3 == 0}
    assert out.fs == 250.0 / 3 and got["seq"].tolist() == sorted(want)
    np.testing.assert_allclose(got[["a", "ecg"]], np.array([want[i] for i in sorted(want)]), atol=1e-10)
    np.testing.assert_allclose(got["t"], got["seq"] * 3 / 250)


def test_downsampling_is_close_to_the_whole_recording(spark, tmp_path):
    frame = beats(3000)
    s = Signal(stream_of(spark, tmp_path / "in", cut(frame, 3)), ("a", "ecg"), 250.0)
    rows, _ = run(live.downsample(s, 2).df, "near", tmp_path)
    want = iir.downsample(Signal(spark.createDataFrame(frame, SHAPE), ("a", "ecg"), 250.0), 2).df.orderBy("seq").toPandas()
    got = rows.sort_values("seq")
    assert len(got) > 1000
    np.testing.assert_allclose(got[["a", "ecg"]], want[["a", "ecg"]].iloc[: len(got)], atol=1e-6)
