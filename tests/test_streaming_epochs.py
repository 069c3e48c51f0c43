"""Sliding epochs, nested ones, statistics and as-of joins over streams, against the batch operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigspark.operators import epochs, joins, stats
from sigspark.spec import Signal
from sigspark.streaming import epochs as live

from .test_streaming_artifacts import SHAPE, beats, cut, run, store, stream_of  # noqa: F401


@pytest.mark.parametrize("triggers", [1, 4])
def test_sliding_epochs(spark, tmp_path, triggers):
    frame = pd.concat([beats(400).assign(t=lambda x: x["t"] + 0.37), beats(150, 5).assign(rec="s", t=lambda x: np.where(x["seq"] < 70, x["t"], x["t"] + 3))])
    frame.loc[frame.index % 17 == 0, "a"] = np.nan
    parts = [pd.concat(p) for p in zip(*[cut(g, triggers, i) for i, (_, g) in enumerate(frame.groupby("rec"))], strict=True)]
    s = Signal(stream_of(spark, tmp_path / "in", parts), ("a", "ecg"), 250.0)
    batch = Signal(spark.createDataFrame(frame, SHAPE), ("a", "ecg"), 250.0)
    outer = live.gathered_epochs(s, 0.4, 0.1)
    rows, _ = run(outer.df, f"slides{triggers}", tmp_path)
    kept = Signal(spark.createDataFrame(rows, live.gathered_shape("string", ["a", "ecg"])), ("a", "ecg"), 250.0, "epoch", 10.0)
    want = epochs.time_epochs(batch, 0.4, 0.1)
    order = ["rec", "epoch_id", "seq"]
    got = live.samples_of(kept).df.toPandas().sort_values(order, ignore_index=True)
    pd.testing.assert_frame_equal(got, want.df.toPandas()[got.columns].sort_values(order, ignore_index=True), check_dtype=False)
    inner, want_inner = live.nested(kept, 0.1, 0.04), epochs.time_epochs(want, 0.1, 0.04)
    order = ["rec", "parent", "epoch_id", "seq"]
    got = live.samples_of(inner).df.toPandas().sort_values(order, ignore_index=True)
    pd.testing.assert_frame_equal(got, want_inner.df.toPandas()[got.columns].sort_values(order, ignore_index=True), check_dtype=False)
    if triggers > 1:
        return
    for stat, options in [(x, {}) for x in ("mean", "min", "max", "std", "range", "median")] + [("quantile", {"quantile": 0.3}), ("iqr", {"iqr_quantile": (0.2, 0.9)}), ("ttest_1samp", {"popmean": 0.1})]:
        got = live.epoch_stat(kept, stat, **options).df.toPandas().sort_values(["rec", "epoch_id"], ignore_index=True)
        found = stats.epoch_stat(want, stat, **options).df.toPandas().sort_values(["rec", "epoch_id"], ignore_index=True)
        pd.testing.assert_frame_equal(got, found[got.columns], check_dtype=False, rtol=1e-9, atol=1e-9)


def test_sliding_state_is_bounded(spark, tmp_path):
    s = Signal(stream_of(spark, tmp_path / "in", np.split(beats(2000), 20)), ("a", "ecg"), 250.0)
    _, query = run(live.gathered_epochs(s, 0.4, 0.4).df, "slides_bounded", tmp_path)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"] and p["numInputRows"]]
    assert len(kept) == 20 and max(kept) <= 4


def test_latest_over_streams(spark, tmp_path):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"rec": rng.choice(["r", "s"], 300), "t": np.round(rng.uniform(0, 40, 300), 2), "value": rng.normal(size=300)})
    marks = pd.DataFrame({"rec": rng.choice(["r", "s"], 60), "t": np.round(rng.uniform(5, 40, 60), 2), "stat": rng.normal(size=60), "of": rng.choice(["a", None], 60)})
    marks.loc[:5, ["rec", "t"]] = ["r", 20.0]
    ends = pd.DataFrame({"rec": ["r", "s"], "t": [1000.0, 1000.0]})

    def landed(df, shape, folder, parts):
        """In order of time, but by up to two seconds; then a row that moves the watermark, twice."""
        df = df.assign(at=df["t"] + rng.uniform(0, 2, len(df))).sort_values("at").drop(columns="at")
        for i, p in enumerate([*np.array_split(np.arange(len(df)), parts), None, None]):
            rows = df.iloc[p] if p is not None else ends.assign(t=ends["t"] + i).reindex(columns=df.columns)
            out = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), shape).withColumn("ts", F.timestamp_millis((F.col("t") * 1000).cast("bigint")))
            out.coalesce(1).write.parquet(f"{folder}/{i}")
        return spark.readStream.schema(out.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")

    a, b = "rec string, t double, value double", "rec string, t double, stat double, of string"
    out = live.latest(landed(frame, a, tmp_path / "left", 5), landed(marks, b, tmp_path / "right", 5), "12 seconds", "x")
    query = out.writeStream.format("memory").queryName("asof").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(600)
    told = lambda df: sorted((r.rec, r.t, r.value, str(r.x)) for r in df.collect() if r.t < 1000)
    clean = lambda df, shape: spark.createDataFrame(df.astype(object).where(df.notna(), None), shape)
    want = told(joins.latest(clean(frame, a), clean(marks, b), 10.0, "x"))
    assert told(spark.table("asof")) == want and any(x[3] != "None" for x in want) and any(x[3] == "None" for x in want)
    with pytest.raises(ValueError):
        live.latest(spark.table("asof").withColumn("ts", F.current_timestamp()), spark.table("asof").withColumn("ts", F.current_timestamp()), "1 second")


def test_no_p_value_without_spread(spark):
    values = {0: [0.1, 0.1, 0.1], 1: [0.2, 0.3, 0.4], 2: [0.7], 3: [None, float("nan")], 4: [0.5, 0.5, None]}
    samples = [("r", k, 0.0, 1.0, "x", i, float(i), v) for k, vs in values.items() for i, v in enumerate(vs)]
    want = Signal(spark.createDataFrame(samples, "rec string, epoch_id bigint, epoch_start double, epoch_end double, label string, seq bigint, t double, a double"), ("a",), 1.0, "epoch")
    gathered = [("r", k, 0.0, 1.0, "x", list(range(len(vs))), [float(i) for i in range(len(vs))], vs) for k, vs in values.items()]
    kept = Signal(spark.createDataFrame(gathered, "rec string, epoch_id bigint, epoch_start double, epoch_end double, label string, seq array<bigint>, t array<double>, a array<double>"), ("a",), 1.0, "epoch")
    for found in (stats.epoch_stat(want, "ttest_1samp", popmean=0.5), live.epoch_stat(kept, "ttest_1samp", popmean=0.5)):
        assert {r.epoch_id: r.a and round(r.a, 6) for r in found.df.collect()} == {0: None, 1: 0.03709, 2: None, 3: None, 4: None}
