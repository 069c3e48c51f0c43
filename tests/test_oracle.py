"""Every query that has SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(found: pd.DataFrame, wanted: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(wanted.columns)
    assert len(found) == len(wanted) > 0
    columns = sorted(found.columns)
    number = [c for c in columns if pd.api.types.is_float_dtype(wanted[c]) or pd.api.types.is_float_dtype(found[c])]
    exact = [c for c in columns if c not in number]
    order = exact + number
    a, b = (x[columns].sort_values(order, ignore_index=True) for x in (found, wanted))
    for c in exact:
        assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c
    for c in number:
        np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-6, atol=2e-6, err_msg=c)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    same(entry.queries()[name](spark, sf_dir).toPandas(), con.execute(entry.oracle_sql()[name]).df())


def dense(spark, sf_dir):
    from sigspark.sources import tables

    return tables.event_signal(spark, sf_dir).df.toPandas().sort_values(["rec", "seq"])


def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()


def envelopes(x):
    """The size of the analytic signal of each row, by the definition: negative frequencies dropped, positive ones doubled."""
    n = x.shape[1]
    f = np.fft.fft(x, axis=1)
    k = np.fft.fftfreq(n)
    return np.abs(np.fft.ifft(np.where(k > 0, 2 * f, np.where(k == 0, f, 0)) + np.where(k == -0.5, f, 0), axis=1))


@pytest.mark.parametrize("name", ["hilbert_time", "hilbert_channels"])
def test_envelopes(spark, sf_dir, name):
    e = embeddings(spark, sf_dir)
    want = dict(zip(e["vec_id"], envelopes(np.array(e["embedding"].tolist(), float)), strict=True))
    found = entry.queries()[name](spark, sf_dir).toPandas()
    if name == "hilbert_time":
        assert len(found) == 64 * len(e)
        for i, g in found.sort_values("seq").groupby("epoch_id"):
            np.testing.assert_allclose(g["x"], want[i], atol=2e-6)
    else:
        assert len(found) == len(e)
        np.testing.assert_allclose(found[[f"e{k}" for k in range(64)]], np.array([want[i] for i in found["seq"]]), atol=2e-6)


@pytest.mark.parametrize("name", ["lda_class", "lda_probability"])
def test_discriminants(spark, sf_dir, name):
    """Gaussian classes of one covariance, by their densities."""
    e = embeddings(spark, sf_dir)
    x, y = np.array(e["embedding"].tolist(), float), e["label"].to_numpy()
    kinds = np.unique(y)
    means = np.array([x[y == k].mean(0) for k in kinds])
    centred = x - means[np.searchsorted(kinds, y)]
    away = x[:, None] - means[None]
    fits = []
    for rows in (len(x), len(x) - len(kinds)):  # either divisor of the covariance
        inverse = np.linalg.pinv(centred.T @ centred / rows)
        fits.append(np.log([(y == k).mean() for k in kinds]) - 0.5 * np.einsum("nki,ij,nkj->nk", away, inverse, away))
    found = entry.queries()[name](spark, sf_dir).toPandas().set_index("seq").loc[e["vec_id"]]
    if name == "lda_class":
        assert max((kinds[f.argmax(1)].astype(str) == found["class"].astype(str).to_numpy()).mean() for f in fits) > 0.99
    else:
        p = found[[f"p_{k}" for k in kinds]].to_numpy(float)
        errors = [np.abs(p - np.exp(f - f.max(1, keepdims=True)) / np.exp(f - f.max(1, keepdims=True)).sum(1, keepdims=True)).max() for f in fits]
        assert min(errors) < 1e-3


def test_counted_out(spark, sf_dir):
    """Queries with neither SQL nor a plain version here still give rows of the kind they promise."""
    d = dense(spark, sf_dir)
    long = d.groupby("rec").size()
    down = entry.queries()["downsample"](spark, sf_dir).toPandas()
    assert len(down) == sum(-(-n // 2) for n in long if n > 27)
    windows = entry.queries()["training_windows"](spark, sf_dir)
    assert windows.count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_equal_values_have_no_p_value(spark, sf_dir, tmp_path):
    """Epochs whose values are all equal, as copies of one event make them."""
    rows = pd.read_parquet(f"{sf_dir}/events.parquet")
    copies = pd.concat([rows.assign(event_id=rows["event_id"] + i * (rows["event_id"].max() + 1)) for i in range(3)])
    spark.createDataFrame(copies, spark.read.parquet(f"{sf_dir}/events.parquet").schema).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    wanted = con.execute(entry.oracle_sql()["ttest_1samp"]).df()
    assert wanted["value"].isna().any() and wanted["value"].notna().any()
    same(entry.queries()["ttest_1samp"](spark, str(tmp_path)).toPandas(), wanted)
