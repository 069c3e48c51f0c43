"""Generated signals over ranges, tables and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.sources import generator, tables


def test_a_stream_gives_what_the_range_gives(spark, tmp_path):
    for kind in ("random", "oscillator", "simulation"):
        s = generator.stream(spark, kind, 2, 100.0, start=3.0, seed=5, per_batch=40, tasks=2)
        name = f"made_{kind}"
        for _ in range(2):  # the second run goes on from the checkpoint
            query = s.df.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/c_{name}").trigger(availableNow=True).start()
            query.awaitTermination(120)
        got = spark.read.parquet(f"{tmp_path}/{name}").orderBy("seq").toPandas()
        n = len(got)
        assert n >= 40 and got["seq"].tolist() == list(range(n))
        want = generator.generate(spark, kind, 2, 100.0, n, start=3.0, seed=5).df.orderBy("seq").toPandas()
        np.testing.assert_allclose(got[["t", "Ch1", "Ch2"]], want[["t", "Ch1", "Ch2"]], atol=1e-9)


def test_drawn_values(spark):
    x = generator.generate(spark, "random", 2, 100.0, 5000).df.agg(F.min("Ch1"), F.max("Ch1"), F.avg("Ch1"), F.corr("Ch1", "Ch2")).first()
    assert -10 <= x[0] < -9.9 and 9.9 < x[1] < 10 and abs(x[2]) < 0.4 and abs(x[3]) < 0.05
    with pytest.raises(ValueError):
        generator.generate(spark, "other", 1, 100.0, 1)


def test_on_times_of_a_table(spark, sf_dir):
    s = tables.event_signal(spark, sf_dir)
    made = generator.on_times(s, "oscillator", 1)
    assert made.channels == ("Ch1",) and made.fs == s.fs and made.df.count() == s.df.count()
