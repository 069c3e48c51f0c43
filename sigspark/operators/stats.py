"""A number for each epoch and channel, and tapers over epochs."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.student import t_below
from ..spec import Signal

STATS = ("mean", "min", "max", "std", "range", "median", "quantile", "iqr", "ttest_1samp")


def epoch_stat(s: Signal, stat: str, quantile: float | None = None, iqr_quantile: tuple[float, float] | None = None, popmean: float | None = None) -> Signal:
    """One row an epoch, at the time of its last sample; values that are NaN or null don't count.

    ``ttest_1samp`` is the p-value of the one-sided test that the mean lies below ``popmean``; null where all values are equal.
    """
    s.need("epoch")
    if stat not in STATS:
        raise ValueError(f"{stat} is none of {', '.join(STATS)}")
    if stat == "quantile" and not (quantile is not None and 0 <= quantile <= 1):
        raise ValueError("a quantile between 0 and 1 is needed")
    if stat == "iqr" and not (iqr_quantile and 0 <= iqr_quantile[0] <= iqr_quantile[1] <= 1):
        raise ValueError("two rising quantiles between 0 and 1 are needed")
    if stat == "ttest_1samp" and popmean is None:
        raise ValueError("popmean is needed")

    def of(c: Column) -> Column:
        x = F.nanvl(c, F.lit(None))
        return {
            "mean": lambda: F.avg(x),
            "min": lambda: F.min(x),
            "max": lambda: F.max(x),
            "std": lambda: F.stddev_samp(x),
            "range": lambda: F.max(x) - F.min(x),
            "median": lambda: F.percentile(x, F.lit(0.5)),
            "quantile": lambda: F.percentile(x, F.lit(quantile)),
            "iqr": lambda: F.percentile(x, F.lit(iqr_quantile[1])) - F.percentile(x, F.lit(iqr_quantile[0])),
            "ttest_1samp": lambda: t_below((F.avg(x) - popmean) / (F.nullif(F.stddev_samp(x), F.lit(0.0)) / F.sqrt(F.count(x))), F.count(x) - 1),
        }[stat]()

    keys = [k for k in ("rec", "parent", "epoch_id", "label") if k in s.df.columns]
    df = s.df.groupBy(*keys).agg(F.max("t").alias("t"), *[of(v).alias(c) for c, v in s.values().items()])
    return replace(s, df=df, kind="signal", fs=s.epoch_fs or 0.0, epoch_fs=None)


def taper(kind: str, i: Column, n: Column) -> Column:
    """The weight of sample ``i`` (from 0) of ``n``."""
    turn = 2 * math.pi * i / (n - 1)
    middle = F.abs(2 * (i + 1) - (n + 1))
    found = {
        "hanning": 0.5 - 0.5 * F.cos(turn),
        "hamming": 0.54 - 0.46 * F.cos(turn),
        "blackman": 0.42 - 0.5 * F.cos(turn) + 0.08 * F.cos(2 * turn),
        "triang": 1 - middle / F.when(n % 2 == 1, n + 1).otherwise(n),
    }[kind]
    return F.when(n == 1, F.lit(1.0)).otherwise(found)


def windowing(s: Signal, kind: str) -> Signal:
    """Channels times a taper of the epoch's length."""
    s.need("epoch")
    by = [k for k in ("rec", "parent", "epoch_id") if k in s.df.columns]
    sizes = s.df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("seq").alias("__begin"))
    df = s.df.join(sizes, by)  # samples are numbered without gaps, so the place needs no sort
    weight = taper(kind, F.col("seq") - F.col("__begin"), F.col("__n"))
    return replace(s, df=df).project({c: v * weight for c, v in s.values().items()})
