"""Numbers and carried values along a recording, without one task for a recording.

A recording of n rows is cut along its time into n / ``BLOCK`` parts of equal duration (one, if it is short). Rows are
sorted within a part; between parts goes one row a part: how many rows it has, or the last values it saw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def _same(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``a`` with the columns of ``b``, which has one row for each ``by``; null keys meet null keys."""
    renamed = b.select(*[F.col(c).alias(f"__{c}") for c in by], *[c for c in b.columns if c not in by])
    on = [a[c].eqNullSafe(renamed[f"__{c}"]) for c in by]
    return a.join(renamed, on, how).drop(*[f"__{c}" for c in by])


def in_blocks(df: DataFrame, by: str, time: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``__block``: parts of each recording that rise with its time. Rows without a time lie in the first."""
    bounds = df.groupBy(by).agg(F.min(time).cast("double").alias("__a"), F.max(time).cast("double").alias("__b"), F.ceil(F.count(F.lit(1)) / block).alias("__n"))
    rows = _same(df, bounds, [by])
    share = F.when(F.col("__b") > F.col("__a"), (F.col(time).cast("double") - F.col("__a")) / (F.col("__b") - F.col("__a")) * F.col("__n"))
    share = F.nanvl(F.coalesce(share, F.lit(0.0)), F.lit(0.0))
    return rows.withColumn("__block", F.least(F.floor(share), F.col("__n") - 1)).drop("__a", "__b", "__n")


def numbered(df: DataFrame, by: str, time: str, order: list[str] | None = None, block: int = BLOCK, name: str = "seq") -> DataFrame:
    """``df`` with ``name``: each row's number from 0 in its recording, by ``time`` and then ``order``."""
    rows = in_blocks(df, by, time, block)
    earlier = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(by, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(by, "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(by, "__block").orderBy(time, *(order or [])))
    found = _same(rows, before, [by, "__block"]).withColumn(name, (F.col("__before") + nth - 1).cast("bigint"))
    return found.drop("__block", "__before")


def carried(df: DataFrame, by: str, time: str, order: list[str], values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """``df`` with, for each of ``values``, the last one that is not null up to each row, by ``time`` and ``order``."""
    rows = in_blocks(df, by, time, block).withColumns({f"__{n}": v for n, v in values.items()})
    place = F.struct(time, *order)
    last = rows.groupBy(by, "__block").agg(*[F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), place)).alias(f"__{n}") for n in values])
    earlier = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(by, "__block", *[F.last(f"__{n}", ignorenulls=True).over(earlier).alias(f"__before_{n}") for n in values])
    upto = Window.partitionBy(by, "__block").orderBy(time, *order).rowsBetween(Window.unboundedPreceding, 0)
    found = _same(rows, before, [by, "__block"])
    found = found.withColumns({n: F.coalesce(F.last(f"__{n}", ignorenulls=True).over(upto), F.col(f"__before_{n}")) for n in values})
    return found.select(*df.columns, *values)
