"""Joins on time, spread over blocks of time so that no recording has to fit one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(left: DataFrame, right: DataFrame, width: float, name: str = "found") -> DataFrame:
    """Backward as-of join: every row of ``left`` with a struct ``name`` of the last row of ``right`` of its
    recording at or before its time, null without one.

    Both have ``rec`` and ``t``. Time is cut into blocks of ``width``. Within a block both sides are sorted
    together; from before a block comes the last row of an earlier block, found among one row a block. Of
    several right rows at one time the largest row wins.
    """
    block = F.floor(F.col("t") / width)
    payload = F.struct("t", *[c for c in right.columns if c not in ("rec", "t")])
    marks = right.select("rec", "t", block.alias("__block"), payload.alias("__found"))
    rows = left.withColumn("__block", block)
    last = marks.groupBy("rec", "__block").agg(F.max("__found").alias("__last"))
    blocks = rows.select("rec", "__block").distinct().join(last, ["rec", "__block"], "full")
    before = Window.partitionBy("rec").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("rec", "__block", F.last("__last", ignorenulls=True).over(before).alias("__carried"))

    both = rows.select("rec", "t", "__block", F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(marks.schema["__found"].dataType).alias("__found")).unionByName(
        marks.select("rec", "t", "__block", F.lit(0).alias("__side"), F.lit(None).cast(rows.select(F.struct(*left.columns).alias("r")).schema["r"].dataType).alias("__row"), "__found")
    )
    upto = Window.partitionBy("rec", "__block").orderBy("t", "__side", "__found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("__here", F.last("__found", ignorenulls=True).over(upto)).where("__side = 1")
    return seen.join(carried, ["rec", "__block"], "left").select("__row.*", F.coalesce("__here", "__carried").alias(name))


def nearest(left: DataFrame, right: DataFrame, width: float, name: str = "found") -> DataFrame:
    """Every row of ``left`` with the row of ``right`` nearest in time; of two as near the later."""
    back = latest(left, right, width, "__before")
    turned = right.withColumn("t", -F.col("t"))
    ahead = latest(back.withColumn("t", -F.col("t")), turned, width, "__after").withColumn("t", -F.col("t"))
    after = F.col("__after").withField("t", -F.col("__after.t"))
    closer = F.col("__after").isNull() | (F.col("t") - F.col("__before.t") < -F.col("__after.t") - F.col("t"))
    return ahead.select(*left.columns, F.when(F.col("__before").isNotNull() & closer, F.col("__before")).otherwise(after).alias(name))


def between(left: DataFrame, right: DataFrame, width: float) -> DataFrame:
    """Range join: rows of ``left`` (rec, t, ...) with each row of ``right`` (rec, begin, end, ...) that holds
    ``begin <= t < end``. A right row goes to the blocks of ``width`` that it meets, and joins there by equality.
    """
    spread = right.withColumn("__block", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor(F.col("end") / width))))
    rows = left.withColumn("__block", F.floor(F.col("t") / width))
    return rows.join(spread, ["rec", "__block"]).where("t >= begin AND t < end").drop("__block")
