"""Frames to draw, as queries: a live view asks for them again after each batch."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import Signal
from .blocks import carried

#: The cue that each marker shows or hides.
CUES = {
    "Stimulus/S  5": "show_cross",
    "Stimulus/S  8": "show_right_arrow",
    "Stimulus/S  7": "show_left_arrow",
    "Stimulus/S  9": "hide_arrow",
    "Stimulus/S 10": "hide_cross",
    "Stimulus/S 12": "exit",
}


def plot_window(s: Signal, duration: float = 10.0) -> Signal:
    """The last ``duration`` seconds of each recording, with ``x``: the place in a view that is overwritten in turn."""
    ends = s.df.groupBy("rec").agg(F.max("t").alias("__end"), F.min("t").alias("__begin"))
    df = s.df.join(ends, "rec").where(F.col("t") > F.col("__end") - duration)
    return replace(s, df=df.select(*s.keys, (F.pmod(F.col("t") - F.col("__begin"), F.lit(duration))).alias("x"), *s.channels))


def graz_state(markers: DataFrame, cues: dict[str, str] = CUES) -> DataFrame:
    """(rec, mseq, t, cross, arrow, ended): what is to be seen after each marker."""
    cue = F.lit(None).cast("string")
    for marker, what in cues.items():
        cue = F.when(F.col("marker") == marker, what).otherwise(cue)
    rows = markers.withColumn("__cue", cue)
    shown = {
        "cross": F.when(F.col("__cue") == "show_cross", 1).when(F.col("__cue") == "hide_cross", 0),
        "arrow": F.when(F.col("__cue") == "show_right_arrow", "right").when(F.col("__cue") == "show_left_arrow", "left").when(F.col("__cue") == "hide_arrow", "none"),
        "ended": F.when(F.col("__cue") == "exit", 1),
    }
    found = carried(rows, "rec", "t", ["mseq"], shown)
    return found.select("rec", "mseq", "t", F.coalesce("cross", F.lit(0)).alias("cross"), F.coalesce("arrow", F.lit("none")).alias("arrow"), F.coalesce("ended", F.lit(0)).alias("ended"))
