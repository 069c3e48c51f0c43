"""Batch tools around recordings: markers in text form, trimming, volume markers, file names, training windows."""

from __future__ import annotations

from dataclasses import replace
from itertools import product
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..spec import Signal
from .blocks import BLOCK


def marker_code(marker: Column) -> Column:
    """A recorder's marker as a number: its last three characters if it ends in a digit, else 13 for Sync. Others, and
    those that begin with New, are null."""
    digits = F.regexp_extract(F.right(marker, F.lit(3)), "([0-9]+)$", 1)
    return F.when(marker.startswith("New"), None).when(marker.rlike("[0-9]$"), digits.cast("int")).when(marker.startswith("Sync"), 13)


def limits_by_markers(markers: DataFrame, first: str, last: str, before: float = 0.0, after: float = 0.0, from_last: int = 1) -> DataFrame:
    """(rec, begin, until): times of the first marker ``first`` and of the ``from_last``-th last marker ``last``."""
    begin = markers.where(F.col("marker") == first).groupBy("rec").agg((F.min("t") + before).alias("begin"))
    nth = F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("t"), F.desc("mseq"))) if from_last > 1 else None
    ends = markers.where(F.col("marker") == last)
    until = ends.groupBy("rec").agg((F.max("t") + after).alias("until")) if nth is None else ends.withColumn("__n", nth).where(F.col("__n") == from_last).select("rec", (F.col("t") + after).alias("until"))
    return begin.join(until, "rec")


def limits_by_place(s: Signal, low: int, high: int) -> DataFrame:
    """(rec, begin, until): times of the samples numbered ``low`` and ``high``, or of the ends of shorter recordings."""
    return s.df.where(F.col("seq").between(low, high)).groupBy("rec").agg(F.min("t").alias("begin"), F.max("t").alias("until"))


def limits_by_time(s: Signal, low: float, high: float) -> DataFrame:
    """(rec, begin, until): the same times for each recording."""
    return s.df.select("rec").distinct().select("rec", F.lit(float(low)).alias("begin"), F.lit(float(high)).alias("until"))


def trim(s: Signal, limits: DataFrame) -> Signal:
    """The samples within the limits, both included, with time and places from 0."""
    inside = s.df.join(limits, "rec").where((F.col("t") >= F.col("begin")) & (F.col("t") <= F.col("until")))
    origin = inside.groupBy("rec").agg(F.min("seq").alias("__seq"), F.min("t").alias("__t"))
    df = inside.join(origin, "rec").select("rec", (F.col("seq") - F.col("__seq")).alias("seq"), (F.col("t") - F.col("__t")).alias("t"), *[F.col(f"`{c}`") for c in s.channels])
    return replace(s, df=df)


def trim_marks(s: Signal, markers: DataFrame, limits: DataFrame) -> DataFrame:
    """The markers (rec, mseq, t, marker) within the limits, numbered anew, with times from the first sample that is kept."""
    origin = s.df.join(limits, "rec").where((F.col("t") >= F.col("begin")) & (F.col("t") <= F.col("until"))).groupBy("rec").agg(F.min("t").alias("__t"))
    inside = markers.join(limits, "rec").where((F.col("t") >= F.col("begin")) & (F.col("t") <= F.col("until"))).join(origin, "rec")
    nth = (F.row_number().over(Window.partitionBy("rec").orderBy("t", "mseq")) - 1).cast("bigint")
    return inside.select("rec", nth.alias("mseq"), (F.col("t") - F.col("__t")).alias("t"), "marker")


def trim_by_markers(s: Signal, markers: DataFrame, first: str, last: str, before: float = 0.0, after: float = 0.0, from_last: int = 1) -> Signal:
    """From the first marker ``first`` to the last (or ``from_last``-th last) marker ``last``, both included."""
    return trim(s, limits_by_markers(markers, first, last, before, after, from_last))


def slopes(s: Signal, block: int = BLOCK) -> DataFrame:
    """(rec, seq, v: the first channel, slope a millisecond of the mean of all channels but the last; a sole channel counts).

    Neighbours are found within blocks of samples; the samples at a block's ends go to the next block, too.
    """
    heard = list(s.values().values())[: max(1, len(s.channels) - 1)]
    own = F.floor(F.col("seq") / block)
    blocks = F.filter(F.array(own, F.when(F.col("seq") % block == 0, own - 1), F.when(F.col("seq") % block == block - 1, own + 1)), lambda b: b.isNotNull())
    rows = s.df.select("rec", "seq", (sum(heard) / len(heard)).alias("m"), heard[0].alias("v"), F.explode(blocks).alias("__block"))
    by = Window.partitionBy("rec", "__block").orderBy("seq")
    near = lambda f, d: F.when(f("seq").over(by) == F.col("seq") + d, f("m").over(by))
    rows = rows.withColumns({"before": near(F.lag, -1), "after": near(F.lead, 1)}).where(F.col("__block") == own)
    steps = F.when(F.col("before").isNull() | F.col("after").isNull(), 1).otherwise(2)
    return rows.select("rec", "seq", "v", ((F.coalesce("after", "m") - F.coalesce("before", "m")) / steps / (1000 / s.fs)).alias("slope"))


def volume_markers(s: Signal, threshold: float, tr: float, gap: float = 1 / 60, spread: int = 10, off: int = 100, dummies: int = 2) -> DataFrame:
    """(rec, seq) of volume onsets: places with a slope beyond ``threshold`` after the longest gaps shorter than ``tr * gap``
    seconds, about ``tr`` apart, without the first ``dummies``.

    The last onset goes if the first channel's greatest value in the second half of the volume behind it is less than
    half of that in half a volume before it. Only steep places are sorted by recording.
    """
    return onsets(s, [threshold], tr, gap, spread, off, dummies).select("rec", "seq")


def onsets(s: Signal, thresholds: list[float], tr: float, gap: float = 1 / 60, spread: int = 10, off: int = 100, dummies: int = 2) -> DataFrame:
    """(rec, nth: of the thresholds, from 0, seq) of ``volume_markers`` for each threshold; slopes are found once."""
    places = slopes(s)
    tried = F.posexplode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("nth", "threshold")
    steep = places.where(F.abs("slope") > min(thresholds)).select("rec", "seq", "slope", tried).where(F.abs("slope") > F.col("threshold"))
    by = Window.partitionBy("rec", "nth").orderBy("seq")
    gaps = steep.select("rec", "nth", "seq", (F.col("seq") - F.lag("seq").over(by)).alias("gap"))
    longest = gaps.where(F.col("gap") < tr * gap * s.fs).groupBy("rec", "nth").agg(F.max("gap").alias("longest"))
    found = gaps.join(longest, ["rec", "nth"]).where((F.col("gap") >= F.col("longest") - spread) & (F.col("gap") < tr * gap * s.fs)).select("rec", "nth", "seq")

    volume = tr * s.fs
    ends = found.groupBy("rec", "nth").agg(F.max("seq").alias("__z"))
    bounds = s.df.groupBy("rec").agg(F.min("seq").alias("__a"), F.max("seq").alias("__b"))
    ends = ends.join(bounds, "rec").where((F.col("__a") - F.col("__z") <= -volume / 2) & (F.col("__b") - F.col("__z") >= volume))
    place = F.col("seq") - F.col("__z")
    around = s.df.select("rec", "seq", next(iter(s.values().values())).alias("v")).join(ends, "rec").where(place.between(-volume / 2, volume))
    sides = around.groupBy("rec", "nth", "__z").agg(F.max(F.when(place.between(-volume / 2, -1), F.col("v"))).alias("pre"), F.max(F.when(place.between(volume / 2 + 1, volume), F.col("v"))).alias("post"))
    quiet = sides.where(F.col("post") < 0.5 * F.col("pre")).select("rec", "nth", F.col("__z").alias("seq"))
    found = found.join(quiet, ["rec", "nth", "seq"], "left_anti").select("rec", "nth", "seq", F.lead("seq").over(by).alias("next"))
    whole = found.where(F.col("next").isNull() | (F.abs(F.col("next") - F.col("seq") - volume) < off))
    return whole.withColumn("__n", F.row_number().over(by)).where(F.col("__n") > dummies).select("rec", "nth", "seq")


def accepted_volumes(s: Signal, thresholds: list[float], tr: float, expected: int, tolerance: int, **options) -> DataFrame:
    """(rec, threshold, seq): for each recording the onsets by the first threshold that finds ``expected`` volumes, give
    or take less than ``tolerance``; none for recordings where no threshold does. A last volume that is cut off goes."""
    found = onsets(s, thresholds, tr, **options)
    fitting = found.groupBy("rec", "nth").agg(F.count(F.lit(1)).alias("n")).where(F.abs(F.col("n") - expected) < tolerance).groupBy("rec").agg(F.min("nth").alias("nth"))
    last = s.df.groupBy("rec").agg(F.max("seq").alias("__last"))
    threshold = F.element_at(F.array(*[F.lit(float(x)) for x in thresholds]), F.col("nth") + 1).alias("threshold")
    return found.join(fitting, ["rec", "nth"]).join(last, "rec").where(F.col("seq") + tr * s.fs - 1 <= F.col("__last")).select("rec", threshold, "seq")


def heart_rate(peaks: DataFrame, s: Signal) -> DataFrame:
    """Beats a minute of each recording."""
    length = s.df.groupBy("rec").agg(F.count(F.lit(1)).alias("n"))
    return peaks.groupBy("rec").agg(F.count(F.lit(1)).alias("beats")).join(length, "rec").select("rec", (60 * F.col("beats") / (F.col("n") / s.fs)).alias("bpm"))


def detection_quality(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision and accuracy of probabilities ``p`` against 0/1 ``label``."""
    hit = (F.col("p") > threshold).cast("int")
    return rows.agg(
        (F.sum(hit * F.col("label")) / F.nullif(F.sum(hit), F.lit(0))).alias("precision"),
        F.avg((hit == F.col("label")).cast("int")).alias("accuracy"),
    )


def name_pairs(name: Column) -> Column:
    """The key-value pairs of a file name such as sub-01_task-rest_run-2, as a map."""
    keys = F.regexp_extract_all(name, F.lit(r"([A-Za-z]+)-([A-Za-z0-9]+)"), F.lit(1))
    values = F.regexp_extract_all(name, F.lit(r"([A-Za-z]+)-([A-Za-z0-9]+)"), F.lit(2))
    return F.map_from_arrays(keys, values)


def pick_files(files: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Files (``name``) whose pairs have one of the wanted values for every wanted key; numbers without leading zeros."""
    pairs = files.withColumn("__p", name_pairs(F.col("name")))
    plain = lambda c: F.regexp_replace(c, "^0+(?=[0-9])", "")
    for key, values in wanted.items():
        pairs = pairs.where(plain(F.col("__p")[key]).isin([v.lstrip("0") or "0" for v in map(str, values)]))
    return pairs.drop("__p")


def wanted_names(spark: SparkSession, template: str, *words: list[str]) -> DataFrame:
    """(name) ``template`` filled with each combination of the words, for a semi-join with a table of files."""
    return spark.createDataFrame([(template.format(*w),) for w in product(*words)], "name string")


def peak_labels(s: Signal, markers: DataFrame, marker: str = "QRSi") -> Signal:
    """The signal with a channel ``label``: 1 at the samples that carry the marker, by number (``seq``), else 0."""
    hits = markers.where(F.col("marker") == marker).select("rec", "seq").distinct().withColumn("label", F.lit(1.0))
    both = replace(s, df=s.df.join(hits, ["rec", "seq"], "left"))
    return both.project({**s.values(), "label": F.coalesce("label", F.lit(0.0))})


def closest_factors(n: int) -> tuple[int, int]:
    """The two factors of ``n`` that lie closest together, the smaller one first: steps of a long decimation."""
    low = next(k for k in range(isqrt(n), 0, -1) if n % k == 0)
    return low, n // low


def renumber_runs(files: DataFrame) -> DataFrame:
    """``new_name`` with runs numbered from 1 within each name before ``run``, in the order of their old numbers."""
    prefix = F.regexp_extract("name", r"^(.*?)_?run-[0-9]+", 1)
    run = F.regexp_extract("name", r"run-([0-9]+)", 1).cast("int")
    nth = F.row_number().over(Window.partitionBy(prefix).orderBy(run, "name"))
    return files.withColumn("new_name", F.regexp_replace("name", F.lit(r"run-[0-9]+"), F.concat(F.lit("run-"), F.lpad(nth.cast("string"), 2, "0"))))


def training_windows(s: Signal, channel: str, peaks: DataFrame, length: int, share: float, seed: int = 1, dilate: int = 2) -> DataFrame:
    """(rec, start, seq, x, label): windows drawn by their start that hold a peak; values scaled to [-1, 1], labels 1 within
    ``dilate`` samples of a peak. A start is drawn if the first 8 digits of the MD5 of ``seed:rec:seq``, modulo a
    million, lie below ``share`` of it."""
    from .joins import between

    named = F.concat_ws(":", F.lit(str(seed)), F.col("rec").cast("string"), F.col("seq").cast("string"))
    mark = F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("bigint")
    drawn = s.df.where(mark % 1_000_000 < int(share * 1_000_000)).select("rec", F.col("seq").cast("double").alias("begin"), (F.col("seq") + length).cast("double").alias("end"), F.col("seq").alias("start"))
    near = peaks.select("rec", F.explode(F.sequence(F.col("seq") - dilate, F.col("seq") + dilate)).alias("seq")).distinct().withColumn("label", F.lit(1))
    rows = s.df.select("rec", "seq", F.col("seq").cast("double").alias("t"), F.col(f"`{channel}`").alias("v")).join(near, ["rec", "seq"], "left")
    inside = between(rows, drawn, float(length)).select("rec", "start", "seq", "v", F.coalesce("label", F.lit(0)).alias("label"))
    ends = inside.groupBy("rec", "start").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).alias("n"), F.max("label").alias("any")).where((F.col("n") == length) & (F.col("any") == 1))
    return inside.join(ends, ["rec", "start"]).select("rec", "start", "seq", (2 * (F.col("v") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0)) - 1).alias("x"), "label")
