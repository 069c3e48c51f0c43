"""Stimulus scenarios from an XML description: a table of markers with their times."""

from __future__ import annotations

import random
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class InvalidScenario(ValueError):
    """The description lacks something, or has a value that can't be read."""


#: The types of markers.
TYPES = {"float32": float, "string": str, "int32": int, "int16": int, "int8": int, "int64": int, "double64": float}


def _text(node: ET.Element, name: str) -> str:
    found = node.findtext(name)
    if found is None:
        raise InvalidScenario(f"<{node.tag}> has no <{name}>")
    return found.strip()


def read_scenario(xml: str) -> dict:
    """The description as a dict; ``xml`` is its text."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        raise InvalidScenario(f"no valid XML: {e}") from e

    def section(name: str) -> ET.Element:
        if (found := root.find(name)) is None:
            raise InvalidScenario(f"no <{name}>")
        return found

    info = section("info")
    kind = TYPES.get(_text(info, "marker_type"))
    if kind is None:
        raise InvalidScenario("unknown marker_type")

    def typed(value: str, convert=None):
        try:
            return (convert or kind)(value)
        except ValueError as e:
            raise InvalidScenario(str(e)) from e

    def steps(name: str) -> list[tuple]:
        out = []
        for step in section(name).findall("step"):
            label = _text(step, "name")
            ends = ("duration", "duration") if step.find("duration") is not None else ("min_duration", "max_duration")
            out.append((None if label == "Class" else typed(label), *(typed(_text(step, e), float) for e in ends)))
        return out

    flag = _text(info, "random")
    if flag not in ("True", "1", "False", "0"):
        raise InvalidScenario("random is True, 1, False or 0")
    return {
        "trials": typed(_text(info, "number_of_trials"), int),
        "sessions": typed(_text(info, "session"), int),
        "random": flag in ("True", "1"),
        "classes": [typed(_text(c, "name")) for c in section("classes").findall("class")],
    } | {name: steps(name) for name in ("init", "loop", "intersession", "end")}


def scenario(spark: SparkSession, described: dict, seed: int = 1) -> DataFrame:
    """(rec, mseq, t, marker). Blocks by class, or trials shuffled within each session."""
    rng = random.Random(seed)
    classes, trials, sessions = described["classes"], described["trials"], described["sessions"]
    if described["random"]:
        blocks = [rng.sample(classes * trials, len(classes) * trials) for _ in range(sessions)]
    else:
        blocks = [[classes[i % len(classes)]] * trials for i in range(len(classes) * sessions)]
    steps = [(s, None) for s in described["init"]]
    for i, block in enumerate(blocks):
        steps += [(s, c) for c in block for s in described["loop"]]
        if i < len(blocks) - 1:
            steps += [(s, block[-1]) for s in described["intersession"]]
    steps += [(s, None) for s in described["end"]]
    rows = [("scenario", i, str(c if name is None else name), low if low == high else rng.uniform(low, high)) for i, ((name, low, high), c) in enumerate(steps)]
    df = spark.createDataFrame(rows, "rec string, mseq bigint, marker string, duration double")
    before = Window.partitionBy("rec").orderBy("mseq").rowsBetween(Window.unboundedPreceding, -1)
    return df.select("rec", "mseq", F.coalesce(F.sum("duration").over(before), F.lit(0.0)).alias("t"), "marker")


def gated(markers: DataFrame, gate: DataFrame, start_marker: str) -> DataFrame:
    """A scenario that starts at the first marker of ``gate`` that matches the pattern."""
    begin = gate.where(F.col("marker").rlike(start_marker)).agg(F.min("t").alias("__t0"))  # one row
    return markers.crossJoin(F.broadcast(begin)).where("__t0 IS NOT NULL").withColumn("t", F.col("t") + F.col("__t0")).drop("__t0")
