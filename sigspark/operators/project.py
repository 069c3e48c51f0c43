"""Projections over channels: all plain column expressions, so that scans read only what is asked for."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import Signal


def _named(s: Signal, mode: str, which) -> list[str]:
    if mode == "index":  # from 1
        return [s.channels[i - 1] for i in which]
    if mode == "name":
        missing = [c for c in which if c not in s.channels]
        if missing:
            raise ValueError(f"no channels {missing}")
        return list(which)
    raise ValueError("mode is index or name")


def select_channels(s: Signal, mode: str, selected: Sequence) -> Signal:
    """Channels by number, from 1, or by name."""
    return s.project({c: F.col(f"`{c}`") for c in _named(s, mode, selected)})


def spatial_filter(s: Signal, matrix: dict[str, Sequence[float]]) -> Signal:
    """Each output is a weighted sum of all channels; a null or NaN goes through."""
    if any(len(row) != len(s.channels) for row in matrix.values()):
        raise ValueError("a row of the matrix has another length than there are channels")
    inputs = list(s.values().values())
    return s.project({name: sum((c * float(w) for c, w in zip(inputs[1:], row[1:], strict=True)), inputs[0] * float(row[0])) for name, row in matrix.items()})


def read_matrix(path: str) -> dict[str, list[float]]:
    """A spatial filter from a yaml file (name: weights) or a settings file (weights by row, outputs, inputs)."""
    if path.endswith((".yaml", ".yml")):
        with open(path) as f:
            return {str(k): [float(x) for x in v] for k, v in yaml.safe_load(f).items()}
    values = [x.text.strip() for x in ET.parse(path).getroot().iter("SettingValue")]
    weights, outputs, inputs = [float(x) for x in values[0].split()], int(values[1]), int(values[2])
    return {f"Ch{i + 1}": weights[i * inputs : (i + 1) * inputs] for i in range(outputs)}


def reference_channel(s: Signal, mode: str, ref) -> Signal:
    """The other channels less the reference, which goes."""
    (name,) = _named(s, mode, [ref])
    return s.project({c: v - F.col(f"`{name}`") for c, v in s.values().items() if c != name})


def common_average_reference(s: Signal) -> Signal:
    """Each channel less the mean of the row's channels that have a value."""
    values = [F.nanvl(v, F.lit(None)) for v in s.values().values()]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values[1:]), F.coalesce(values[0], F.lit(0.0)))
    count = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
    mean = total / F.nullif(count, F.lit(0))
    return s.project({c: v - mean for c, v in s.values().items()})


def apply_function(s: Signal, function: Callable[..., Column], *args) -> Signal:
    """``function(column, *args)`` of each channel, a column expression."""
    return s.project({c: function(v, *args) for c, v in s.values().items()})


def apply_rows(s: Signal, function: Callable[..., np.ndarray], *args) -> Signal:
    """``function(row, *args)`` of each row's channels as an array, for functions that no expression can give."""
    channels = list(s.channels)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                frame[channels] = np.apply_along_axis(function, 1, frame[channels].to_numpy(np.float64), *args)
            yield frame

    df = s.df.select(*s.keys, *channels)
    return replace(s, df=df.mapInPandas(rows, df.schema))


def update_channels(s: Signal, other: Signal) -> Signal:
    """Channels of ``other`` take the place of those of the same name, where they have a value at the same sample."""
    shared = [c for c in other.channels if c in s.channels]
    right = other.df.select("rec", "seq", *[F.col(f"`{c}`").alias(f"__{c}") for c in shared])
    df = s.df.join(right, ["rec", "seq"], "left")
    values = {c: F.coalesce(F.nanvl(F.col(f"`__{c}`"), F.lit(None)), v) if c in shared else v for c, v in s.values().items()}
    return replace(s, df=df).project(values)


def change_below(s: Signal, base: float, percent: float) -> Signal:
    """1 where a value's change against ``base``, in percent, is below ``percent``; else 0."""
    return s.project({c: (((v / base - 1) * 100) < percent).cast("int") for c, v in s.values().items()})


def scaled(s: Signal, low: float = -1.0, high: float = 1.0) -> Signal:
    """Channels scaled to [low, high] by each recording's (or epoch's) least and largest value."""
    by = ["rec", "epoch_id"] if s.kind == "epoch" else ["rec"]
    ends = s.df.groupBy(*by).agg(*[f(F.col(f"`{c}`")).alias(f"__{n}_{c}") for c in s.channels for n, f in (("a", F.min), ("b", F.max))])
    span = lambda c: F.nullif(F.col(f"`__b_{c}`") - F.col(f"`__a_{c}`"), F.lit(0.0))
    return replace(s, df=s.df.join(ends, by)).project({c: (v - F.col(f"`__a_{c}`")) * (high - low) / span(c) + low for c, v in s.values().items()})


def read_electrodes(path: str) -> dict[str, tuple[float, float, float]]:
    """Electrode places on a sphere, by label: from a polar ``.loc`` table or a ``.ced`` table with X, Y and Z."""
    with open(path) as f:
        lines = [re.split(r"\t", line.rstrip("\n")) for line in f if line.strip()]
    if path.endswith(".ced"):
        head = [h.strip() for h in lines[0]]
        at = {h: head.index(h) for h in ("labels", "X", "Y", "Z")}
        return {r[at["labels"]].strip(): tuple(float(r[at[a]]) for a in "XYZ") for r in lines[1:]}
    out = {}
    for _, theta, radius, label in ([x.strip() for x in r if x.strip()] for r in lines):
        angle, tilt = np.deg2rad(float(theta)), np.pi * float(radius)  # radius 0.5 is the equator
        out[label] = (float(np.sin(tilt) * np.cos(angle)), float(-np.sin(tilt) * np.sin(angle)), float(np.cos(tilt)))
    return out


def laplacian_matrix(places: np.ndarray, order: int = 7, m: int = 4, smoothing: float = 1e-5) -> np.ndarray:
    """The spherical-spline surface Laplacian as one constant matrix."""
    n = len(places)
    if n > 100:
        order, m = 40, 3
    unit = places / np.sqrt((places**2).sum(1)).max()
    cosine = 1 - ((unit[:, None] - unit[None]) ** 2).sum(2) / 2
    np.fill_diagonal(cosine, 1.0)
    below, here, g, h = np.ones_like(cosine), cosine, np.zeros_like(cosine), np.zeros_like(cosine)
    for k in range(1, order + 1):
        weight = (2 * k + 1) / (4 * np.pi) / (k * (k + 1)) ** (m - 1)
        h += weight * here
        g += weight / (k * (k + 1)) * here
        below, here = here, ((2 * k + 1) * cosine * here - k * below) / (k + 1)  # Legendre's recurrence
    inverse = np.linalg.inv(g + smoothing * np.eye(n))
    sums = inverse.sum(0)
    return h @ (inverse - np.outer(inverse.sum(1), sums) / sums.sum())


def laplacian(s: Signal, electrodes: dict[str, tuple[float, float, float]], order: int = 7, m: int = 4, smoothing: float = 1e-5) -> Signal:
    """The surface Laplacian: a spatial filter by a matrix that is made once."""
    missing = [c for c in s.channels if c not in electrodes]
    if missing:
        raise ValueError(f"no places for {missing}")
    matrix = laplacian_matrix(np.array([electrodes[c] for c in s.channels], float), order, m, smoothing)
    return spatial_filter(s, dict(zip(s.channels, matrix.tolist(), strict=True)))
