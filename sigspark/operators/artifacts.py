"""Template subtraction for gradient and pulse artifacts.

Both templates are means over earlier cycles at the same phase of the cycle, so both are window functions over
(recording, phase) in the order of cycles: a phase's rows, not a recording's, are what a task sorts.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.filters import butter_bandpass, from_coefficients
from ..shared import kept
from ..spec import Signal
from .iir import zero_phase
from .joins import latest


def start_of(s: Signal, markers: DataFrame | None, start_marker: str | None) -> DataFrame:
    """(rec, __start: seq of the first sample at or after the first start marker, __since: its or the sample's time)."""
    first = s.df.groupBy("rec").agg(F.min("seq").alias("__start"), F.min("t").alias("__since"))
    if markers is None or start_marker is None:
        return first
    gate = markers.where(F.col("marker") == start_marker).groupBy("rec").agg(F.min("t").alias("__since"))
    return s.df.select("rec", "seq", "t").join(gate, "rec").where("t >= __since").groupBy("rec").agg(F.min("seq").alias("__start"), F.first("__since").alias("__since"))


def gradient_correction(s: Signal, markers: DataFrame | None = None, start_marker: str | None = None, min_wins: int = 7, max_wins: int = 30, tr: float = 1.26) -> tuple[Signal, DataFrame]:
    """(corrected signal, markers). A volume has int(tr * fs) samples; from the volume ``min_wins`` on, each sample
    loses the mean of the last ``max_wins`` volumes at its place, its own included. Rows before the start pass."""
    s.need("signal")
    size = int(tr * s.fs)
    starts = start_of(s, markers, start_marker)
    df = s.df.join(starts, "rec", "left")
    j = F.col("seq") - F.col("__start")
    inside = F.coalesce(j >= 0, F.lit(False))
    df = df.withColumns({"__w": F.when(inside, F.floor(j / size)), "__p": F.when(inside, j % size)})
    # Rows before the start get a phase each, so that they don't meet in one window.
    df = df.withColumn("__p", F.when(inside, F.col("__p")).otherwise(-1 - F.col("seq") % size))
    mean = Window.partitionBy("rec", "__p").orderBy("__w").rowsBetween(1 - max_wins, 0)
    late = F.coalesce(F.col("__w") >= min_wins - 1, F.lit(False))
    corrected = replace(s, df=df).project({c: F.when(late, v - F.avg(v).over(mean)).otherwise(v) for c, v in s.values().items()})
    building = starts.select("rec", F.col("__since").alias("t"), F.lit("Start of GA building").alias("marker"))
    subtracting = s.df.select("rec", "seq", "t").join(starts, "rec").where(F.col("seq") == F.col("__start") + (min_wins - 1) * size).select("rec", "t", F.lit("Start of GA subtraction").alias("marker"))
    return corrected, building.unionByName(subtracting)


class PeakDetector:
    """Two bidirectional LSTM layers and a dense one, in NumPy; many windows go through at once.

    ``weights``: arrays named w{h,x}{f,i,l,o}{1,2}{f,b} and b{f,i,l,o}{1,2}{f,b} (gates: forget, input, candidate,
    output), wd, bd, and the numbers u (units) and t (samples of a window).
    """

    def __init__(self, weights: dict):
        self.weights, self.units, self.length = weights, int(weights["u"]), int(weights["t"])

    def _layer(self, x: np.ndarray, layer: str, way: str) -> np.ndarray:
        w, (m, n, _) = self.weights, x.shape
        name = layer + way
        wx = np.hstack([w[f"wx{g}{name}"] for g in "filo"])
        wh = np.hstack([w[f"wh{g}{name}"] for g in "filo"])
        bias = np.hstack([np.ravel(w[f"b{g}{name}"]) for g in "filo"])
        u, h, c = self.units, np.zeros((m, self.units)), np.zeros((m, self.units))
        fed, out = x @ wx + bias, np.empty((m, n, self.units))
        sig = lambda v: 1 / (1 + np.exp(-v))
        for k in range(n) if way == "f" else range(n - 1, -1, -1):
            g = fed[:, k] + h @ wh
            c = c * sig(g[:, :u]) + sig(g[:, u : 2 * u]) * np.tanh(g[:, 2 * u : 3 * u])
            h = np.tanh(c) * sig(g[:, 3 * u :])
            out[:, k] = h
        return out

    def predict(self, windows: np.ndarray) -> np.ndarray:
        """Peak probabilities (windows x samples) of windows scaled to [-1, 1]."""
        x = windows[:, :, None]
        for layer in "12":
            x = np.concatenate([self._layer(x, layer, "f"), self._layer(x, layer, "b")], axis=2)
        return 1 / (1 + np.exp(-(x @ self.weights["wd"] + self.weights["bd"])))[:, :, 0]


def scale_window(x: np.ndarray, low: float = -1.0, high: float = 1.0) -> np.ndarray:
    """A window scaled to [low, high]; a flat one lies in the middle."""
    span = x.max() - x.min()
    return (x - x.min()) * (high - low) / span + low if span else np.full_like(x, (low + high) / 2)


def snapped(ecg: np.ndarray, places: np.ndarray, radius: int = 5) -> np.ndarray:
    """Each place moved to the first largest value within ``radius``."""
    return np.array([max(0, p - radius) + int(np.argmax(ecg[max(0, p - radius) : p + radius + 1])) for p in places], dtype=int)


def pruned(places: np.ndarray, scores: np.ndarray, least: int) -> np.ndarray:
    """Of places less than ``least`` after the first of their cluster, the likeliest one."""
    kept, cluster = [], []
    for p in places.tolist():
        if cluster and p - cluster[0] >= least:
            kept.append(max(cluster, key=lambda q: (scores[q], -q)))
            cluster = []
        cluster.append(p)
    return np.array(kept + ([max(cluster, key=lambda q: (scores[q], -q))] if cluster else []), dtype=int)


def peaks_of(ecg: np.ndarray, scores: np.ndarray, threshold: float, least: int, hits: int = 5) -> np.ndarray:
    places, counts = np.unique(snapped(ecg, np.flatnonzero(scores > threshold)), return_counts=True)
    return pruned(places[counts >= hits], scores, least)


def r_peaks(s: Signal, ecg: str, detector: PeakDetector, stride: int = 50, min_hc: float = 0.4, threshold: float = 0.05) -> DataFrame:
    """(rec, seq) of the peaks that are final: those in a window's first ``stride`` samples.

    Windows begin every ``stride`` samples. They are laid over the samples by an explode and judged on their own;
    a sample's probability is the mean over the windows so far that hold it.
    """
    s.need("signal")
    length, least = detector.length, round(min_hc * s.fs)
    first = s.df.groupBy("rec").agg(F.min("seq").alias("__first"), F.max("seq").alias("__last"))
    d = F.sequence(F.greatest(F.floor((F.col("__j") - length) / stride) + 1, F.lit(0)), F.floor(F.col("__j") / stride))
    rows = s.df.select("rec", "seq", F.col(f"`{ecg}`").cast("float").alias("x")).join(first, "rec").withColumn("__j", F.col("seq") - F.col("__first"))
    rows = rows.withColumn("d", F.explode(d)).where(F.col("d") * stride + length <= F.col("__last") - F.col("__first"))
    whole = rows.groupBy("rec", "d").agg(F.array_sort(F.collect_list(F.struct("seq", "x"))).alias("w")).where(F.size("w") == length)
    windows = whole.select("rec", "d", F.col("w")[0]["seq"].alias("begin"), F.col("w.x").alias("x"))

    @F.pandas_udf("array<double>")
    def judge(xs: pd.Series) -> pd.Series:
        if not len(xs):
            return pd.Series([], dtype=object)
        scaled = np.stack([scale_window(np.asarray(x, np.float32)) for x in xs])
        return pd.Series(list(detector.predict(scaled.astype(np.float64))))

    judged = windows.withColumn("p", judge("x"))
    parts = -(-length // stride)
    # A window takes part in the means of the windows after it that overlap it.
    others = judged.select("rec", F.explode(F.sequence(F.col("d"), F.col("d") + parts - 1)).alias("at"), "d", "begin", F.when(F.col("d") == F.col("at"), F.col("x")).alias("x"), "p")
    others = others.withColumn("at", F.col("at").cast("bigint"))
    own = [F.max(F.when(F.col("d") == F.col("at"), F.col(c))).alias(c) for c in ("begin", "x")]
    spread = others.groupBy("rec", "at").agg(*own, F.array_sort(F.collect_list(F.struct("d", "p"))).alias("w")).where("begin IS NOT NULL")

    @F.pandas_udf("array<bigint>")
    def decide(ats: pd.Series, xs: pd.Series, ds: pd.Series, ps: pd.Series) -> pd.Series:
        out = []
        for at, x, d, p in zip(ats, xs, ds, ps, strict=True):
            total, count = np.zeros(length), np.zeros(length)
            for one, scores in zip(d, p, strict=True):
                shift = (int(at) - int(one)) * stride
                total[: length - shift] += np.asarray(scores)[shift:]
                count[: length - shift] += 1
            found = peaks_of(np.asarray(x), total / count, threshold, least)
            out.append(found[found < stride])
        return pd.Series(out, dtype=object)

    found = spread.withColumn("found", decide("at", "x", F.col("w.d"), F.col("w.p")))
    return found.select("rec", "begin", F.explode("found").alias("at")).select("rec", (F.col("at") + F.col("begin")).alias("seq"))


def ecg_of(channels: tuple[str, ...]) -> str:
    """The first channel named ECG or EKG, in capitals or not."""
    found = [c for c in channels if c.upper() in ("ECG", "EKG")]
    if not found:
        raise ValueError("no channel is named ECG or EKG")
    return found[0]


def _cycles(s: Signal, peaks: DataFrame, min_wins: int, max_wins: int, max_hc: float) -> tuple[DataFrame, Column, WindowSpec]:
    """Rows with their heart cycle and place in it, whether enough cycles reach that place, and the cycles' window."""
    longest = round(max_hc * s.fs)
    numbered = peaks.select("rec", F.col("seq").alias("peak"), F.col("seq").cast("double").alias("t"), F.row_number().over(Window.partitionBy("rec").orderBy("seq")).alias("cycle"))
    rows = latest(s.df.withColumn("__t", F.col("t")).withColumn("t", F.col("seq").cast("double")), numbered, 16.0 * longest, "__peak")
    place = F.col("seq") - F.col("__peak.peak")
    inside = F.coalesce(place < longest, F.lit(False))
    rows = rows.withColumns({"t": F.col("__t"), "__cycle": F.col("__peak.cycle"), "__p": F.when(inside, place).otherwise(-1 - F.col("seq") % longest)})
    over = Window.partitionBy("rec", "__p").orderBy("__cycle").rangeBetween(1 - max_wins, 0)
    return rows, (F.col("__p") >= 0) & (F.count(F.lit(1)).over(over) > min_wins), over


def pulse_correction(s: Signal, ecg: str, peaks: DataFrame, min_wins: int = 10, max_wins: int = 20, max_hc: float = 1.5, all_channels: bool = False) -> Signal:
    """Each sample less the mean of the last ``max_wins`` heart cycles at its place after the R peak, if more than
    ``min_wins`` cycles reach that place. Only channels before the ECG change, unless ``all_channels``.

    ``peaks``: (rec, seq) of R peaks. Places of ``max_hc`` seconds and later, and those before the first peak, pass.
    """
    s.need("signal")
    rows, enough, over = _cycles(s, peaks, min_wins, max_wins, max_hc)
    changing = [c for c in s.channels if c != ecg] if all_channels else list(s.channels)[: list(s.channels).index(ecg)]
    return replace(s, df=rows).project({c: F.when(enough, v - F.avg(v).over(over)).otherwise(v) if c in changing else v for c, v in s.values().items()})


def pulse_artifact(
    s: Signal, detector: PeakDetector, markers: DataFrame | None = None, start_marker: str | None = "Start of GA subtraction", ecg: str | None = None, stride: int = 50,
    min_wins: int = 10, max_wins: int = 20, min_hc: float = 0.4, max_hc: float = 1.5, threshold: float = 0.05, filter_ecg: bool = False, all_channels: bool = False,
) -> tuple[Signal, DataFrame]:
    """(corrected signal, markers) from detection to subtraction, from the first start marker on; samples before pass.

    ``filter_ecg`` lets the detector hear 0.5 to 30 Hz, filtered without phase over the whole recording. Markers are
    (rec, t, marker): ``Start of R peak detection``, ``R peak fixed`` for each final peak, and ``Start of PA
    subtraction``. Peaks are written to the shared folder when this is called, so that the detector runs once.
    """
    s.need("signal")
    ecg = ecg or ecg_of(s.channels)
    starts = start_of(s, markers, start_marker)
    heard = s.project({ecg: F.col(f"`{ecg}`")})
    if filter_ecg:
        heard = zero_phase(heard, from_coefficients(*butter_bandpass(4, 0.5, 30.0, s.fs)))
    gated = replace(heard, df=heard.df.join(starts.select("rec", "__start"), "rec").where(F.col("seq") >= F.col("__start")).drop("__start"))
    peaks = kept(r_peaks(gated, ecg, detector, stride, min_hc, threshold), "peaks")
    corrected = pulse_correction(s, ecg, peaks, min_wins, max_wins, max_hc, all_channels)
    rows, enough, _ = _cycles(s, peaks, min_wins, max_wins, max_hc)
    named = lambda df, name: df.select("rec", "t", F.lit(name).alias("marker"))
    times = s.df.select("rec", "seq", "t")
    detecting = times.join(starts, "rec").groupBy("rec").agg(F.min_by("t", F.when(F.col("seq") >= F.col("__start"), F.col("seq"))).alias("t"), (F.max("seq") - F.min("__start")).alias("n")).where(F.col("n") >= detector.length)
    subtracting = rows.withColumn("__on", enough).where("__on").groupBy("rec").agg(F.min_by("t", "seq").alias("t"))
    out = named(detecting, "Start of R peak detection").unionByName(named(times.join(peaks, ["rec", "seq"]), "R peak fixed"))
    return corrected, out.unionByName(named(subtracting, "Start of PA subtraction"))
