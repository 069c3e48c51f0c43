"""Artifact templates, detection and down-sampling along an unbounded stream.

State is kept by recording with ``transformWithStateInPandas`` (the session needs a state store that has map state,
such as RocksDB): templates as maps of small blocks, of which a trigger reads and writes those that its samples touch.
Samples of a recording are numbered without gaps and come in order; those of one trigger are sorted, and one that comes
after a later one was handled passes with null channels. A marker that opens a gate has to come no later than
the samples it gates, as it does where one source gives both. Results don't depend on how a stream is cut into triggers.

Operators with two outputs give one frame of tagged rows, (rec, seq, t, marker, channels): samples have no ``marker``,
markers no ``seq``. ``parted`` makes the pair of it; a query that wants both runs on the tagged frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.filters import System, chebyshev_lowpass
from ..operators.artifacts import PeakDetector, ecg_of, peaks_of, scale_window
from ..operators.iir import PAD
from ..spec import Signal

#: Samples of a template that lie in one entry of a state map.
PIECE = 1024


def tagged(s: Signal, markers: DataFrame | None, start_marker: str | None) -> DataFrame:
    """Samples, and the markers that open the gate, as rows of one stream."""
    values = [v.cast("double").alias(c) for c, v in s.values().items()]
    rows = s.df.select("rec", "seq", "t", F.lit(None).cast("string").alias("marker"), *values)
    if markers is None or start_marker is None:
        return rows
    gates = markers.where(F.col("marker") == start_marker)
    return rows.unionByName(gates.select("rec", F.lit(None).cast("bigint").alias("seq"), "t", "marker", *[F.lit(None).cast("double").alias(c) for c in s.channels]))


def parted(s: Signal, rows: DataFrame) -> tuple[Signal, DataFrame]:
    """(signal, markers) of tagged rows."""
    return replace(s, df=rows.where("marker IS NULL").drop("marker")), rows.where("marker IS NOT NULL").select("rec", "t", "marker")


def shape_of(s: Signal) -> str:
    rec = s.df.schema["rec"].dataType.simpleString()
    return ", ".join([f"rec {rec}, seq bigint, t double, marker string", *[f"`{c}` double" for c in s.channels]])


@dataclass
class Gate:
    """Where a recording's samples begin to count: at its first one, or at the first after the earliest start marker."""

    gated: bool
    opened: float | None = None
    start: int | None = None
    last: int = -1

    def split(self, frame: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
        """(late samples, samples before the gate, samples to handle), each sorted; the gate moves on."""
        marks = frame.loc[frame["marker"].notna(), "t"]
        if self.start is None and len(marks):
            self.opened = min(marks.min(), self.opened if self.opened is not None else np.inf)
        rows = frame[frame["marker"].isna()].sort_values("seq", ignore_index=True)
        late = rows["seq"] <= self.last
        rows, late = rows[~late], rows[late]
        if not len(rows):
            return late, rows, rows
        self.last = int(rows["seq"].iloc[-1])
        if self.start is None and not self.gated:
            self.start, self.opened = int(rows["seq"].iloc[0]), float(rows["t"].iloc[0])
        elif self.start is None and self.opened is not None and (rows["t"] >= self.opened).any():
            self.start = int(rows["seq"][rows["t"] >= self.opened].iloc[0])
        counts = rows["seq"] >= self.start if self.start is not None else np.zeros(len(rows), bool)
        return late, rows[~counts], rows[counts]


class Pieces:
    """Arrays in a state map, by key; each is read once a trigger and written back at its end."""

    def __init__(self, state, rows: int, wide: int):
        self.state, self.rows, self.wide, self.held, self.gone = state, rows, wide, {}, set()

    def get(self, *key: int) -> np.ndarray:
        if key not in self.held:
            found = self.state.getValue(key) if self.state.containsKey(key) else None
            self.held[key] = np.frombuffer(found[0], np.float64).reshape(self.rows, self.wide).copy() if found else np.full((self.rows, self.wide), np.nan)
        return self.held[key]

    def drop(self, *key: int) -> None:
        self.held.pop(key, None)
        self.gone.add(key)

    def write(self) -> None:
        for key, x in self.held.items():
            self.state.updateValue(key, (x.tobytes(),))
        for key in self.gone - set(self.held):
            if self.state.containsKey(key):
                self.state.removeKey(key)


def blanked(late: pd.DataFrame, channels: list[str]) -> pd.DataFrame:
    late = late.copy()
    late[channels] = np.nan
    return late


def joined(parts: list[pd.DataFrame], names: list[str]) -> pd.DataFrame:
    parts = [p for p in parts if len(p)]
    out = pd.concat(parts, ignore_index=True)[names] if parts else pd.DataFrame({n: [] for n in names})
    return out.astype({"rec": object, "seq": "Int64", "t": "float64", "marker": object})


class GradientTemplate(StatefulProcessor):
    """The last volumes of a recording, and their sums at each place of a volume."""

    def __init__(self, channels: list[str], gated: bool, size: int, min_wins: int, max_wins: int):
        self.channels, self.gated, self.size, self.min_wins, self.max_wins = channels, gated, size, min_wins, max_wins

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.gate = handle.getValueState("gate", "opened double, start bigint, last bigint, subtracting boolean")
        self.volumes = handle.getMapState("volumes", "volume bigint, piece bigint", "x binary")
        self.sums = handle.getMapState("sums", "piece bigint", "x binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame, wide, names = pd.concat(list(rows)), len(self.channels), ["rec", "seq", "t", "marker", *self.channels]
        known = self.gate.get()
        opened, start, last, subtracting = known if known is not None else (None, None, -1, False)
        gate = Gate(self.gated, opened, start, last)
        late, before, samples = gate.split(frame)
        out = [blanked(late, self.channels), before]
        if start is None and gate.start is not None:
            out.append(pd.DataFrame({"rec": [key[0]], "seq": [None], "t": [gate.opened], "marker": ["Start of GA building"]} | {c: [np.nan] for c in self.channels}))
        if len(samples):
            volumes, sums = Pieces(self.volumes, min(PIECE, self.size), wide), Pieces(self.sums, min(PIECE, self.size), 2 * wide)
            x, j = samples[self.channels].to_numpy(np.float64), samples["seq"].to_numpy() - gate.start
            y, at = x.copy(), 0
            while at < len(j):
                volume, place = divmod(int(j[at]), self.size)
                piece, a = divmod(place, PIECE)
                end = min(PIECE, self.size - piece * PIECE)
                b = min(end, a + len(j) - at)
                y[at : at + b - a] = self._corrected(volumes, sums, volume, piece, a, b, x[at : at + b - a], b == end)
                if volume >= self.min_wins - 1 and not subtracting:
                    subtracting = True
                    out.append(pd.DataFrame({"rec": [key[0]], "seq": [None], "t": [float(samples["t"].iloc[at])], "marker": ["Start of GA subtraction"]} | {c: [np.nan] for c in self.channels}))
                at += b - a
            volumes.write()
            sums.write()
            out.append(samples.assign(**{c: y[:, i] for i, c in enumerate(self.channels)}))
        self.gate.update((gate.opened, gate.start, gate.last, subtracting))
        yield joined(out, names)

    def _corrected(self, volumes: Pieces, sums: Pieces, volume: int, piece: int, a: int, b: int, x: np.ndarray, whole: bool) -> np.ndarray:
        wide = len(self.channels)
        volumes.get(volume, piece)[a:b] = x
        held = sums.get(piece)
        if volume % (4 * self.max_wins) == 0:  # summed afresh now and then, so that rounding doesn't add up
            ring = np.stack([volumes.get(v, piece)[a:b] for v in range(max(0, volume - self.max_wins + 1), volume + 1)])
            held[a:b, :wide], held[a:b, wide:] = np.nansum(ring, 0), np.isfinite(ring).sum(0)
        else:
            old = volumes.get(volume - self.max_wins, piece)[a:b] if volume >= self.max_wins else np.full_like(x, np.nan)
            held[a:b, :wide] += np.nan_to_num(x) - np.nan_to_num(old)
            held[a:b, wide:] += np.isfinite(x).astype(float) - np.isfinite(old)
        if whole and volume >= self.max_wins:
            volumes.drop(volume - self.max_wins, piece)
        if volume < self.min_wins - 1:
            return x
        return x - held[a:b, :wide] / np.maximum(held[a:b, wide:], 1)

    def close(self) -> None:
        pass


def gradient_rows(s: Signal, markers: DataFrame | None = None, start_marker: str | None = None, min_wins: int = 7, max_wins: int = 30, tr: float = 1.26) -> DataFrame:
    """Tagged rows of ``operators.artifacts.gradient_correction`` over a stream; nulls don't count in a template.

    The state of a recording holds ``max_wins`` + 1 volumes and their sums, whatever its length.
    """
    s.need("signal")
    gated = markers is not None and start_marker is not None
    processor = GradientTemplate(list(s.channels), gated, int(tr * s.fs), min_wins, max_wins)
    return tagged(s, markers, start_marker).groupBy("rec").transformWithStateInPandas(processor, shape_of(s), "append", "None")


def gradient_correction(s: Signal, *args, **options) -> tuple[Signal, DataFrame]:
    return parted(s, gradient_rows(s, *args, **options))


class PulseTemplate(StatefulProcessor):
    """Detection over overlapping windows, and the last heart cycles of a recording.

    All samples from the next window's first on are held. Once one more sample than a window has come, the window
    is judged; its scores and those of earlier windows are averaged where they overlap. Peaks among its first
    ``stride`` samples are final, and so are the cycles of these samples, which then join the permanent template.
    """

    def __init__(self, channels, changing, ecg, gated, detector, stride, min_wins, max_wins, least, longest, threshold, margin):  # noqa: PLR0913
        self.channels, self.changing, self.ecg, self.gated, self.detector, self.stride = channels, changing, ecg, gated, detector, stride
        self.min_wins, self.max_wins, self.least, self.longest, self.threshold, self.margin = min_wins, max_wins, least, longest, threshold, margin

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "opened double, start bigint, last bigint, window bigint, peak bigint, cycle bigint, subtracting boolean")
        self.rows = handle.getValueState("rows", "x binary, total binary, count binary")
        self.cycles = handle.getMapState("cycles", "slot bigint", "x binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame, wide, length = pd.concat(list(rows)), len(self.channels), self.detector.length
        names, ecg = ["rec", "seq", "t", "marker", *self.channels], self.channels.index(self.ecg)
        known = self.at.get()
        opened, start, last, window, peak, cycle, subtracting = known if known is not None else (None, None, -1, 0, -1, -1, False)
        gate = Gate(self.gated, opened, start, last)
        late, before, samples = gate.split(frame)
        out, marks = [blanked(late, self.channels), before], []
        held, total, count = np.empty((0, wide + 1)), np.zeros(length), np.zeros(length)
        if kept := self.rows.get():
            held = np.frombuffer(kept[0], np.float64).reshape(-1, wide + 1)
            total, count = (np.frombuffer(x, np.float64).copy() for x in kept[1:])
        held = np.concatenate([held, samples[["t", *self.channels]].to_numpy(np.float64)])
        ring = Pieces(self.cycles, self.longest, wide + 1)
        while len(held) > length:
            first = gate.start + window * self.stride
            heard = held[:length, 1 + ecg].astype(np.float32)
            scores = self.detector.predict(scale_window(heard)[None].astype(np.float64))[0]
            total, count = np.append(total[self.stride :], np.zeros(self.stride)) * (window > 0) + scores, np.append(count[self.stride :], np.zeros(self.stride)) * (window > 0) + 1
            found = peaks_of(heard.astype(np.float64), total / count, self.threshold, self.least)
            if window == 0:
                marks.append((held[0, 0], "Start of R peak detection"))
            marks += [(held[i, 0], "R peak fixed") for i in found[found < self.stride]]
            y, on, peak, cycle = self._advanced(ring, held[: self.stride, 1:], first, found[found < self.stride], peak, cycle)
            if self.margin is None:
                begin = 0
            else:  # a copy of the template goes on with peaks that later windows may still move
                upto, begin = length - self.margin, length - self.margin - self.stride
                copy = Pieces(self.cycles, self.longest, wide + 1)
                copy.held = {k: x.copy() for k, x in ring.held.items()}
                more, on, *_ = self._advanced(copy, held[self.stride : upto, 1:], first + self.stride, found[(found >= self.stride) & (found < upto)] - self.stride, peak, cycle)
                y, on = more[begin - self.stride :], on[begin - self.stride :]
                if window == 0:
                    out.append(self._frame(key, gate.start, held[:begin, 0], held[:begin, 1:]))
            if on.any() and not subtracting:
                subtracting = True
                marks.append((held[begin + int(np.argmax(on)), 0], "Start of PA subtraction"))
            out.append(self._frame(key, first + begin, held[begin : begin + self.stride, 0], y))
            held, window = held[self.stride :], window + 1
        ring.write()
        self.rows.update((held.tobytes(), total.tobytes(), count.tobytes()))
        self.at.update((gate.opened, gate.start, gate.last, window, peak, cycle, subtracting))
        if marks:
            out.append(pd.DataFrame({"rec": key[0], "seq": None, "t": [t for t, _ in marks], "marker": [m for _, m in marks]} | {c: np.nan for c in self.channels}))
        yield joined(out, names)

    def _frame(self, key, first: int, t: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"rec": key[0], "seq": np.arange(first, first + len(t)), "t": t, "marker": None} | {c: x[:, i] for i, c in enumerate(self.channels)})

    def _advanced(self, ring: Pieces, x: np.ndarray, first: int, peaks: np.ndarray, peak: int, cycle: int):
        """(corrected samples, which ones were, last peak, its cycle) for samples from number ``first`` on."""
        y, on = x.copy(), np.zeros(len(x), bool)
        cuts = [0, *peaks.tolist(), len(x)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if k:
                peak, cycle = first + a, cycle + 1
                ring.get(cycle % self.max_wins)[:] = np.nan
            p = first + a - peak
            n = min(b - a, self.longest - p)
            if peak < 0 or n <= 0:
                continue
            ring.get(cycle % self.max_wins)[p : p + n] = np.hstack([x[a : a + n], np.ones((n, 1))])
            whole = np.stack([ring.get(c % self.max_wins)[p : p + n] for c in range(max(0, cycle - self.max_wins + 1), cycle + 1)])
            enough = np.isfinite(whole[:, :, -1]).sum(0) > self.min_wins
            values = whole[:, :, :-1]
            mean = np.nansum(values, 0) / np.maximum(np.isfinite(values).sum(0), 1)
            change = enough[:, None] & np.isin(self.channels, self.changing)[None]
            y[a : a + n] = np.where(change, x[a : a + n] - mean, x[a : a + n])
            on[a : a + n] = enough
        return y, on, peak, cycle

    def close(self) -> None:
        pass


def pulse_rows(
    s: Signal, detector: PeakDetector, markers: DataFrame | None = None, start_marker: str | None = "Start of GA subtraction", ecg: str | None = None, stride: int = 50,
    min_wins: int = 10, max_wins: int = 20, min_hc: float = 0.4, max_hc: float = 1.5, threshold: float = 0.05, all_channels: bool = False, margin: float | None = None,
) -> DataFrame:
    """Tagged rows of ``operators.artifacts.pulse_artifact`` over a stream.

    Without ``margin`` a sample is given out when its cycle is final: it lags by a window, and equals the batch
    result. With ``margin`` (seconds) it lags by that and up to ``stride`` samples: a provisional copy of the template, with
    peaks that later windows may still move, corrects it, and the first samples of a recording pass.
    The state of a recording holds a window, a trigger's rest, and ``max_wins`` cycles of ``max_hc`` seconds.
    """
    s.need("signal")
    ecg = ecg or ecg_of(s.channels)
    channels = list(s.channels)
    changing = [c for c in channels if c != ecg] if all_channels else channels[: channels.index(ecg)]
    gated = markers is not None and start_marker is not None
    lag = None if margin is None else round(margin * s.fs)
    processor = PulseTemplate(channels, changing, ecg, gated, detector, stride, min_wins, max_wins, round(min_hc * s.fs), round(max_hc * s.fs), threshold, lag)
    return tagged(s, markers, start_marker).groupBy("rec").transformWithStateInPandas(processor, shape_of(s), "append", "None")


def pulse_artifact(s: Signal, *args, **options) -> tuple[Signal, DataFrame]:
    return parted(s, pulse_rows(s, *args, **options))


def both_ways(system: System, x: np.ndarray) -> np.ndarray:
    """Filtered forwards and backwards, with ``PAD`` samples turned about either end."""
    x = np.concatenate([2 * x[:1] - x[PAD:0:-1], x, 2 * x[-1:] - x[-2 : -PAD - 2 : -1]])
    for _ in range(2):
        x = system.run(x, np.outer(system.steady(), x[0]))[0][::-1]
    return x[PAD:-PAD]


class Decimator(StatefulProcessor):
    """The samples that the next block of a recording still needs."""

    def __init__(self, channels: list[str], system: System, factor: int, block: int, halo: int):
        self.channels, self.system, self.factor, self.block, self.halo = channels, system, factor, block, halo

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "start bigint, last bigint, block bigint")
        self.rows = handle.getValueState("rows", "x binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        wide, names = len(self.channels), ["rec", "seq", "t", "marker", *self.channels]
        start, last, number = self.at.get() or (None, -1, 0)
        gate = Gate(False, None, start, last)
        _, _, samples = gate.split(pd.concat(list(rows)))
        held = np.frombuffer(kept[0], np.float64).reshape(-1, wide + 1) if (kept := self.rows.get()) else np.empty((0, wide + 1))
        held = np.concatenate([held, samples[["t", *self.channels]].to_numpy(np.float64)])
        out = []
        while len(held) >= (lead := min(self.halo, number * self.block)) + self.block + self.halo:
            y = both_ways(self.system, held[: lead + self.block + self.halo, 1:])[lead : lead + self.block]
            seq = gate.start + number * self.block + np.arange(self.block)
            at = np.flatnonzero(seq % self.factor == 0)
            out.append(pd.DataFrame({"rec": key[0], "seq": seq[at] // self.factor, "t": held[lead + at, 0], "marker": None} | {c: y[at, i] for i, c in enumerate(self.channels)}))
            number += 1
            held = held[lead + self.block - min(self.halo, number * self.block) :]
        self.rows.update((held.tobytes(),))
        self.at.update((gate.start, gate.last, number))
        yield joined(out, names)

    def close(self) -> None:
        pass


def downsample(s: Signal, factor: int, block: int | None = None, halo: int | None = None) -> Signal:
    """Every ``factor``-th sample behind the low-pass without phase of ``operators.iir.downsample``.

    The law: a recording is cut into blocks of ``block`` samples from its first one; each is filtered by itself, both
    ways, together with ``halo`` samples at either side (fewer at the recording's start), so it is given out ``halo``
    samples late. With the default halo of 128 * factor samples, noise is filtered as over the whole recording but for some 1e-8
    of its size. Late samples are
    dropped, and the last samples of a stream wait for a halo that doesn't come.
    """
    s.need("signal")
    block, halo = block or 512 * factor, 128 * factor if halo is None else halo
    if halo <= PAD:
        raise ValueError(f"a halo has more than {PAD} samples")
    processor = Decimator(list(s.channels), chebyshev_lowpass(8, 0.05, 0.8 / factor), factor, block, halo)
    rows = tagged(s, None, None).groupBy("rec").transformWithStateInPandas(processor, shape_of(s), "append", "None")
    return replace(s, df=rows.drop("marker"), fs=s.fs / factor)
