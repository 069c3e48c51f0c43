"""Sliding epochs and as-of joins along an unbounded stream.

Epochs over streams come gathered, one row an epoch with arrays of its samples, as soon as a later sample exists. What
follows needs no state then: ``samples_of``, ``nested`` and ``epoch_stat`` are maps, of streams or of tables.
State is kept with ``transformWithStateInPandas``, in entries that a trigger adds or removes, never as one growing row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.student import below
from ..operators.stats import STATS
from ..spec import Signal


def gathered_shape(rec: str, channels: list[str], parent: bool = False) -> str:
    kept = ["parent bigint"] if parent else []
    return ", ".join([f"rec {rec}, epoch_id bigint, epoch_start double, epoch_end double, label string", *kept, "seq array<bigint>, t array<double>", *[f"`{c}` array<double>" for c in channels]])


def windows(t: np.ndarray, first: float, duration: float, interval: float) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last number of the windows that hold each time, as ``operators.epochs.windows_of`` has them."""
    return np.maximum(np.floor((t - first - duration) / interval).astype(np.int64) + 1, 0), np.floor((t - first) / interval).astype(np.int64)


def cut(seq: np.ndarray, t: np.ndarray, x: np.ndarray, first: float, last: float, k: int, duration: float, interval: float) -> tuple[list[tuple], int]:
    """(epochs that end before ``last``, from number ``k`` on; the next number). An epoch without samples is none."""
    low, high = windows(t, first, duration, interval)
    out = []
    while first + k * interval + duration < last:
        ahead = high >= k
        if not ahead.any():
            break
        inside = ahead & (low <= k)
        if inside.any():
            out.append((k, first + k * interval, first + k * interval + duration, seq[inside], t[inside], x[inside]))
            k += 1
        else:
            k = int(low[ahead].min())
    return out, k


class Slides(StatefulProcessor):
    """The samples of a recording that its next window may still hold, an entry for those of each trigger."""

    def __init__(self, channels: list[str], duration: float, interval: float):
        self.channels, self.duration, self.interval = channels, duration, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "first double, seq bigint, last double, number bigint, entries bigint, begin bigint")
        self.entries = handle.getMapState("entries", "entry bigint", "until double, x binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, seq, last, number, entries, begin = self.at.get() or (None, -1, 0.0, 0, 0, 0)
        frame = pd.concat(list(rows)).sort_values("seq")
        frame = frame[frame["seq"] > seq]  # late ones are dropped
        names = ["rec", "epoch_id", "epoch_start", "epoch_end", "label", "seq", "t", *self.channels]
        if not len(frame):
            return
        first = float(frame["t"].iloc[0]) if first is None else first
        seq, last = int(frame["seq"].iloc[-1]), max(last, float(frame["t"].max())) if entries else float(frame["t"].max())
        new = frame[["seq", "t", *self.channels]].to_numpy(np.float64)
        self.entries.updateValue((entries,), (float(frame["t"].max()), new.tobytes()))
        entries += 1
        found = []
        if first + number * self.interval + self.duration < last:  # an epoch closes: only now are entries read
            held = np.concatenate([np.frombuffer(self.entries.getValue((i,))[1], np.float64).reshape(-1, 2 + len(self.channels)) for i in range(begin, entries)])
            found, number = cut(held[:, 0].astype(np.int64), held[:, 1], held[:, 2:], first, last, number, self.duration, self.interval)
            while begin < entries and windows(np.array([self.entries.getValue((begin,))[0]]), first, self.duration, self.interval)[1][0] < number:
                self.entries.removeKey((begin,))
                begin += 1
        self.at.update((first, seq, last, number, entries, begin))
        if not found:
            return
        out = pd.DataFrame({"rec": [key[0]] * len(found), "epoch_id": [e[0] for e in found], "epoch_start": [e[1] for e in found], "epoch_end": [e[2] for e in found], "label": [None] * len(found), "seq": [e[3] for e in found], "t": [e[4] for e in found]})
        yield out.assign(**{c: [e[5][:, i] for e in found] for i, c in enumerate(self.channels)})[names].astype({"rec": object, "label": object})

    def close(self) -> None:
        pass


def gathered_epochs(s: Signal, duration: float, interval: float) -> Signal:
    """Sliding windows from each recording's first sample, as ``operators.epochs.time_epochs`` has them, one row each.

    Samples of a recording come in order, sorted within a trigger; late ones are dropped. The state of a recording is
    one window, whatever the cut into triggers.
    """
    s.need("signal")
    rec, channels = s.df.schema["rec"].dataType.simpleString(), list(s.channels)
    df = s.df.select("rec", "seq", "t", *[v.cast("double").alias(c) for c, v in s.values().items()])
    out = df.groupBy("rec").transformWithStateInPandas(Slides(channels, duration, interval), gathered_shape(rec, channels), "append", "None")
    return replace(s, df=out, kind="epoch", epoch_fs=1 / interval)


def nested(s: Signal, duration: float, interval: float) -> Signal:
    """Windows within gathered epochs, from each one's first sample; ``parent`` keeps the outer number."""
    channels, rec = list(s.channels), s.df.schema["rec"].dataType.simpleString()

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                t, x = np.asarray(r["t"]), np.stack([np.asarray(r[c]) for c in channels], 1)
                found, _ = cut(np.asarray(r["seq"]), t, x, t.min(), t.max(), 0, duration, interval)
                out += [(r["rec"], k, a, b, r["label"], r["epoch_id"], seq, at, *v.T) for k, a, b, seq, at, v in found]
            yield pd.DataFrame(out, columns=["rec", "epoch_id", "epoch_start", "epoch_end", "label", "parent", "seq", "t", *channels])

    return replace(s, df=s.df.mapInPandas(rows, gathered_shape(rec, channels, parent=True)), epoch_fs=1 / interval)


def samples_of(s: Signal) -> Signal:
    """Gathered epochs as rows of samples."""
    each = F.explode(F.arrays_zip("seq", "t", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(s.channels)]))
    keys = [k for k in ("rec", "epoch_id", "epoch_start", "epoch_end", "label", "parent") if k in s.df.columns]
    rows = s.df.select(*keys, each.alias("x"))
    fields = rows.schema["x"].dataType.names
    return replace(s, df=rows.select(*keys, "x.seq", "x.t", *[F.col("x")[f].alias(c) for f, c in zip(fields[2:], s.channels, strict=True)]))


def epoch_stat(s: Signal, stat: str, quantile: float | None = None, iqr_quantile: tuple[float, float] | None = None, popmean: float | None = None) -> Signal:
    """One row for each gathered epoch, as ``operators.stats.epoch_stat`` gives it for rows of samples."""
    if stat not in STATS:
        raise ValueError(f"{stat} is none of {', '.join(STATS)}")

    def of(x: np.ndarray) -> float | None:
        x = x[np.isfinite(x)]
        if not len(x) or (stat in ("std", "ttest_1samp") and len(x) < 2):
            return None
        if stat == "ttest_1samp":
            return float(below((x.mean() - popmean) / (x.std(ddof=1) / np.sqrt(len(x))), len(x) - 1)) if np.ptp(x) else None
        return float({
            "mean": np.mean, "min": np.min, "max": np.max, "std": lambda v: v.std(ddof=1), "range": np.ptp, "median": np.median,
            "quantile": lambda v: np.quantile(v, quantile), "iqr": lambda v: np.quantile(v, iqr_quantile[1]) - np.quantile(v, iqr_quantile[0]),
        }[stat](x))

    channels = list(s.channels)
    keys = [k for k in ("rec", "parent", "epoch_id", "label") if k in s.df.columns]

    @F.pandas_udf("double")
    def number(xs: pd.Series) -> pd.Series:
        return pd.Series([of(np.asarray(x, np.float64)) for x in xs], dtype="float64")

    value = lambda c: number(F.transform(F.col(f"`{c}`"), lambda x: F.coalesce(x, F.lit(float("nan")))))
    df = s.df.select(*keys, F.array_max("t").alias("t"), *[F.nanvl(value(c), F.lit(None)).alias(c) for c in channels])
    return replace(s, df=df, kind="signal", fs=s.epoch_fs or 0.0, epoch_fs=None)


def packed(frame: pd.DataFrame) -> bytes:
    import pyarrow as pa

    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> pd.DataFrame:
    import pyarrow as pa

    return pa.ipc.open_stream(raw).read_all().to_pandas()


class Waiting:
    """Rows (row_ms, ...) that the watermark hasn't passed, in entries of a second each, with a timer for each."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.entries = handle, handle.getMapState("waiting", "second bigint, part bigint", "rows binary")

    def add(self, frame: pd.DataFrame) -> None:
        known = {}
        for second, part in self.entries.keys():
            known[second] = max(part, known.get(second, -1))
        for second, group in frame.groupby(frame["row_ms"] // 1000):
            second = int(second)
            self.entries.updateValue((second, known.get(second, -1) + 1), (packed(group),))
            self.handle.registerTimer((second + 1) * 1000)

    def taken(self, mark: int) -> list[pd.DataFrame]:
        """Rows below ``mark``, in milliseconds, which are kept no longer."""
        out = []
        for entry in sorted(k for k in self.entries.keys() if k[0] * 1000 < mark):
            rows = unpacked(self.entries.getValue(entry)[0])
            final = rows["row_ms"] < mark
            out.append(rows[final])
            self.entries.removeKey(entry)
            if not final.all():
                self.entries.updateValue(entry, (packed(rows[~final]),))
        return out


class Latest(StatefulProcessor):
    """Rows that are not final yet, and the last right row before them."""

    def __init__(self, left: list[str], right: list[str]):
        self.left, self.right = left, right

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting, self.last = Waiting(handle), handle.getValueState("last", "row binary")

    def _final(self, key, mark: int) -> Iterator[pd.DataFrame]:
        """Left rows below the watermark, in milliseconds, each with the last right row at or before its time; null for NaN."""
        frames = self.waiting.taken(mark)
        before = self.last.get()
        if not sum(map(len, frames)):
            return
        rows = pd.concat([*([unpacked(before[0])] if before else []), *frames])
        # Right rows before left ones of the same time; of several right ones the largest comes last.
        rows = rows.sort_values(["t", "row_side", *self.right], na_position="first", ignore_index=True)
        is_right = rows["row_side"] == 0
        if is_right.any():
            self.last.update((packed(rows[is_right].tail(1)),))
        found = np.where(is_right, np.arange(len(rows)), -1)
        found = np.maximum.accumulate(found)
        plain = lambda values: [None if v is None or v != v else v for v in values]  # noqa: E731, PLR0124
        out = {"rec": [key[0]] * int((~is_right).sum())} | {c: plain(rows.loc[~is_right, c].tolist()) for c in self.left}
        for c in ["t", *self.right]:
            values = rows[c].tolist()
            out[f"__found_{c}"] = plain(values[i] if i >= 0 else None for i in found[~is_right.to_numpy()])
        if len(out["rec"]):
            yield pd.DataFrame(out, dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.waiting.add(pd.concat(list(rows)))
        yield from self._final(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._final(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def latest(left: DataFrame, right: DataFrame, delay: str, name: str = "found") -> DataFrame:
    """``operators.joins.latest`` over two streams with (rec, t, ts, ...): every row of ``left`` with the last row of ``right``
    at or before its time.

    The rule for late rows: both streams share one watermark, ``delay`` behind the latest row of either. A row is
    final once the watermark has passed it; rows that come behind the watermark are dropped, of both sides. So a result
    depends on what came in time alone. The state holds what is not final, and one right row a recording.
    """
    fields = [f for f in right.schema.fields if f.name not in ("rec", "t", "ts")]
    kept = [f for f in left.schema.fields if f.name not in ("rec", "ts")]
    lacking = lambda of: [F.lit(None).cast(f.dataType).alias(f.name) for f in of]
    own = [f for f in kept if f.name != "t"]
    clash = {f.name for f in own} & {f.name for f in fields}
    if clash:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    a = left.select("rec", "ts", F.lit(1).alias("row_side"), "t", *[F.col(f"`{f.name}`") for f in own], *lacking(fields))
    b = right.select("rec", "ts", F.lit(0).alias("row_side"), "t", *lacking(own), *[F.col(f"`{f.name}`") for f in fields])
    both = a.unionByName(b).where("rec IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay).withColumn("row_ms", F.unix_millis("ts"))
    told = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["__found_t double", *[f"`__found_{f.name}` {f.dataType.simpleString()}" for f in fields]]
    shape = f"rec {left.schema['rec'].dataType.simpleString()}, " + ", ".join(told)
    processor = Latest([f.name for f in kept], [f.name for f in fields])
    out = both.groupBy("rec").transformWithStateInPandas(processor, shape, "append", "eventTime")
    payload = F.struct(*[F.col(f"`__found_{c}`").alias(c) for c in ["t", *[f.name for f in fields]]])
    return out.select("rec", *[F.col(f"`{f.name}`") for f in kept], F.when(F.col("__found_t").isNotNull(), payload).alias(name))


class BetweenMarkers(StatefulProcessor):
    """What is not final yet, and the samples of the open epoch in entries that are only added until it closes."""

    def __init__(self, channels: list[str]):
        self.channels = channels

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = Waiting(handle)
        self.open = handle.getValueState("open", "number bigint, label string, opened bigint, begin bigint, entries bigint")
        self.held = handle.getMapState("held", "entry bigint", "x binary")

    def _final(self, key, mark: int) -> Iterator[pd.DataFrame]:
        rows = [f for f in self.waiting.taken(mark) if len(f)]
        if not rows:
            return
        rows = pd.concat(rows).sort_values(["us", "row_side", "seq"], ignore_index=True)
        number, label, opened, begin, entries = self.open.get() or (0, "first epoch", None, 0, 0)
        samples = rows["row_side"] == 1
        last = rows.loc[samples, "us"].max() if samples.any() else None
        marks = np.flatnonzero(~samples)
        # A marker without a later final sample waits, and all that follows it.
        stop = next((int(i) for i in marks if last is None or rows["us"].iloc[i] >= last), len(rows))
        if stop < len(rows):
            self.waiting.add(rows.iloc[stop:])
        if opened is None and samples.iloc[:stop].any():
            opened = int(rows.loc[samples, "us"].iloc[0])
        numbers = rows[["seq", "t", "us", *self.channels]].to_numpy(np.float64)
        wide, at, closing, out = 3 + len(self.channels), 0, None, []

        def keep(upto: int) -> None:
            nonlocal entries
            new = numbers[at:upto][samples.to_numpy()[at:upto]]
            if len(new):
                self.held.updateValue((entries,), (new.tobytes(),))
                entries += 1

        for i in (int(i) for i in marks if i < stop):
            us = int(rows["us"].iloc[i])
            if us == closing or (number and us == opened):
                continue  # of markers at one time the first counts
            keep(i)
            if entries > begin:
                x = np.concatenate([np.frombuffer(self.held.getValue((k,))[0], np.float64).reshape(-1, wide) for k in range(begin, entries)])
                for k in range(begin, entries):
                    self.held.removeKey((k,))
                frame = pd.DataFrame({"rec": key[0], "epoch_id": number, "epoch_start": opened, "epoch_end": us, "label": label, "seq": x[:, 0].astype(np.int64), "t": x[:, 1], "us": x[:, 2].astype(np.int64)})
                out.append(frame.assign(**{c: x[:, 3 + j] for j, c in enumerate(self.channels)}))
            number, label, opened, closing, begin, at = number + 1, str(rows["marker"].iloc[i]), us, us, entries, i
        keep(stop)
        self.open.update((number, label, opened, begin, entries))
        if out:
            yield pd.concat(out, ignore_index=True).astype({"rec": object, "label": object})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.waiting.add(pd.concat(list(rows)))
        yield from self._final(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._final(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def marker_epochs(s: Signal, markers: DataFrame, delay: str) -> Signal:
    """Windows from marker to marker, as ``operators.epochs.marker_epochs`` gives them, each once it is closed.

    ``markers``: (rec, mseq, ts, marker). Both streams share one watermark, ``delay`` behind the latest row of either, so
    an idle marker source holds nothing up. Rows become final when the watermark passes them; an epoch is given out
    when its closing marker and a later sample are final. Later rows than ``delay`` are dropped. The state holds what
    is not final yet and the samples of the open epoch; a trigger adds entries to it, and rewrites none of that epoch's.
    """
    s.need("signal")
    channels, rec = list(s.channels), s.df.schema["rec"].dataType.simpleString()
    nothing = [F.lit(None).cast("double").alias(c) for c in channels]
    left = s.df.select("rec", "ts", F.lit(1).alias("row_side"), "seq", "t", F.lit(None).cast("string").alias("marker"), *[v.cast("double").alias(c) for c, v in s.values().items()])
    right = markers.select("rec", "ts", F.lit(0).alias("row_side"), F.col("mseq").alias("seq"), F.lit(None).cast("double").alias("t"), F.col("marker").cast("string"), *nothing)
    both = left.unionByName(right).where("rec IS NOT NULL AND ts IS NOT NULL").withColumn("us", F.unix_micros("ts")).withColumn("row_ms", F.unix_millis("ts")).withWatermark("ts", delay)
    shape = ", ".join([f"rec {rec}, epoch_id bigint, epoch_start bigint, epoch_end bigint, label string, seq bigint, t double, us bigint", *[f"`{c}` double" for c in channels]])
    out = both.groupBy("rec").transformWithStateInPandas(BetweenMarkers(channels), shape, "append", "eventTime")
    values = [F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) for c in channels]
    times = [(F.col(c) / 1e6).alias(c) for c in ("epoch_start", "epoch_end")]
    df = out.select("rec", "epoch_id", *times, "label", "seq", "t", F.timestamp_micros("us").alias("ts"), *values)
    return replace(s, df=df, kind="epoch", epoch_fs=0.0)
