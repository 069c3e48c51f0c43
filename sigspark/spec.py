"""A stream: a DataFrame, and what its columns mean.

A signal has the columns ``rec`` (recording), ``seq`` (its samples' numbers, from 0 without gaps), ``t`` (seconds)
and one double column a channel. Epochs add ``epoch_id``, ``epoch_start``, ``epoch_end`` and ``label``. Markers are
``rec, mseq, t, marker``. Operators are functions from such a stream to another and never depend on how rows are
spread over partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("signal", "epoch", "vector", "marker", "spectrum")
KEYS = {
    "signal": ["rec", "seq", "t"],
    "epoch": ["rec", "epoch_id", "epoch_start", "epoch_end", "label", "seq", "t"],
    "vector": ["rec", "vec_id"],
    "marker": ["rec", "mseq", "t"],
    "spectrum": ["rec", "epoch_id", "channel", "freq"],
}


@dataclass(frozen=True)
class Signal:
    df: DataFrame
    channels: tuple[str, ...]
    fs: float = 0.0
    kind: str = "signal"
    epoch_fs: float | None = None
    meta: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.kind} is none of {', '.join(KINDS)}")
        object.__setattr__(self, "channels", tuple(self.channels))

    def pipe(self, operator: Callable[..., Signal], *args, **options) -> Signal:
        """``operator(self, ...)``; the way user-defined operators join a chain."""
        return operator(self, *args, **options)

    def need(self, *kinds: str) -> None:
        if self.kind not in kinds:
            raise TypeError(f"this operator takes {' or '.join(kinds)}, not {self.kind}")

    @property
    def keys(self) -> list[str]:
        """The columns that stand beside the channels."""
        return [c for c in KEYS[self.kind] if c in self.df.columns]

    def project(self, channels: dict[str, Column], **changes) -> Signal:
        """The same rows with these channels."""
        df = self.df.select(*self.keys, *[c.cast("double").alias(n) for n, c in channels.items()])
        return replace(self, df=df, channels=tuple(channels), **changes)

    def values(self) -> dict[str, Column]:
        return {c: F.col(f"`{c}`") for c in self.channels}
