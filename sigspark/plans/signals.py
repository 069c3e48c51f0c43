"""Queries over signals made of the driver's tables: (spark, sf_dir) -> DataFrame, each with its SQL beside it."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import artifacts, display, epochs, features, iir, joins, project, spectral, stats, tools
from ..sources import eeglab, generator, scenario, sinks, tables
from ..spec import Signal
from ..streaming import artifacts as live
from ..streaming import epochs as sliding_live
from ..streaming import landing, stateful

HOUR = 3600.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: What the SQL of most queries begins with.
EVENTS = "ev AS (SELECT event_id, user_id AS rec, epoch_us(ts) / 1e6 AS t, event_type, value FROM events), sig AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY t, event_id) - 1 AS seq, t, value FROM ev)"
ITEMS = "it AS (SELECT l_orderkey AS rec, l_linenumber::BIGINT AS seq, l_partkey::DOUBLE AS t, l_quantity::DOUBLE AS quantity, l_extendedprice::DOUBLE AS price, l_discount::DOUBLE AS discount, l_tax::DOUBLE AS tax FROM lineitem)"
VECTORS = "vec AS (SELECT label::BIGINT AS rec, vec_id AS epoch_id, unnest(range(64)) AS seq, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def shown(s: Signal, *keys: str) -> DataFrame:
    """Keys and rounded channels; + 0.0 makes minus zero zero."""
    return s.df.select(*keys, *[(F.round(F.col(f"`{c}`"), 6) + 0.0).alias(c) for c in s.channels])


def r6(*exprs: str) -> str:
    return ", ".join(f"round({e.split(' AS ')[0]}, 6) + 0.0 AS {e.split(' AS ')[1]}" for e in exprs)


# Projections

FOUR = ["quantity", "price", "discount", "tax"]
MATRIX = {"o1": [4, 0, -1e-2, 0], "o2": [0, -1, 2, 4]}
PLACES = {"quantity": (1.0, 0.0, 0.1), "price": (0.0, 1.0, 0.2), "discount": (-1.0, 0.0, 0.3), "tax": (0.0, -1.0, 0.4)}
LAP = project.laplacian_matrix(np.array([PLACES[c] for c in FOUR]))


def items(name: str, columns: str, make: Callable[[Signal], Signal]) -> None:
    query(name, f"WITH {ITEMS} SELECT rec, seq, {columns} FROM it")(lambda spark, d: shown(make(tables.item_signal(spark, d)), "rec", "seq"))


items("channel_select", r6("tax AS tax", "quantity AS quantity"), lambda s: project.select_channels(s, "index", [4, 1]))
items("channel_select_name", r6("price AS price"), lambda s: project.select_channels(s, "name", ["price"]))
items("reference_channel", r6("price - quantity AS price", "discount - quantity AS discount", "tax - quantity AS tax"), lambda s: project.reference_channel(s, "index", 1))
items("common_average_reference", r6(*[f"{c} - (quantity + price + discount + tax) / 4 AS {c}" for c in FOUR]), project.common_average_reference)
items("spatial_filter", r6("quantity * 4.0 + price * 0.0 + discount * -0.01 + tax * 0.0 AS o1", "quantity * 0.0 + price * -1.0 + discount * 2.0 + tax * 4.0 AS o2"), lambda s: project.spatial_filter(s, MATRIX))
items("laplacian", r6(*[" + ".join(f"{c} * {w!r}::DOUBLE" for c, w in zip(FOUR, row, strict=True)) + f" AS {out}" for out, row in zip(FOUR, LAP.tolist(), strict=True)]), lambda s: project.laplacian(s, PLACES))
items("apply_square", r6(*[f"{c} * {c} AS {c}" for c in FOUR]), lambda s: project.apply_function(s, lambda x: x * x))
items("apply_log1p", r6(*[f"ln(1 + {c}) AS {c}" for c in FOUR]), lambda s: project.apply_function(s, F.log1p))
items("apply_rows", r6(*[f"{c} * 2 AS {c}" for c in FOUR]), lambda s: project.apply_rows(s, lambda row, k: row * k, 2.0))
items("erd_threshold", ", ".join(f"((({c} / 25.0 - 1) * 100) < -10)::INT::DOUBLE AS {c}" for c in FOUR), lambda s: project.change_below(s, 25.0, -10.0))
query("min_max_scale", f"WITH {EVENTS} SELECT rec, seq, round((value - min(value) OVER w) * 2 / nullif(max(value) OVER w - min(value) OVER w, 0) - 1, 6) + 0.0 AS value FROM sig WINDOW w AS (PARTITION BY rec)")(
    lambda spark, d: shown(project.scaled(tables.event_signal(spark, d)), "rec", "seq")
)


@query("channel_updater", f"WITH {EVENTS} SELECT rec, seq, round(CASE WHEN value > 50 THEN -value ELSE value END, 6) + 0.0 AS value FROM sig")
def channel_updater(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.event_signal(spark, sf_dir)
    other = Signal(s.df.where("value > 50").withColumn("value", -F.col("value")), s.channels, s.fs)
    return shown(project.update_channels(s, other), "rec", "seq")


# Epochs

DAY = 24 * HOUR
SLIDING = f"""{EVENTS}, b AS (SELECT rec, min(t) AS f, max(t) AS l FROM sig GROUP BY rec),
ep AS (SELECT s.rec, k AS epoch_id, s.t, s.seq, s.value, b.f + k * {DAY / 4} AS epoch_start FROM sig s JOIN b USING (rec),
       LATERAL (SELECT unnest(range(greatest(floor((s.t - b.f - {DAY}) / {DAY / 4})::BIGINT + 1, 0), floor((s.t - b.f) / {DAY / 4})::BIGINT + 1)) AS k)
       WHERE b.f + k * {DAY / 4} + {DAY} < b.l)"""


def sliding(spark: SparkSession, sf_dir: str) -> Signal:
    return epochs.time_epochs(tables.event_signal(spark, sf_dir), DAY, DAY / 4)


for _stat, _options, _expr in [
    ("mean", {}, "avg(value)"),
    ("min", {}, "min(value)"),
    ("max", {}, "max(value)"),
    ("std", {}, "stddev_samp(value)"),
    ("range", {}, "max(value) - min(value)"),
    ("median", {}, "median(value)"),
    ("quantile", {"quantile": 0.3}, "quantile_cont(value, 0.3)"),
    ("iqr", {"iqr_quantile": (0.25, 0.75)}, "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)"),
]:
    query(f"epoch_time_{_stat}", f"WITH {SLIDING} SELECT rec, epoch_id, round(max(t), 6) AS t, round({_expr}, 6) + 0.0 AS value FROM ep GROUP BY rec, epoch_id")(
        lambda spark, d, stat=_stat, options=_options: (lambda s: s.df.select("rec", "epoch_id", F.round("t", 6).alias("t"), (F.round("value", 6) + 0.0).alias("value")))(stats.epoch_stat(sliding(spark, d), stat, **options))
    )


@query("ttest_statistic", f"WITH {SLIDING} SELECT rec, epoch_id, round((avg(value) - 50) / (stddev_samp(value) / sqrt(count(value))), 6) + 0.0 AS statistic FROM ep GROUP BY rec, epoch_id HAVING count(value) > 1 AND stddev_samp(value) > 0")
def ttest_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sliding(spark, sf_dir).df.groupBy("rec", "epoch_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("value").alias("n"))
    return df.where("n > 1 AND s > 0").select("rec", "epoch_id", (F.round((F.col("m") - 50) / (F.col("s") / F.sqrt("n")), 6) + 0.0).alias("statistic"))


# Student's distribution of whole degrees of freedom, as a finite sum over powers of the cosine.
query(
    "ttest_1samp",
    f"""WITH {SLIDING}, sa AS (SELECT rec, epoch_id, max(t) AS t, count(value) - 1 AS v, CASE WHEN count(value) > 1 AND stddev_samp(value) > 0 THEN (avg(value) - 50) / (stddev_samp(value) / sqrt(count(value))) END AS x FROM ep GROUP BY rec, epoch_id),
    sb AS (SELECT *, CASE WHEN x IS NOT NULL THEN atan(x / sqrt(v)) END AS h FROM sa),
    sc AS (SELECT *, CASE WHEN v % 2 = 1 THEN 2 / pi() * (h + sin(h) * coalesce(list_sum([sqrt(pi()) / 2 * exp(lgamma(j) - lgamma(j + 0.5)) * pow(cos(h), 2 * j - 1) FOR j IN range(1, (v + 1) // 2)]), 0))
                         ELSE sin(h) * list_sum([exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos(h), 2 * j) FOR j IN range(0, v // 2)]) END AS p FROM sb)
    SELECT rec, epoch_id, round(t, 6) AS t, round((1 + p) / 2, 6) + 0.0 AS value FROM sc""",
)(lambda spark, d: stats.epoch_stat(sliding(spark, d), "ttest_1samp", popmean=50.0).df.select("rec", "epoch_id", F.round("t", 6).alias("t"), (F.round("value", 6) + 0.0).alias("value")))

STIM = f"""{EVENTS}, m AS (SELECT rec, event_id AS epoch_id, t + {HOUR} AS b, t + {HOUR} + {DAY} AS e, event_type AS label FROM ev WHERE event_type IN ('signup', 'purchase')),
l AS (SELECT rec, max(t) AS l FROM sig GROUP BY rec),
se AS (SELECT s.rec, m.epoch_id, m.b, m.e, m.label, s.seq, s.t, s.value FROM sig s JOIN m ON s.rec = m.rec AND s.t >= m.b AND s.t < m.e JOIN l ON l.rec = s.rec WHERE m.e < l.l)"""


def stimulated(spark: SparkSession, sf_dir: str) -> Signal:
    return epochs.stimulation_epochs(tables.event_signal(spark, sf_dir), tables.event_markers(spark, sf_dir), ["signup", "purchase"], HOUR, DAY)


query("epoch_stimulation_mean", f"WITH {STIM} SELECT rec, epoch_id, label, round(max(t), 6) AS t, round(avg(value), 6) + 0.0 AS value FROM se GROUP BY rec, epoch_id, label")(
    lambda spark, d: stats.epoch_stat(stimulated(spark, d), "mean").df.select("rec", "epoch_id", "label", F.round("t", 6).alias("t"), (F.round("value", 6) + 0.0).alias("value"))
)
query(
    "epoch_nested",
    f"""WITH {STIM}, nb AS (SELECT rec, epoch_id, min(t) AS f, max(t) AS l FROM se GROUP BY rec, epoch_id),
    ne AS (SELECT s.rec, s.epoch_id AS parent, k AS epoch_id, s.value FROM se s JOIN nb ON nb.rec = s.rec AND nb.epoch_id = s.epoch_id,
           LATERAL (SELECT unnest(range(greatest(floor((s.t - nb.f - {6 * HOUR}) / {2 * HOUR})::BIGINT + 1, 0), floor((s.t - nb.f) / {2 * HOUR})::BIGINT + 1)) AS k) WHERE nb.f + k * {2 * HOUR} + {6 * HOUR} < nb.l)
    SELECT rec, parent, epoch_id, round(avg(value), 6) + 0.0 AS value FROM ne GROUP BY rec, parent, epoch_id""",
)(lambda spark, d: shown(stats.epoch_stat(epochs.time_epochs(stimulated(spark, d), 6 * HOUR, 2 * HOUR), "mean"), "rec", "parent", "epoch_id"))
query(
    "epoch_marker_separation",
    f"""WITH {EVENTS}, m AS (SELECT rec, t, arg_min(event_type, event_id) AS marker FROM ev WHERE event_type = 'signup' GROUP BY rec, t),
    n AS (SELECT rec, t AS mt, marker, row_number() OVER (PARTITION BY rec ORDER BY t) AS number, lead(t) OVER (PARTITION BY rec ORDER BY t) AS until FROM m),
    o AS (SELECT rec, min(t) AS opening FROM m GROUP BY rec), l AS (SELECT rec, max(t) AS l FROM sig GROUP BY rec),
    j AS (SELECT s.rec, s.seq, s.value, coalesce(n.number, 0) AS epoch_id, coalesce(n.marker, 'first epoch') AS label, CASE WHEN n.mt IS NULL THEN o.opening ELSE n.until END AS e, l.l
          FROM sig s ASOF LEFT JOIN n ON s.rec = n.rec AND s.t >= n.mt JOIN o ON o.rec = s.rec JOIN l ON l.rec = s.rec)
    SELECT rec, epoch_id, label, count(*) AS n, round(avg(value), 6) + 0.0 AS value FROM j WHERE e < l GROUP BY rec, epoch_id, label""",
)(
    lambda spark, d: (
        epochs.marker_epochs(tables.event_signal(spark, d), tables.event_markers(spark, d, "signup"), 10 * DAY).df.groupBy("rec", "epoch_id", "label").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("value"), 6) + 0.0).alias("value"))
    )
)

PI = math.pi
for _kind, _expr in {
    "hanning": f"0.5 - 0.5 * cos(2 * {PI} * seq / 63)",
    "hamming": f"0.54 - 0.46 * cos(2 * {PI} * seq / 63)",
    "blackman": f"0.42 - 0.5 * cos(2 * {PI} * seq / 63) + 0.08 * cos(4 * {PI} * seq / 63)",
    "triang": "1 - abs(2 * (seq + 1) - 65) / 64.0",
}.items():
    query(f"windowing_{_kind}", f"WITH {VECTORS} SELECT rec, epoch_id, seq, round(x * ({_expr}), 6) + 0.0 AS x FROM vec")(lambda spark, d, kind=_kind: shown(stats.windowing(tables.vector_epochs(spark, d), kind), "rec", "epoch_id", "seq"))


# Spectra


def _lines(s: Signal) -> DataFrame:
    return s.df.select("rec", "epoch_id", F.round("freq", 6).alias("freq"), (F.round("value", 6) + 0.0).alias("value"))


DFT = "sqrt(pow(sum({x} * cos(2 * {pi} * k * seq / 64)), 2) + pow(sum({x} * sin(2 * {pi} * k * seq / 64)), 2))"
query("fft_amplitude", f"WITH {VECTORS}, k AS (SELECT unnest(range(32)) AS k) SELECT rec, epoch_id, round(k * 32.0 / 31, 6) AS freq, round(2.0 / 64 * {DFT.format(x='x', pi=PI)}, 6) + 0.0 AS value FROM vec, k GROUP BY rec, epoch_id, k")(
    lambda spark, d: _lines(spectral.fft_amplitude(tables.vector_epochs(spark, d)))
)
query(
    "welch_psd",
    f"""WITH {VECTORS}, w AS (SELECT rec, epoch_id, seq, (x - avg(x) OVER (PARTITION BY rec, epoch_id)) * (0.5 - 0.5 * cos(2 * {PI} * seq / 64)) AS x FROM vec), k AS (SELECT unnest(range(33)) AS k)
    SELECT rec, epoch_id, round(k * 1.0, 6) AS freq, round(pow({DFT.format(x="x", pi=PI)}, 2) / (64 * 24) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END, 6) + 0.0 AS value FROM w, k GROUP BY rec, epoch_id, k""",
)(lambda spark, d: _lines(spectral.welch_psd(tables.vector_epochs(spark, d))))
query("latest_spectrum", f"WITH {VECTORS}, last AS (SELECT rec, max(epoch_id) AS epoch_id FROM vec GROUP BY rec), k AS (SELECT unnest(range(32)) AS k) SELECT v.rec, v.epoch_id, round(k * 32.0 / 31, 6) AS freq, round(2.0 / 64 * {DFT.format(x='x', pi=PI)}, 6) + 0.0 AS value FROM vec v JOIN last USING (rec, epoch_id), k GROUP BY v.rec, v.epoch_id, k")(
    lambda spark, d: _lines(spectral.latest_spectrum(spectral.fft_amplitude(tables.vector_epochs(spark, d))))
)
# The analytic signal of 64 values, by the discrete kernel of the Hilbert transform.
ENVELOPE = f"""WITH {VECTORS}, env AS (SELECT a.rec, a.epoch_id, a.seq, round(sqrt(pow(max(a.x), 2) + pow(sum(CASE WHEN (a.seq - b.seq) % 2 <> 0 THEN b.x / tan({PI} * (a.seq - b.seq) / 64) ELSE 0 END) * 2 / 64, 2)), 6) + 0.0 AS x
    FROM vec a JOIN vec b ON a.rec = b.rec AND a.epoch_id = b.epoch_id GROUP BY a.rec, a.epoch_id, a.seq)"""
query("hilbert_channels", f"{ENVELOPE} SELECT rec, epoch_id AS seq, " + ", ".join(f"max(x) FILTER (WHERE seq = {i}) AS e{i}" for i in range(64)) + " FROM env GROUP BY rec, epoch_id")(lambda spark, d: shown(spectral.hilbert(tables.vector_signal(spark, d)), "rec", "seq"))
query("hilbert_time", f"{ENVELOPE} SELECT rec, epoch_id, seq, x FROM env")(lambda spark, d: shown(spectral.hilbert(tables.vector_epochs(spark, d), "time"), "rec", "epoch_id", "seq"))


# Filters: the SQL convolves with the impulse response, longer than any recording, from the design's closed form


def _convolution(design: str) -> str:
    """``design``: tables that end in h (k, w), the response at lag k."""
    return f"WITH RECURSIVE {EVENTS}, {design} SELECT a.rec, a.seq, round(sum(h.w * b.value), 6) + 0.0 AS value FROM sig a JOIN sig b ON a.rec = b.rec AND b.seq <= a.seq JOIN h ON h.k = a.seq - b.seq GROUP BY a.rec, a.seq"


#: Four poles: the prototype's upper one turned into two of the band, each with its mirror image.
_BUTTER = f"""w AS (SELECT 4 * tan({PI} * 30 / 250) - 4 * tan({PI} * 8 / 250) AS w, 16 * tan({PI} * 30 / 250) * tan({PI} * 8 / 250) AS c),
    half AS (SELECT w, c, -w / 2 * sqrt(0.5) AS r, w / 2 * sqrt(0.5) AS i FROM w), sq AS (SELECT *, r * r - i * i - c AS x, 2 * r * i AS y FROM half),
    root AS (SELECT *, sqrt((sqrt(x * x + y * y) + x) / 2) AS p, sign(y) * sqrt((sqrt(x * x + y * y) - x) / 2) AS q FROM sq),
    pole AS (SELECT w, r + p AS u, i + q AS v, r - p AS u2, i - q AS v2 FROM root),
    z AS (SELECT w, pow(4 - u, 2) + v * v AS n, pow(4 - u2, 2) + v2 * v2 AS n2, u, v, u2, v2 FROM pole),
    s AS (SELECT 16 * w * w / n / n2 AS g, -2 * (16 - u * u - v * v) / n AS a, (pow(4 + u, 2) + v * v) / n AS d, -2 * (16 - u2 * u2 - v2 * v2) / n2 AS e, (pow(4 + u2, 2) + v2 * v2) / n2 AS f FROM z),
    den AS (SELECT g, a + e AS a1, d + f + a * e AS a2, a * f + d * e AS a3, d * f AS a4 FROM s),
    h AS (SELECT 0 AS k, g AS w, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM den UNION ALL
          SELECT k + 1, CASE k + 1 WHEN 2 THEN -2 * g WHEN 4 THEN g ELSE 0 END - a1 * w - a2 * x - a3 * y - a4 * z, w, x, y FROM h, den WHERE k < 511)"""
_NOTCH = f"""o AS (SELECT cos(2 * {PI} * 50 / 250) AS c, 1 / (1 + tan({PI} * 50 / 250 / 2)) AS g),
    h AS (SELECT 0 AS k, g AS w, 0.0::DOUBLE AS x FROM o UNION ALL
          SELECT k + 1, CASE k + 1 WHEN 1 THEN -2 * g * c WHEN 2 THEN g ELSE 0 END + 2 * g * c * w - (2 * g - 1) * x, w FROM h, o WHERE k < 511)"""
_SINC = f"""r AS (SELECT k, CASE WHEN k = 10 THEN 2 * 20 / 250.0 ELSE sin(2 * {PI} * 20 / 250 * (k - 10)) / ({PI} * (k - 10)) END * (0.54 - 0.46 * cos(2 * {PI} * k / 20)) AS w FROM (SELECT unnest(range(21)) AS k)),
    h AS (SELECT k, w / (SELECT sum(w) FROM r) AS w FROM r)"""
query("butter_band", _convolution(_BUTTER))(lambda spark, d: shown(iir.butter(tables.event_signal(spark, d), 8.0, 30.0, 2), "rec", "seq"))
query("notch", _convolution(_NOTCH))(lambda spark, d: shown(iir.notch_filter(tables.event_signal(spark, d), 50.0, 2.0), "rec", "seq"))
query("fir_lowpass", _convolution(_SINC))(lambda spark, d: shown(iir.fir_lowpass(tables.event_signal(spark, d), 21, 20.0), "rec", "seq"))


def _downsampling(factor: int) -> str:
    """Four sections of two poles each, from the closed form of Chebyshev's filter, one after another, sample by sample, forth and
    back over the signal turned about its ends."""
    n = range(1, 5)

    def walk(name: str, source: str) -> str:
        """Each step: the sections' outputs from input and states (o1 to o4), then the new states."""
        first = ", ".join(f"x - g{k} * x AS p{k}, g{k} * x - d{k} * x AS q{k}" for k in n)
        outputs = "i.x AS o0, f.*, " + ", ".join(f"c.{v}{k}" for k in n for v in "adg") + ", c.level"
        chain = f"(SELECT {outputs}, i.n AS nn FROM {name} f JOIN {source} i ON i.rec = f.rec AND i.n = f.n + 1, c)"
        for k in n:
            chain = f"(SELECT *, g{k} * o{k - 1} + p{k} AS o{k} FROM {chain})"
        after = ", ".join(f"2 * g{k} * o{k - 1} - a{k} * o{k} + q{k}, g{k} * o{k - 1} - d{k} * o{k}" for k in n)
        start = f"(SELECT i.rec, i.n - 1 AS n, i.x, c.* FROM {source} i, c WHERE i.n = 0)"
        return f"{name} AS (SELECT rec, n, 0.0::DOUBLE AS y, {first} FROM {start} UNION ALL SELECT rec, nn, o4 * level, {after} FROM {chain})"

    return f"""WITH RECURSIVE {EVENTS},
    r AS (SELECT sqrt(pow(10, 0.05 / 10) - 1) AS e), h AS (SELECT e, asinh(1 / e) / 8 AS m, 4 * tan({PI} * 0.8 / {factor} / 2) AS w FROM r),
    s AS (SELECT k, -w * sinh(m) * sin({PI} * (2 * k - 1) / 16) AS u, w * cosh(m) * cos({PI} * (2 * k - 1) / 16) AS v, 1 / sqrt(1 + e * e) AS level FROM h, (SELECT unnest(range(1, 5)) AS k)),
    z AS (SELECT k, level, -2 * (16 - u * u - v * v) / (pow(4 - u, 2) + v * v) AS a, (pow(4 + u, 2) + v * v) / (pow(4 - u, 2) + v * v) AS d FROM s),
    c AS (SELECT max(level) AS level, {", ".join(f"max(a) FILTER (k = {k}) AS a{k}, max(d) FILTER (k = {k}) AS d{k}, max((1 + a + d) / 4) FILTER (k = {k}) AS g{k}" for k in n)} FROM z),
    b AS (SELECT rec, count(*) AS m, arg_min(value, seq) AS x0, arg_max(value, seq) AS x1 FROM sig GROUP BY rec HAVING count(*) > 27),
    pad AS (SELECT rec, seq + 27 AS n, value AS x FROM sig JOIN b USING (rec) UNION ALL
            SELECT rec, 27 - seq, 2 * x0 - value FROM sig JOIN b USING (rec) WHERE seq BETWEEN 1 AND 27 UNION ALL
            SELECT rec, 2 * (m - 1) - seq + 27, 2 * x1 - value FROM sig JOIN b USING (rec) WHERE seq BETWEEN m - 28 AND m - 2),
    {walk("forth", "pad")},
    turned AS (SELECT rec, m + 53 - n AS n, y AS x FROM forth JOIN b USING (rec) WHERE n >= 0),
    {walk("back", "turned")}
    SELECT rec, (m + 53 - n - 27) // {factor} AS seq, round(y, 6) + 0.0 AS value FROM back JOIN b USING (rec)
    WHERE n >= 0 AND m + 53 - n BETWEEN 27 AND m + 26 AND (m + 53 - n - 27) % {factor} = 0"""


query("downsample", _downsampling(2))(lambda spark, d: shown(iir.downsample(tables.event_signal(spark, d), 2), "rec", "seq"))


# Artifacts

query("ga_correct", f"WITH {EVENTS} SELECT rec, seq, round(CASE WHEN seq // 7 >= 2 THEN value - avg(value) OVER (PARTITION BY rec, seq % 7 ORDER BY seq // 7 ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) ELSE value END, 6) + 0.0 AS value FROM sig")(
    lambda spark, d: shown(artifacts.gradient_correction(tables.event_signal(spark, d), None, None, 3, 4, 7 / 250)[0], "rec", "seq")
)
query(
    "ga_markers",
    f"""WITH {EVENTS}, g AS (SELECT rec, min(t) AS since FROM ev WHERE event_type = 'signup' GROUP BY rec), st AS (SELECT s.rec, min(s.seq) AS seq, min(g.since) AS since FROM sig s JOIN g ON s.rec = g.rec AND s.t >= g.since GROUP BY s.rec)
    SELECT rec, round(since, 6) AS t, 'Start of GA building' AS marker FROM st UNION ALL SELECT s.rec, round(s.t, 6), 'Start of GA subtraction' FROM sig s JOIN st ON s.rec = st.rec AND s.seq = st.seq + 14""",
)(lambda spark, d: artifacts.gradient_correction(tables.event_signal(spark, d), tables.event_markers(spark, d), "signup", 3, 4, 7 / 250)[1].select("rec", F.round("t", 6).alias("t"), "marker"))


@query(
    "pa_template",
    f"""WITH {EVENTS}, p AS (SELECT rec, seq AS peak, row_number() OVER (PARTITION BY rec ORDER BY seq) AS cycle FROM sig WHERE value > 90),
    j AS (SELECT s.rec, s.seq, s.value, p.cycle, s.seq - p.peak AS place FROM sig s ASOF LEFT JOIN p ON s.rec = p.rec AND s.seq >= p.peak)
    SELECT rec, seq, round(CASE WHEN place < 12 AND count(*) OVER w > 2 THEN value - avg(value) OVER w ELSE value END, 6) + 0.0 AS value FROM j
    WINDOW w AS (PARTITION BY rec, CASE WHEN place < 12 THEN place ELSE -1 - seq % 12 END ORDER BY cycle RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def pa_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.event_signal(spark, sf_dir)
    peaks = s.df.where("value > 90").select("rec", "seq")
    both = Signal(s.df.withColumn("ECG", F.lit(0.0)), ("value", "ECG"), 250.0)
    return shown(project.select_channels(artifacts.pulse_correction(both, "ECG", peaks, 2, 5, 12 / 250), "name", ["value"]), "rec", "seq")


def small_detector(length: int = 16, units: int = 3) -> artifacts.PeakDetector:
    """A detector with drawn weights, for running the whole chain where no trained one is at hand."""
    rng = np.random.default_rng(7)
    weights = {"u": units, "t": length, "wd": rng.normal(size=(2 * units, 1)), "bd": np.array([-2.0])}
    for layer, width in (("1", 1), ("2", 2 * units)):
        for way in "fb":
            for g in "filo":
                weights |= {f"wx{g}{layer}{way}": rng.normal(size=(width, units)), f"wh{g}{layer}{way}": rng.normal(size=(units, units)), f"b{g}{layer}{way}": rng.normal(size=units)}
    return artifacts.PeakDetector(weights)


@query("pa_correct")
def pa_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From detection to subtraction."""
    s = tables.event_signal(spark, sf_dir).project({"value": F.col("value"), "ECG": F.col("value")})
    return shown(artifacts.pulse_artifact(s, small_detector(), None, None, None, 4, 2, 5, 6 / 250, 12 / 250)[0], "rec", "seq")


# Joins on time

query(
    "asof_latest_value",
    f"WITH {EVENTS}, b AS (SELECT rec, t AS bt, max(value) AS base FROM ev WHERE event_type = 'signup' GROUP BY rec, t) SELECT s.rec, s.seq, round(s.value - coalesce(b.base, 0), 6) + 0.0 AS value FROM sig s ASOF LEFT JOIN b ON s.rec = b.rec AND s.t >= b.bt",
)(
    lambda spark, d: joins.latest(tables.event_signal(spark, d).df, tables.events(spark, d).where("event_type = 'signup'").select("rec", "t", "value"), 10 * DAY).select(
        "rec", "seq", (F.round(F.col("value") - F.coalesce(F.col("found.value"), F.lit(0.0)), 6) + 0.0).alias("value")
    )
)
query(
    "nearest_latency",
    f"""WITH {EVENTS}, n AS (SELECT rec, event_id AS other, t AS nt FROM ev WHERE event_type <> 'signup'), m AS (SELECT rec, event_id, t FROM ev WHERE event_type = 'signup'),
    p AS (SELECT m.rec, m.event_id, m.t, n.other AS ps, n.nt AS pt FROM m ASOF LEFT JOIN n ON m.rec = n.rec AND m.t >= n.nt),
    q AS (SELECT p.*, n.other AS ns, n.nt FROM p ASOF LEFT JOIN n ON p.rec = n.rec AND p.t <= n.nt)
    SELECT rec, event_id, CASE WHEN pt IS NOT NULL AND (nt IS NULL OR t - pt < nt - t) THEN ps ELSE ns END AS other FROM q""",
)(
    lambda spark, d: joins.nearest(tables.events(spark, d).where("event_type = 'signup'").select("rec", "event_id", "t"), tables.events(spark, d).where("event_type <> 'signup'").select("rec", "t", F.col("event_id").alias("other")), 10 * DAY).select(
        "rec", "event_id", F.col("found.other").alias("other")
    )
)


# Features and models

query("feature_vector", f"WITH {SLIDING}, a AS (SELECT rec, epoch_id, max(t) AS t, avg(value) AS value FROM ep GROUP BY rec, epoch_id) SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY t, epoch_id) - 1 AS vec_id, 'rest' AS class, round(value, 6) + 0.0 AS value FROM a")(
    lambda spark, d: shown(features.feature_vectors(stats.epoch_stat(sliding(spark, d), "mean"), "rest"), "rec", "vec_id", "class")
)


def _lda(spark: SparkSession, sf_dir: str, output: str) -> DataFrame:
    s = tables.vector_signal(spark, sf_dir)
    model = features.fit_lda(s.df, list(s.channels), "rec")
    found = features.classify(s.df, list(s.channels), model, output)
    return found.select("rec", "seq", *(["class"] if output == "class" else [F.round(c, 6).alias(c) for c in found.columns if c.startswith("p_")]))


#: The pooled covariance beside the classes' means, turned into weights by elimination, one column a step.
DISCRIMINANT = f"""WITH RECURSIVE {VECTORS}, mu AS (SELECT rec, seq, avg(x) AS m, count(*) AS n FROM vec GROUP BY rec, seq), total AS (SELECT count(*) AS n FROM embeddings),
    cls AS (SELECT rec, row_number() OVER (ORDER BY rec) - 1 AS c FROM (SELECT DISTINCT rec FROM vec)),
    away AS (SELECT epoch_id, seq, x - m AS d FROM vec JOIN mu USING (rec, seq)),
    g AS (SELECT 0 AS k, a.seq AS i, b.seq AS j, sum(a.d * b.d) / (SELECT n FROM total) + CASE WHEN a.seq = b.seq THEN 1e-9 ELSE 0 END AS v FROM away a JOIN away b USING (epoch_id) GROUP BY a.seq, b.seq
          UNION ALL SELECT 0, seq, 64 + c, m FROM mu JOIN cls USING (rec)),
    solved AS (SELECT k, i, j, v FROM g UNION ALL
               SELECT a.k + 1, a.i, a.j, CASE WHEN a.i = a.k THEN a.v / p.v ELSE a.v - f.v / p.v * r.v END
               FROM solved a JOIN solved p ON p.i = a.k AND p.j = a.k JOIN solved f ON f.i = a.i AND f.j = a.k JOIN solved r ON r.i = a.k AND r.j = a.j WHERE a.k < 64),
    w AS (SELECT i AS seq, rec, v FROM solved JOIN cls ON j = 64 + c WHERE k = 64),
    o AS (SELECT w.rec, ln(max(mu.n) / (SELECT n FROM total)) - 0.5 * sum(w.v * mu.m) AS o FROM w JOIN mu USING (rec, seq) GROUP BY w.rec),
    score AS (SELECT vec.rec, vec.epoch_id AS seq, w.rec AS class, sum(vec.x * w.v) + max(o.o) AS s FROM vec JOIN w ON w.seq = vec.seq JOIN o ON o.rec = w.rec GROUP BY vec.rec, vec.epoch_id, w.rec),
    chance AS (SELECT rec, seq, class, s, exp(s - max(s) OVER v) / sum(exp(s - (SELECT max(s) FROM score q WHERE q.seq = score.seq))) OVER v AS p FROM score WINDOW v AS (PARTITION BY seq))"""

query("lda_class", f"{DISCRIMINANT} SELECT rec, seq, arg_max(class, s)::INT AS class FROM score GROUP BY rec, seq")(lambda spark, d: _lda(spark, d, "class"))
query("lda_probability", f"{DISCRIMINANT} SELECT rec, seq, " + ", ".join(f"round(max(p) FILTER (class = {k}), 6) AS p_{k}" for k in range(10)) + " FROM chance GROUP BY rec, seq")(lambda spark, d: _lda(spark, d, "probability"))


# Sources

query("generator_oscillator", "WITH g AS (SELECT range AS seq, (range + 1) / 500.0 AS t FROM range(100000)) SELECT seq, " + r6(*[f"sin(2 * {PI} * {5 + i} * t) * {5 + 5 / (i + 1)!r} AS Ch{i + 1}" for i in range(4)]) + " FROM g")(
    lambda spark, d: shown(generator.generate(spark, "oscillator", 4, 500.0, 100_000), "seq")
)
query("generator_on_events", f"WITH {EVENTS} SELECT rec, seq, " + r6(*[f"sin(2 * {PI} * {5 + i} * ((seq + 1) / 500.0)) * {5 + 5 / (i + 1)!r} AS Ch{i + 1}" for i in range(4)]) + " FROM sig")(
    lambda spark, d: (lambda s: shown(generator.on_times(Signal(s.df.withColumn("t", (F.col("seq") + 1) / 500), s.channels, 500.0), "oscillator", 4), "rec", "seq"))(tables.event_signal(spark, d))
)
DESCRIBED = {"trials": 4, "sessions": 2, "random": False, "classes": [769, 770], "init": [(32769, 1.0, 1.0)], "loop": [(768, 1.25, 1.25), (None, 1.0, 1.0)], "intersession": [(33025, 2.0, 2.0)], "end": [(32770, 1.0, 1.0)]}
#: Two sessions of a block of either class, four trials each, as table ``sc``.
SCENARIO = """b AS (SELECT unnest(range(4)) AS block), tr AS (SELECT block, unnest(range(4)) AS trial FROM b),
    s AS (SELECT 0 AS o, 0 AS trial, 0 AS step, '32769' AS marker, 1.0::DOUBLE AS d UNION ALL
          SELECT 1 + 2 * block, trial, 0, '768', 1.25 FROM tr UNION ALL SELECT 1 + 2 * block, trial, 1, CASE WHEN block % 2 = 0 THEN '769' ELSE '770' END, 1.0 FROM tr UNION ALL
          SELECT 2 + 2 * block, 0, 0, '33025', 2.0 FROM b WHERE block < 3 UNION ALL SELECT 100, 0, 0, '32770', 1.0),
    sc AS (SELECT 'scenario' AS rec, row_number() OVER w - 1 AS mseq, coalesce(sum(d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t, marker FROM s WINDOW w AS (ORDER BY o, trial, step))"""
query("scenario", f"WITH {SCENARIO} SELECT * FROM sc")(lambda spark, d: scenario.scenario(spark, DESCRIBED))
query("gated_scenario", f"WITH {SCENARIO}, g AS (SELECT min(epoch_us(ts) / 1e6) AS t0 FROM events WHERE event_type = 'signup') SELECT rec, mseq, round(t + t0, 6) AS t, marker FROM sc, g")(
    lambda spark, d: scenario.gated(scenario.scenario(spark, DESCRIBED), tables.event_markers(spark, d), "^sign").select("rec", "mseq", F.round("t", 6).alias("t"), "marker")
)


# Frames to draw, and tools

query("plot_window", f"WITH {EVENTS}, b AS (SELECT rec, min(t) AS f, max(t) AS l FROM sig GROUP BY rec) SELECT s.rec, s.seq, round((s.t - b.f) % {DAY}, 6) AS x, round(s.value, 6) + 0.0 AS value FROM sig s JOIN b USING (rec) WHERE s.t > b.l - {DAY}")(
    lambda spark, d: display.plot_window(tables.event_signal(spark, d), DAY).df.select("rec", "seq", F.round("x", 6).alias("x"), (F.round("value", 6) + 0.0).alias("value"))
)
query(
    "graz_state",
    f"""WITH {EVENTS}, c AS (SELECT rec, event_id AS mseq, t, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 END AS cr, CASE event_type WHEN 'signup' THEN 'left' WHEN 'purchase' THEN 'right' END AS ar FROM ev)
    SELECT rec, mseq, coalesce(last_value(cr IGNORE NULLS) OVER w, 0)::INT AS cross, coalesce(last_value(ar IGNORE NULLS) OVER w, 'none') AS arrow FROM c WINDOW w AS (PARTITION BY rec ORDER BY t, mseq ROWS UNBOUNDED PRECEDING)""",
)(lambda spark, d: display.graz_state(tables.event_markers(spark, d), {"click": "show_cross", "view": "hide_cross", "signup": "show_left_arrow", "purchase": "show_right_arrow"}).select("rec", "mseq", "cross", "arrow"))
query(
    "trim_by_marker",
    f"""WITH {EVENTS}, m AS (SELECT rec, min(t) AS a, max(t) AS b FROM ev WHERE event_type = 'signup' GROUP BY rec), i AS (SELECT s.* FROM sig s JOIN m USING (rec) WHERE s.t >= m.a AND s.t <= m.b)
    SELECT rec, seq - min(seq) OVER w AS seq, round(t - min(t) OVER w, 6) AS t, round(value, 6) + 0.0 AS value FROM i WINDOW w AS (PARTITION BY rec)""",
)(lambda spark, d: tools.trim_by_markers(tables.event_signal(spark, d), tables.event_markers(spark, d), "signup", "signup").df.select("rec", "seq", F.round("t", 6).alias("t"), (F.round("value", 6) + 0.0).alias("value")))
query(
    "trim_last_but_one",
    f"""WITH {EVENTS}, m AS (SELECT rec, event_id, t, row_number() OVER (PARTITION BY rec ORDER BY t DESC, event_id DESC) AS n FROM ev WHERE event_type = 'signup'),
    l AS (SELECT rec, min(t) AS a, max(t) FILTER (WHERE n = 2) AS b FROM m GROUP BY rec), i AS (SELECT s.* FROM sig s JOIN l USING (rec) WHERE s.t >= l.a AND s.t <= l.b)
    SELECT rec, seq - min(seq) OVER w AS seq, round(t - min(t) OVER w, 6) AS t, round(value, 6) + 0.0 AS value FROM i WINDOW w AS (PARTITION BY rec)""",
)(
    lambda spark, d: tools.trim_by_markers(tables.event_signal(spark, d), tables.event_markers(spark, d), "signup", "signup", from_last=2).df.select("rec", "seq", F.round("t", 6).alias("t"), (F.round("value", 6) + 0.0).alias("value"))
)
query(
    "trim_by_place",
    f"""WITH {EVENTS}, i AS (SELECT * FROM sig WHERE seq BETWEEN 10 AND 40) SELECT rec, seq - 10 AS seq, round(t - min(t) OVER (PARTITION BY rec), 6) AS t, round(value, 6) + 0.0 AS value FROM i""",
)(lambda spark, d: (lambda s: tools.trim(s, tools.limits_by_place(s, 10, 40)).df.select("rec", "seq", F.round("t", 6).alias("t"), (F.round("value", 6) + 0.0).alias("value")))(tables.event_signal(spark, d)))
query("serial_frames", f"WITH {ITEMS} SELECT printf('00%02X', quantity::BIGINT) AS line, count(*) AS n FROM it GROUP BY quantity")(
    lambda spark, d: sinks.frames_of(project.select_channels(tables.item_signal(spark, d), "name", ["quantity"])).groupBy(F.hex("line").alias("line")).agg(F.count(F.lit(1)).alias("n"))
)
query("marker_code_parse", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 13 ELSE event_id % 200 END::INT AS code FROM events")(
    lambda spark, d: tables.events(spark, d).select(
        "event_id", tools.marker_code(F.when(F.col("event_id") % 3 == 0, F.lit("Sync On")).otherwise(F.concat(F.lit("Stimulus/S"), F.lpad((F.col("event_id") % 200).cast("string"), 3, " ")))).cast("int").alias("code")
    )
)
query(
    "volume_markers",
    f"""WITH {EVENTS}, n AS (SELECT rec, seq, value, lag(value) OVER w AS b, lead(value) OVER w AS a FROM sig WINDOW w AS (PARTITION BY rec ORDER BY seq)),
    st AS (SELECT rec, seq, seq - lag(seq) OVER (PARTITION BY rec ORDER BY seq) AS gap FROM n WHERE abs(coalesce(a, value) - coalesce(b, value)) / (CASE WHEN a IS NULL OR b IS NULL THEN 1 ELSE 2 END) / 4 > 5),
    lo AS (SELECT rec, max(gap) AS longest FROM st WHERE gap < 50 GROUP BY rec),
    o AS (SELECT rec, seq FROM st JOIN lo USING (rec) WHERE gap >= longest - 10 AND gap < 50), z AS (SELECT rec, max(seq) AS z FROM o GROUP BY rec),
    q AS (SELECT rec, z, max(value) FILTER (WHERE seq BETWEEN z - 25 AND z - 1) AS pre, max(value) FILTER (WHERE seq BETWEEN z + 26 AND z + 50) AS post, max(seq) AS top FROM sig JOIN z USING (rec) GROUP BY rec, z),
    k AS (SELECT o.rec, o.seq, lead(o.seq) OVER (PARTITION BY o.rec ORDER BY o.seq) AS nx FROM o LEFT JOIN q ON q.rec = o.rec AND q.z = o.seq WHERE NOT coalesce(q.z >= 25 AND q.z + 50 <= q.top AND q.post < 0.5 * q.pre, false)),
    r AS (SELECT rec, seq, row_number() OVER (PARTITION BY rec ORDER BY seq) AS i FROM k WHERE nx IS NULL OR abs(nx - seq - 50) < 100)
    SELECT rec, seq FROM r WHERE i > 2""",
)(lambda spark, d: tools.volume_markers(tables.event_signal(spark, d), 5.0, 0.2, 1.0, 10, 100, 2))
query("file_pairs", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'rest' ELSE 'move' END AS task, (event_id % 7)::VARCHAR AS run FROM events")(
    lambda spark, d: tables.events(spark, d).withColumn("p", tools.name_pairs(F.concat(F.lit("task-"), F.when(F.col("rec") % 2 == 0, "rest").otherwise("move"), F.lit("_run-"), (F.col("event_id") % 7).cast("string")))).select(
        "event_id", F.col("p")["task"].alias("task"), F.col("p")["run"].alias("run")
    )
)


@query(
    "training_windows",
    f"""WITH {EVENTS}, dr AS (SELECT rec, seq AS start FROM sig WHERE ('0x' || substr(md5(concat_ws(':', 1, rec, seq)), 1, 8))::BIGINT % 1000000 < 200000),
    near AS (SELECT DISTINCT rec, seq FROM (SELECT rec, unnest(range(seq - 2, seq + 3)) AS seq FROM sig WHERE value > 90)),
    i AS (SELECT s.rec, dr.start, s.seq, s.value, (near.seq IS NOT NULL)::INT AS label FROM sig s JOIN dr ON s.rec = dr.rec AND s.seq >= dr.start AND s.seq < dr.start + 16 LEFT JOIN near ON near.rec = s.rec AND near.seq = s.seq)
    SELECT rec, start, seq, round(2 * (value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) - 1, 6) + 0.0 AS x, label FROM i
    WINDOW w AS (PARTITION BY rec, start) QUALIFY count(*) OVER w = 16 AND max(label) OVER w = 1""",
)
def training_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.event_signal(spark, sf_dir)
    return tools.training_windows(s, "value", s.df.where("value > 90").select("rec", "seq"), 16, 0.2).withColumn("x", F.round("x", 6) + 0.0)


@query("eeglab_round_trip", f"WITH {EVENTS} SELECT rec::VARCHAR AS rec, seq, round(seq / 250.0, 6) AS t, round(value, 6) + 0.0 AS value, CASE WHEN value > 90 THEN 'high' END AS marker FROM sig")
def eeglab_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and the markers at high ones, packed into files of structures and unpacked again."""
    s = tables.event_signal(spark, sf_dir)
    s = Signal(s.df.withColumn("t", F.col("seq") / 250.0), s.channels, s.fs)
    marks = s.df.where("value > 90").select("rec", F.col("seq").alias("mseq"), "t", F.lit("high").alias("marker"))
    got, found = eeglab.signal_of(eeglab.blocks_of(eeglab.files_of(s, marks).select("rec", "content")), ["value"], s.fs)
    at = found.select("rec", F.round(F.col("t") * s.fs).cast("bigint").alias("seq"), "marker")
    return got.df.join(at, ["rec", "seq"], "left").select("rec", "seq", F.round("t", 6).alias("t"), (F.round("value", 6) + 0.0).alias("value"), "marker")


query("heart_rate", f"WITH {EVENTS} SELECT rec, round(60 * count(*) FILTER (value > 90) / (count(*) / 250.0), 6) AS bpm FROM sig GROUP BY rec HAVING count(*) FILTER (value > 90) > 0")(
    lambda spark, d: (lambda s: tools.heart_rate(s.df.where("value > 90").select("rec", "seq"), s).select("rec", F.round("bpm", 6).alias("bpm")))(tables.event_signal(spark, d))
)
query(
    "detection_quality",
    "WITH r AS (SELECT value > 50 AS hit, event_type = 'purchase' AS label FROM events) SELECT round(count(*) FILTER (hit AND label) / count(*) FILTER (hit), 6) AS precision, round(avg((hit = label)::INT), 6) AS accuracy FROM r",
)(
    lambda spark, d: tools.detection_quality(tables.events(spark, d).select((F.col("value") / 100).alias("p"), (F.col("event_type") == "purchase").cast("int").alias("label"))).select(
        F.round("precision", 6).alias("precision"), F.round("accuracy", 6).alias("accuracy")
    )
)
query(
    "renumber_runs",
    """WITH f AS (SELECT DISTINCT 'sub-' || user_id || '_task-rest' AS prefix, event_id % 50 AS run FROM events), g AS (SELECT prefix, prefix || '_run-' || run AS name, run FROM f)
    SELECT name, prefix || '_run-' || lpad((row_number() OVER (PARTITION BY prefix ORDER BY run, name))::VARCHAR, 2, '0') AS new_name FROM g""",
)(
    lambda spark, d: tools.renumber_runs(
        tables.events(spark, d).select(F.concat(F.lit("sub-"), F.col("rec").cast("string"), F.lit("_task-rest_run-"), (F.col("event_id") % 50).cast("string")).alias("name")).distinct()
    ).select("name", "new_name")
)
query("apply_model", "SELECT label::BIGINT AS rec, vec_id AS seq, (list_position(embedding, list_max(embedding)) - 1)::VARCHAR AS class FROM embeddings")(
    lambda spark, d: (lambda s: features.apply_model(s.df, list(s.channels), lambda x: x.argmax(1)).select("rec", "seq", "class"))(tables.vector_signal(spark, d))
)

# Over streams: tables landed in files, played to their end

query("stream_ga_correct", SQL["ga_correct"])(lambda spark, d: shown(_streamed(spark, tables.event_signal(spark, d), lambda s: live.gradient_correction(s, None, None, 3, 4, 7 / 250)[0]), "rec", "seq"))
query("stream_epoch_mean", SQL["epoch_time_mean"])(
    lambda spark, d: _streamed(spark, tables.event_signal(spark, d), lambda s: sliding_live.epoch_stat(sliding_live.gathered_epochs(s, DAY, DAY / 4), "mean")).df.select("rec", "epoch_id", F.round("t", 6).alias("t"), (F.round("value", 6) + 0.0).alias("value"))
)
query("stream_butter_band", SQL["butter_band"])(lambda spark, d: shown(_streamed(spark, tables.event_signal(spark, d), lambda s: stateful.butter(s, 8.0, 30.0, 2)), "rec", "seq"))


def _streamed(spark: SparkSession, s: Signal, operator: Callable[[Signal], Signal]) -> Signal:
    """A signal landed in three parts of each recording, and what an operator makes of that stream."""
    made: list[Signal] = []

    def make() -> DataFrame:
        made.append(operator(Signal(landing.landed(s.df, "seq", 30, 3), s.channels, s.fs)))
        return made[0].df

    df = landing.played(spark, make)
    return Signal(df, made[0].channels, made[0].fs, made[0].kind)
