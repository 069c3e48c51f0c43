"""A quality classifier learned from trusted positives and unlabelled web text.

Positive-unlabelled learning: a linear model f over text features minimises the non-negative unbiased risk

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]),        l(z) = log(1 + exp(-z)),

by mini-batches: where the second term of a batch is negative, the step goes against it instead. No negative
label is read. The class prior is estimated first: a plain classifier of P against U is fitted on one half;
on the other half, for every threshold that keeps enough of P, the share of U above it over the share of P
above it bounds the prior from above (with a margin for the sample), and the least bound is taken.

Features of a text: the square roots of the shares of its byte values and of ``GRAMS`` hashed byte pairs, and
a few ratios of words, lines and letters. A text's score is sigmoid(f).

The fit takes at most ``TRUSTED`` positives and ``UNLABELLED`` documents, those with the lowest hashes of
their ids; features of these, and nothing else, reach the driver. Every document is scored, whole.

Defined results: a text without words (null, empty or blank) has nothing to speak for it and scores 0, whatever was
learned; without positives every other score is 0.5; repeated rows score alike; an empty table gives an empty result;
input columns pass through but for those named as a result. Rows without an id are scored, but never learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowest_hashes, read_table, small_batches, text_of, with_results

TRUSTED, UNLABELLED = 4_000, 8_000
GRAMS, RATIOS = 512, 12
SIZE = 256 + GRAMS + RATIOS
THRESHOLD = 0.3


def features(text: str | None) -> np.ndarray:
    """The features of one text."""
    out = np.zeros(SIZE, np.float32)
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if not len(raw):
        return out
    counts = np.bincount(raw, minlength=256)
    out[:256] = np.sqrt(counts / len(raw))
    pairs = (raw[:-1].astype(np.uint32) << np.uint32(8) | raw[1:]) * np.uint32(0x9E3779B1) >> np.uint32(23)
    out[256 : 256 + GRAMS] = np.sqrt(np.bincount(pairs, minlength=GRAMS) / max(1, len(pairs)))
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    n = max(1, len(words))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    out[256 + GRAMS :] = (
        1.0,
        np.log1p(len(words)) / 10,
        min(len(raw) / n / 20, 2),
        len(set(words)) / n,
        repeats / n,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)) / 5,
        upper / max(1, upper + lower),
        (upper + lower) / len(raw),
        counts[48:58].sum() / len(raw),
        counts[[33, 35, 36, 37, 38, 42, 60, 62, 64, 94, 95, 124, 126]].sum() / n,
        (counts[46] + counts[44]) / n,
    )
    return out


@dataclass
class Model:
    weights: np.ndarray
    prior: float


def _descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, rounds: int, seed: int) -> np.ndarray:
    """Weights that minimise the risk; without a prior, those that part P from U."""
    rng = np.random.default_rng(seed)
    w, m, v = (np.zeros(positive.shape[1]) for _ in range(3))
    step, per_round = 0, 16
    for _ in range(rounds):
        chunks = zip(np.array_split(rng.permutation(len(positive)), per_round), np.array_split(rng.permutation(len(unlabelled)), per_round), strict=True)
        for p_rows, u_rows in chunks:
            if not len(p_rows) or not len(u_rows):
                continue
            p, u = positive[p_rows], unlabelled[u_rows]
            fp, fu = p @ w, u @ w
            sp, su = 1 / (1 + np.exp(-np.clip(fp, -30, 30))), 1 / (1 + np.exp(-np.clip(fu, -30, 30)))
            if prior is None:
                gradient = p.T @ (sp - 1) / len(p) + u.T @ su / len(u)
            else:
                negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
                of_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
                gradient = prior * (p.T @ (sp - 1)) / len(p) + of_negative if negative >= 0 else -of_negative
            gradient = gradient + 1e-4 * w
            step += 1
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> float:
    """The share of positives among the unlabelled."""
    half = lambda x: (x[::2], x[1::2])
    (p_fit, p_test), (u_fit, u_test) = half(positive), half(unlabelled)
    w = _descend(p_fit, u_fit, None, 20, seed)
    fp, fu = np.sort(p_test @ w), np.sort(u_test @ w)
    if not len(fp) or not len(fu):
        return 0.5
    q_p = 1 - np.searchsorted(fp, fp, "left") / len(fp)
    q_u = 1 - np.searchsorted(fu, fp, "left") / len(fu)
    slack = np.sqrt(np.log(20) / 2 / len(fp)) + np.sqrt(np.log(20) / 2 / len(fu))
    enough = q_p > 2 * slack if (q_p > 2 * slack).any() else np.ones(len(fp), bool)
    best = np.argmin(((q_u + slack) / q_p)[enough])
    return float(np.clip((q_u / q_p)[enough][best], 0.05, 0.99))


def fit_arrays(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> Model:
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(SIZE), 0.5)
    prior = estimate_prior(positive, unlabelled, seed)
    return Model(_descend(positive, unlabelled, prior, 60, seed), prior)


def fit(docs: DataFrame, trusted: DataFrame, seed: int = 5) -> Model:
    """A model of ``trusted`` (doc_id) as positives and ``docs`` as unlabelled; bounded samples of both."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def features_of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).tobytes() for t in texts], dtype=object)

    def lowest(ids: DataFrame, n: int) -> DataFrame:
        return lowest_hashes(ids.where("doc_id IS NOT NULL").distinct(), n)

    positive = lowest(trusted.select("doc_id"), TRUSTED).withColumn("p", F.lit(1))
    unlabelled = lowest(docs.select("doc_id"), UNLABELLED).withColumn("u", F.lit(1))
    chosen = positive.join(unlabelled, "doc_id", "full")  # TRUSTED + UNLABELLED ids at most, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "p", "u", features_of(text_of()).alias("x"))
    found = rows.dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    matrix = np.frombuffer(b"".join(map(bytes, found["x"])), np.float32).reshape(-1, SIZE)
    return fit_arrays(matrix[found["p"].notna()], matrix[found["u"].notna()], seed)


def scores(model: Model, text: Column) -> Column:
    weights = model.weights

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        f = np.array([features(t) for t in texts]) @ weights
        return pd.Series(np.where(texts.str.isspace() | (texts == ""), 0.0, 1 / (1 + np.exp(-np.clip(f, -30, 30)))))

    return score(text)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Every row with ``score`` and ``predicted`` (1: of the positive class)."""
    small_batches(docs.sparkSession)
    rows = docs.withColumn("__score", scores(model, text_of()))
    return with_results(rows, docs.columns, {"score": F.col("__score"), "predicted": (F.col("__score") >= threshold).cast("int")})


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with the columns they came with."""
    small_batches(docs.sparkSession)
    return docs.withColumn("__score", scores(model, text_of())).where(F.col("__score") >= threshold).drop("__score")


def held_out() -> Column:
    """A fifth of the ids, by checksum; their labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the rows of both tables that are not held out; of labels only quality 1 is read."""
    return fit(docs.where(~held_out()), labels.where(~held_out()).where("quality = 1"))


def op6_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on_labels(docs, read_table(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
