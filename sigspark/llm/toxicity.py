"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labelled texts: words, and beginnings of words of 4 and 5 letters, that toxic texts hold far
more often than others; in any language, and without a list of insults in this file. Its weights are smoothed log-odds
of the shares of texts. The features of a text are densities of lexicon hits, how many of them stand within
``REACH`` words of a second person, capitals, punctuation, and signs of obfuscation (letters replaced by digits or
signs, stretched letters, hits that appear only when those are undone). Boosted trees turn them into a margin, and an
isotonic regression turns margins into probabilities.

Labelled rows fall into three folds by a hash of their ids. A fold's features come from the lexicon of the other two; for
each fold, trees learn from the other two, and the calibration learns from the margins that every fold gets from trees
that never saw it. Documents are scored with the lexicon of all folds and the mean margin of the three sets of trees. The fit takes at most ``LABELLED`` labelled documents, those with the
lowest hashes; the lexicon holds at most ``LEXICON`` entries. Every document is scored, whole.

Defined results: a text without words (null, empty or blank) says nothing and scores 0; without labels of both kinds
every other text scores 0.5; of several texts with one id the smallest is learned from, with the largest of its labels;
rows without an id are scored but never learned from; repeated rows score alike; an empty table gives an empty result;
input columns pass through but for those named as a result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosted import Tree, fit_trees
from .common import lowest_hashes, read_table, small_batches, text_of, with_results, written

LABELLED, LEXICON = 24_000, 20_000
FOLDS, ROUNDS, REACH = 3, 15, 5
THRESHOLD = 0.7
#: A term enters a lexicon if so many toxic texts hold it, and so many times the share of toxic texts as of others.
LEAST, ODDS = 2, 10.0
#: Log-odds from which a hit counts as strong.
STRONG = 3.0
#: Second persons of four languages.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Signs that are counted, and what stands for a letter in disguise.
SIGNS = [ord(c) for c in "#*$%&@|<>"]
DISGUISE = str.maketrans("013457@$!|", "oieastasii")
LETTERS = re.compile(r"[^\W\d_]+")
STRETCH = re.compile(r"([^\W\d_])\1{2,}")
INSIDE = re.compile(r"[^\W\d_][0-9@$!|*#]+[^\W\d_]")
LOUD = re.compile(r"[!?]{2,}")
#: Letters of a word beyond these are of no account to the lexicon.
LONGEST = 64

NAMES = (
    "hits", "strong", "strong_log", "strongest", "weight", "kinds", "near_second", "second", "capitals", "shouted", "exclaimed", "loud", "signs", "mixed", "stretched",
    "disguised", "words_log",
)


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return LETTERS.findall(text.lower())


def terms(word: str) -> list[str]:
    """What a lexicon may know of a word: itself, and its beginnings, marked by a hyphen."""
    return [word[:LONGEST], *(word[:k] + "-" for k in (4, 5) if len(word) > k)]


def undone(token: str) -> str:
    """The longest word of a token without disguises and stretched letters."""
    return max(words_of(STRETCH.sub(r"\1", token.translate(DISGUISE))), key=len, default="")


class Scorer:
    """The features of texts by one lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.whole = {t: w for t, w in lexicon.items() if not t.endswith("-")}
        self.begins = {t[:-1]: w for t, w in lexicon.items() if t.endswith("-")}

    def hit(self, word: str) -> float:
        """The largest weight of a word's terms, 0 without one."""
        n, begins = len(word), self.begins
        return max(self.whole.get(word[:LONGEST], 0.0), begins.get(word[:4], 0.0) if n > 4 else 0.0, begins.get(word[:5], 0.0) if n > 5 else 0.0)

    def features(self, text: str) -> list[float]:
        tokens = text.split()
        if not tokens:
            return [0.0] * len(NAMES)
        n, size, words = len(tokens), len(text), words_of(text)
        counts = Counter(words)
        weights = {w: weight for w in counts if (weight := self.hit(w))}
        odd = [t for t in tokens if INSIDE.search(t)] if INSIDE.search(text) else []
        stretched = [t for t in tokens if STRETCH.search(t)] if STRETCH.search(text) else []
        # A disguised word counts as the word itself does.
        hidden = [x for t in (*odd, *stretched) if (x := self.hit(undone(t))) >= STRONG and x > max(map(self.hit, words_of(t)), default=0.0)] if odd or stretched else []
        strong = {w for w, weight in weights.items() if weight >= STRONG}
        n_strong = sum(counts[w] for w in strong) + len(hidden)
        seconds = sum(counts[w] for w in SECOND if w in counts)
        codes = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        letters = sum(len(w) * many for w, many in counts.items())
        return [
            (sum(counts[w] for w in weights) + len(hidden)) / n, n_strong / n, math.log1p(n_strong), max([*weights.values(), *hidden], default=0.0),
            (sum(counts[w] * x for w, x in weights.items()) + sum(hidden)) / n,
            math.log1p(len(strong)), (near_second(words, strong) if strong and seconds else 0) / n, seconds / n, codes[65:91].sum() / max(1, letters),
            sum(len(t) > 1 for t in filter(str.isupper, tokens)) / n, codes[33] / size, (len(LOUD.findall(text)) if codes[33] + codes[63] > 1 else 0) / n, codes[SIGNS].sum() / size,
            len(odd) / n, len(stretched) / n, len(hidden) / n, math.log1p(n),
        ]


def near_second(words: list[str], strong: set[str]) -> int:
    """How many strong words have a second person within ``REACH`` words before or behind them."""
    places = [i for i, w in enumerate(words) if w in SECOND]
    at = np.array([i for i, w in enumerate(words) if w in strong])
    k = np.searchsorted(places, at)
    padded = np.array([-REACH - 1, *places, len(words) + REACH])
    return int(((at - padded[k] <= REACH) | (padded[k + 1] - at <= REACH)).sum())


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: list[tuple[float, Tree]]  # those of all folds, their weights divided by the number of folds
    margins: np.ndarray
    chances: np.ndarray


def margins(trees: list[tuple[float, Tree]], x: np.ndarray) -> np.ndarray:
    """The weighted sum of the trees' values for each row of ``x``."""
    out = np.zeros(len(x))

    def add(tree: Tree, weight: float, rows: np.ndarray) -> None:
        if isinstance(tree, float):
            out[rows] += weight * tree
            return
        feature, threshold, low, high = tree
        under = x[rows, feature] <= threshold
        add(low, weight, rows[under])
        add(high, weight, rows[~under])

    for weight, tree in trees:
        add(tree, weight, np.arange(len(x)))
    return out


def probabilities(model: Model, texts: list[str], scorer: Scorer | None = None) -> np.ndarray:
    """The chance that each text is toxic."""
    scorer = scorer or Scorer(model.lexicon)
    x = np.array([scorer.features(t) for t in texts]).reshape(len(texts), len(NAMES))
    p = np.interp(margins(model.trees, x), model.margins, model.chances) if len(model.margins) else np.full(len(texts), 0.5)
    return np.where([not t.split() for t in texts], 0.0, p) if len(texts) else p


def lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """The lexicon of each fold's others, then that of all, from (text, label, fold)."""

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts: Counter = Counter()
            for text, label, fold in zip(frame["text"], frame["label"], frame["fold"], strict=True):
                counts.update((t, fold, label) for t in {t for w in set(words_of(text)) for t in terms(w)})
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["term", "fold", "label", "n"])

    sizes = {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    each = [F.sum(F.when((F.col("fold") == k) & (F.col("label") == y), F.col("n")).otherwise(0)).alias(f"n{k}{y}") for k in range(FOLDS) for y in (0, 1)]
    counts = rows.mapInPandas(found, "term string, fold int, label int, n bigint").groupBy("term").agg(*each)
    toxic, other = (sum(F.col(f"n{k}{y}") for k in range(FOLDS)) for y in (1, 0))
    n_toxic, n_other = (sum(n for (_, y), n in sizes.items() if y == want) for want in (1, 0))
    # A term that no fold's lexicon can take needs no way to the driver: its share over all rows is too small.
    odds = ((toxic + 0.5) / (n_toxic + 1)) / ((other + 0.5) / (n_other + 1))
    kept = counts.where(toxic >= LEAST).where(odds >= ODDS / 3).orderBy((odds * toxic).desc(), "term").limit(LEXICON).collect()
    out = []
    for left_out in (*range(FOLDS), None):
        folds = [k for k in range(FOLDS) if k != left_out]
        nt, no = (sum(sizes.get((k, y), 0) for k in folds) for y in (1, 0))
        lexicon = {}
        for r in kept:
            t, o = (sum(r[f"n{k}{y}"] for k in folds) for y in (1, 0))
            share = ((t + 0.5) / (nt + 1)) / ((o + 0.5) / (no + 1))
            if t >= LEAST and share >= ODDS:
                lexicon[r["term"]] = math.log(share)
        out.append(lexicon)
    return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic: 0 or 1)."""
    small_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = lowest_hashes(known, labelled)  # ``labelled`` rows at most, so it may be broadcast
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    rows = written(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")), "labelled")
    *others, lexicon = lexicons(rows)

    def described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(x) for x in others]
        for frame in frames:
            x = [scorers[k].features(t) for t, k in zip(frame["text"], frame["fold"], strict=True)]
            out = pd.DataFrame(np.array(x).reshape(len(x), len(NAMES)), columns=list(NAMES))
            yield out.assign(label=frame["label"].to_numpy(), fold=frame["fold"].to_numpy())

    x = written(rows.mapInPandas(described, ", ".join(f"{n} double" for n in NAMES) + ", label int, fold int").where("words_log > 0"), "features")
    if x.select("label").distinct().count() < 2:
        return Model(lexicon, [], np.array([]), np.array([]))
    with ThreadPoolExecutor(FOLDS) as pool:  # the folds' jobs share the cluster
        each = list(pool.map(lambda k: fit_trees(x.where(F.col("fold") != k), list(NAMES), rounds=ROUNDS), range(FOLDS)))

    @F.pandas_udf("double")
    def margin(fold: pd.Series, *columns: pd.Series) -> pd.Series:
        features, out = np.column_stack([c.to_numpy(np.float64) for c in columns]), np.zeros(len(fold))
        for k in range(FOLDS):
            out[fold == k] = margins(each[k], features[fold == k])
        return pd.Series(out)

    judged = x.select(F.col("label").cast("double").alias("label"), margin("fold", *NAMES).alias("margin"))
    curve = IsotonicRegression(labelCol="label", featuresCol="margin_vector", isotonic=True).fit(VectorAssembler(inputCols=["margin"], outputCol="margin_vector").transform(judged))
    trees = [(weight / FOLDS, tree) for some in each for weight, tree in some]
    return Model(lexicon, trees, np.array(curve.boundaries.toArray()), np.array(curve.predictions.toArray()))


def scores(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.lexicon)
        for texts in parts:
            yield pd.Series(probabilities(model, texts.tolist(), scorer), dtype="float64")

    return score(text)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Every row with ``score`` and ``predicted`` (1: toxic)."""
    small_batches(docs.sparkSession)
    rows = docs.withColumn("__score", scores(model, text_of()))
    return with_results(rows, docs.columns, {"score": F.col("__score"), "predicted": (F.col("__score") >= threshold).cast("int")})


def held_out() -> Column:
    """A third of the ids, by checksum; their labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs.where(~held_out()), labels.where(~held_out()))


def op12_calibrated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on_labels(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
