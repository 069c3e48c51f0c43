"""Feature vectors, linear discriminants and model scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import Signal
from .blocks import numbered


def feature_vectors(s: Signal, class_tag: str | None = None) -> Signal:
    """Every row as a vector, numbered from 0 in each recording by time, with a class if one is given."""
    rows = numbered(s.df, "rec", "t", [c for c in ("epoch_id", "seq") if c in s.df.columns], name="vec_id")
    tag = F.lit(class_tag) if class_tag is not None else (F.col("label") if "label" in s.df.columns else F.lit(None).cast("string"))
    df = rows.select("rec", "vec_id", tag.alias("class"), *s.channels)
    return replace(s, df=df, kind="vector")


@dataclass(frozen=True)
class Discriminant:
    """A linear score for each class; the largest wins."""

    classes: tuple
    weights: np.ndarray
    offsets: np.ndarray


def fit_lda(df: DataFrame, features: list[str], label: str, ridge: float = 1e-9) -> Discriminant:
    """Counts, means and the pooled covariance: sums of each batch, added up by place; one row a class reaches the driver."""
    low, high = np.triu_indices(len(features))

    def batch_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for of, x in frame.groupby("label"):
                x = x[names].to_numpy(np.float64)
                yield pd.DataFrame({"label": [of], "sums": [np.concatenate([[len(x)], x.sum(0), (x.T @ x)[low, high]])]})

    names = [f"x{i}" for i in range(len(features))]
    x = [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(n) for f, n in zip(features, names, strict=True)]
    found = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), *x)
    kind = found.schema["label"].dataType.simpleString()
    sums = found.mapInPandas(batch_sums, f"label {kind}, sums array<double>").select("label", F.posexplode("sums").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("sums")).orderBy("label").collect()
    each, d = np.array([r["sums"] for r in rows]), len(features)
    counts, total = each[:, 0], each[:, 0].sum()
    means = each[:, 1 : d + 1] / counts[:, None]
    scatter = np.zeros((d, d))
    scatter[low, high] = each[:, d + 1 :].sum(0) - (counts[:, None] * means[:, low] * means[:, high]).sum(0)
    pooled = (scatter + np.triu(scatter, 1).T) / total
    weights = np.linalg.solve(pooled + ridge * np.eye(d), means.T).T
    offsets = np.array([np.log(n / total) for n in counts]) - 0.5 * (weights * means).sum(1)
    return Discriminant(tuple(r["label"] for r in rows), weights, offsets)


def classify(df: DataFrame, features: list[str], model: Discriminant, output: str = "class") -> DataFrame:
    """Every row with ``class``, or with ``p_<class>`` for each class: plain expressions over the features."""
    scores = [sum((F.col(f"`{f}`") * float(w) for f, w in zip(features, row, strict=True)), F.lit(float(o))) for row, o in zip(model.weights, model.offsets, strict=True)]
    rows = df.withColumn("__s", F.array(*scores))
    top = F.array_max("__s")
    if output == "class":
        place = F.array_position("__s", top).cast("int")
        return rows.withColumn("class", F.element_at(F.array(*map(F.lit, model.classes)), place)).drop("__s")
    if output != "probability":
        raise ValueError("output is class or probability")
    powers = F.transform("__s", lambda x: F.exp(x - top))
    rows = rows.withColumn("__e", powers).withColumn("__t", F.aggregate("__e", F.lit(0.0), lambda a, b: a + b))
    return rows.select(*df.columns, *[(F.col("__e")[i] / F.col("__t")).alias(f"p_{c}") for i, c in enumerate(model.classes)])


def apply_model(df: DataFrame, features: list[str], predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``class`` by any function from an array of rows to classes, such as a loaded model's."""
    @F.pandas_udf("string")
    def scored(*columns: pd.Series) -> pd.Series:
        return pd.Series([str(x) for x in predict(np.column_stack([c.to_numpy(float) for c in columns]))])

    return df.withColumn("class", scored(*[F.col(f"`{f}`") for f in features]))
