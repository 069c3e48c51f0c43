"""Quality rules: fixed counts of each text, and a hashed n-gram log-likelihood ratio.

The n-grams are whole words and pairs of neighbouring ones (the last word pairs with the text's end), hashed to ``BUCKETS`` buckets. One multinomial is counted over trusted documents (all that
have quality 1 in the labels), the other over all documents. A bucket's weight is the difference of the smoothed log-probabilities in thousandths, an integer,
so that a document's sum doesn't depend on any order. The sum divided by the number of n-grams is compared
with a threshold. Everything runs in DataFrame functions; a row is never taken apart to be judged, and the
shuffles are those of the texts to their labels, once, and of bucket counts. The weights reach the rows as one array of ``BUCKETS`` integers.

Defined results: a null or blank text has no words, all counts 0, score 0, and fails the base rule; without
labels both multinomials are flat or equal and the ratio is 0, which is kept; repeated rows are judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, read_table, text_of, with_results

BUCKETS = 1 << 16
SMOOTHING = 1.0
#: In thousandths of a natural logarithm a n-gram.
THRESHOLD = -200
WINDOW = 8
#: The symbols that are counted.
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def hashes_of(words: Column) -> Column:
    """A hash of each whole word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def joined_hashes(hashes: Column, apart: int) -> Column:
    """A hash of each item and the one ``apart`` places behind it (0 behind the end)."""
    later = F.slice(hashes, apart + 1, F.greatest(F.size(hashes) - apart, F.lit(0)))
    return F.zip_with(hashes, later, lambda a, b: F.xxhash64(a, F.coalesce(b, F.lit(0).cast("bigint"))))


def bucket_of(h: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def gram_buckets(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Two buckets for each word's hash: its own, and that of it and the next word's."""
    return F.transform(F.concat(hashes, joined_hashes(hashes, 1)), lambda h: bucket_of(h, buckets))


def gram_weights(docs: DataFrame, labels: DataFrame) -> Column:
    """By bucket, thousandths of log(p(trusted) / p(all)), as a constant array; ``BUCKETS`` counts pass the driver."""
    named = F.col("doc_id").cast("string")
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select(named.alias("__key")).distinct().withColumn("__trusted", F.lit(1))
    # Labels grow with the documents, so they are merged at every size. Rows without an id match nothing; they are spread by their text.
    key = F.coalesce(named, F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    marked = docs.select("text", key.alias("__key")).join(trusted.hint("merge"), "__key", "left")
    grams = marked.select("__trusted", hashes_of(words_of(text_of())).alias("hashes")).select(
        "__trusted", F.explode(gram_buckets(F.col("hashes"))).alias("bucket")
    )
    counts = {r["bucket"]: (r["n"], r["t"]) for r in grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count("__trusted").alias("t")).collect()}
    all_n, all_t = (sum(c[k] for c in counts.values()) for k in (0, 1))

    def log_p(count: int, total: int) -> float:
        return math.log((count + SMOOTHING) / (total + SMOOTHING * BUCKETS))

    def weight(n: int, t: int) -> int:
        return round(1000 * (log_p(t, all_t) - log_p(n, all_n))) if all_t else 0

    return F.expr("cast(split('" + ",".join(str(weight(*counts.get(b, (0, 0)))) for b in range(BUCKETS)) + "', ',') as array<int>)")


# Each step of these is a column of its own: an expression that is named twice inside another is also evaluated twice.


def window_hashes(fours: Column, n: Column) -> Column:
    """A hash of each window of ``n`` words, by its first word. ``fours``: hashes of four words, by their first."""
    return F.slice(joined_hashes(fours, WINDOW // 2), 1, F.greatest(n - WINDOW + 1, F.lit(0)))


def placed(hashes: Column) -> Column:
    """(hash, first word) of all windows, sorted, if any two have one hash; else nothing."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(pairs))


def shared(placed: Column) -> Column:
    """Sorted first words of the windows that have a twin. ``placed``: (hash, first word), sorted."""
    twin = lambda p, k: F.coalesce(p["h"] == F.get(placed, k - 1)["h"], F.lit(False)) | F.coalesce(p["h"] == F.get(placed, k + 1)["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(placed, twin), lambda p: p["i"]))


def covered(starts: Column) -> Column:
    """Words in the union of windows that begin at these places: the last counts whole, others up to the next."""
    gaps = F.zip_with(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), starts, lambda b, a: F.least(b - a, F.lit(WINDOW)))
    return F.coalesce(F.aggregate(gaps, F.lit(0), lambda total, gap: total + F.coalesce(gap, F.lit(WINDOW))), F.lit(0))


def judge(docs: DataFrame, weights: Column | None = None, labels: DataFrame | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """Every row with its counts, ``base_failed``, ``score`` (thousandths) and ``kept``; see the contract's names."""
    if weights is None:
        weights = gram_weights(docs, labels)
    text = F.col("__text")
    rows = docs.withColumn("__text", text_of())
    rows = rows.withColumns({"__words": words_of(text), "__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))})
    n = F.size("__words")
    rows = rows.withColumn("__each", hashes_of(F.col("__words")))
    rows = rows.withColumn("__pairs", joined_hashes(F.col("__each"), 1))
    weight_of = lambda h: F.get(weights, bucket_of(h))
    grams = F.zip_with("__each", "__pairs", lambda a, b: weight_of(a) + weight_of(b))
    rows = rows.withColumns({"__fours": joined_hashes(F.col("__pairs"), 2), "__sum": F.aggregate(grams, F.lit(0).cast("bigint"), lambda s, w: s + w)})
    rows = rows.withColumn("__windows", window_hashes(F.col("__fours"), n))
    rows = rows.withColumn("__placed", placed(F.col("__windows")))
    rows = rows.withColumn("__shared", shared(F.col("__placed")))
    rows = rows.withColumn("__repeat", covered(F.col("__shared")).cast("bigint"))
    symbols = F.regexp_replace(text, f"[^{SYMBOLS}]+", "")
    failed = (n < 20) | (100 * F.col("__repeat") > 30 * n)
    return with_results(
        rows,
        docs.columns,
        {
            "n_words": n.cast("bigint"),
            "word_chars": F.length(F.array_join("__words", "")).cast("bigint"),
            "n_symbols": F.length(symbols).cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "n_repeat_words": F.col("__repeat"),
            "base_failed": failed,
            "score": F.when(n > 0, F.col("__sum") / (2 * n)).otherwise(F.lit(0.0)),
            "kept": ~failed & (F.col("__sum") >= threshold * 2 * n),
        },
    )


def op5_ngram_likelihood_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, labels=read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
