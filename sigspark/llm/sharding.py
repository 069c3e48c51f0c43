"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows fall by a seeded hash into cells (logical partitions that do not depend on how the input was read).
From the cells' counts the driver draws how many rows each cell sends to each shard: row by row of the
matrix, multivariate hypergeometric, so that columns add up to the shard sizes, which differ by one at
most. Rows are permuted within their cell, dealt by the matrix, and permuted again within their shard. Only
the matrix passes the driver: ``MATRIX`` numbers at most, whatever the input's size.

The second permutation goes by a random key. A shard is cut by ranges of that key into pieces of about
``ROWS_PER_TASK`` rows, each a window of its own; the pieces' sizes, summed in order, give where they begin.

Skew: rows that repeat both id (null, too) and text may make up a third of all. They are numbered among themselves, and that
number is part of the hash, so that copies spread over cells and pieces like other rows. For that the rows are
written once, with a number each (``row_numbers``).

Defined results: null texts have size 1 and checksum 0; null ids are rows like others; rows that repeat
are each dealt; an empty table gives an empty result; input columns pass through but for those named as a result.
A row's place depends on its id, text and the seed; those of rows that repeat, as a whole, do so, too.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import copy_numbers, read_table, row_numbers, text_of, with_results, written

ROWS_PER_TASK = 16_384
MATRIX = 1 << 23
SEED = 20_240_229
#: What NumPy draws from at most.
LIBRARY = 10**9


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows each cell sends to each shard; rows add up to ``counts``, columns to near-equal sizes."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for i, n in enumerate(counts):
        out[i] = _draw(rng, left, n)
        left -= out[i]
    return out


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """One multivariate hypergeometric draw: ``n`` of the places that are left, colour by colour."""
    out, rest = np.zeros_like(left), int(left.sum())
    for s, have in enumerate(left.tolist()):
        rest -= have
        out[s] = drawn(rng, have, rest, n)
        n -= int(out[s])
    return out


def drawn(rng: np.random.Generator, have: int, rest: int, n: int) -> int:
    """How many of ``n`` places drawn from ``have`` + ``rest`` are of the first kind: hypergeometric at any size.

    Beyond the library's range every place is first taken with probability n / (have + rest), on its own: two binomial
    counts. Given how many were taken, all choices are equally likely, so those taken too many are given back by
    the same kind of draw among them, or those lacking are drawn from the places that were not taken. Either draw
    is for about the square root of ``n`` places.
    """
    if n == 0 or have == 0:
        return 0
    if have + rest < LIBRARY:
        return int(rng.hypergeometric(have, rest, n))
    if 2 * n > have + rest:
        return have - drawn(rng, have, rest, have + rest - n)
    if n <= 32:
        found = 0
        for i in range(n):
            found += int(rng.integers(have + rest - i)) < have - found
        return found
    share = n / (have + rest)
    a, b = int(rng.binomial(have, share)), int(rng.binomial(rest, share))
    if a + b >= n:
        return a - drawn(rng, a, b, a + b - n)
    return a + drawn(rng, have - a, rest - b, n - a - b)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the size and the checksum of each text, which is all of a text that its place depends on."""
    return docs.withColumns({"__size": F.octet_length(text_of()).cast("long") + 1, "__crc": F.crc32(F.encode(text_of(), "UTF-8"))})


def shard(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """Every row with ``size``, ``text_crc32``, ``shard`` and ``slot`` (its place in the shard, gapless from 0)."""
    return deal(measured(docs), docs.columns, shards, seed)


def deal(rows: DataFrame, columns: list[str], shards: int, seed: int) -> DataFrame:
    """``shard`` for rows that are measured; ``columns`` of theirs pass through."""
    spark = rows.sparkSession
    identity = [F.col("doc_id"), F.col("__size"), F.col("__crc")]
    rows = copy_numbers(row_numbers(rows.withColumn("__same", F.xxhash64(*identity)), "measured"), "__same")
    first = F.col("__copy") == 1
    rows = rows.withColumns({f"__r{k}": F.when(first, F.xxhash64(F.lit(seed + k), *identity)).otherwise(F.xxhash64(F.lit(seed + k), *identity, F.col("__copy"))) for k in range(3)})
    rows = written(rows.drop("__row", "__same"), "copies")

    total = rows.count()
    most = 1 << max(3, (MATRIX // max(1, shards)).bit_length() - 1)
    cells = min(most, 1 << max(3, math.ceil(math.log2(max(1, total / ROWS_PER_TASK))) + 3))
    cell = F.pmod(F.col("__r0"), F.lit(cells))
    sizes = sorted(rows.groupBy(cell.alias("cell")).count().collect())
    matrix = communication_matrix([r["count"] for r in sizes], shards, seed)
    ends = [(r["cell"], row.tolist()) for r, row in zip(sizes, matrix.cumsum(axis=1), strict=True)]
    dealt = spark.createDataFrame(ends, "__cell bigint, __ends array<bigint>")

    # The local permutation, and the exchange: a row's rank in its cell decides its shard.
    order = [F.col(c) for c in ("__r1", "doc_id", "__size", "__crc", "__copy")]
    ranked = rows.withColumn("__cell", cell).withColumn("__rank", F.row_number().over(Window.partitionBy("__cell").orderBy(*order)))
    sent = ranked.join(F.broadcast(dealt), "__cell").withColumn(
        "__shard", F.size(F.filter("__ends", lambda end: end < F.col("__rank"))).cast("int")
    )

    # The permutation within the shard, piece by piece along the random key.
    pieces = max(1, math.ceil(total / shards / ROWS_PER_TASK))
    pieces = min(most, max(pieces, 8))
    piece = F.floor(F.shiftrightunsigned("__r2", 33) * F.lit(pieces) / F.lit(float(1 << 31))).cast("int")
    sent = sent.withColumn("__piece", piece)
    per_piece = sent.groupBy("__shard", "__piece").count()
    begins = per_piece.select(
        "__shard",
        "__piece",
        (F.sum("count").over(Window.partitionBy("__shard").orderBy("__piece")) - F.col("count")).alias("__begin"),
    )
    order = [F.col(c) for c in ("__r2", "doc_id", "__size", "__crc", "__copy")]
    nth = F.row_number().over(Window.partitionBy("__shard", "__piece").orderBy(*order))
    placed = sent.withColumn("__nth", nth).join(F.broadcast(begins), ["__shard", "__piece"])  # MATRIX rows at most
    return with_results(
        placed,
        columns,
        {"size": F.col("__size"), "text_crc32": F.col("__crc"), "shard": F.col("__shard"), "slot": F.col("__begin") + F.col("__nth") - 1},
    )


def op9_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = measured(docs).drop("text")  # texts themselves need not be written
    return deal(rows, rows.columns, 8, SEED).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
