"""Exact deduplication against a persistent digest index.

The index is a table of one row per distinct text, bucketed and sorted by the text's SHA-256. A batch is
grouped by digest, the digests that the index lacks are found by a sort-merge anti-join (the bucketed side
is not shuffled), appended, and the batch's rows then read their verdict from the index.

Recovery: a batch has a name. If a job dies behind its append and is run again with the same name and rows, the index
knows the batch's texts as its own, adds nothing, and gives the same verdicts.

Skew: a text may make up a third of all rows, with ids of their own, with one id or without any. Rows get a number each and
are written once to the shared folder (``row_numbers``). Verdicts on texts are grouped with a partial aggregation, so that a
hot text is one row a map task, and go back to the rows by (digest, salt), the salt coming from the row's number
(``spread_join``): a hot text's rows fill all tasks, whatever their ids. Of rows that repeat both id and text, the one with the
smallest number stays; no window is needed to find it.

Defined results: a null text is the empty text; null ids sort below all others, so they stay only if the
text has no row with an id; of rows that repeat both id and text exactly one stays; an empty table gives an
empty result. Input columns pass through, but for those that have a result's name, which are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh_path, read_table, remove, row_numbers, spread_join, text_of, with_results, written

INDEX_SCHEMA = "digest binary, keep_id bigint, batch string"


class DigestIndex:
    """A table (digest, keep_id, batch), bucketed and sorted by digest, in the folder that the cluster shares.

    ``path`` names an index made earlier with as many ``buckets``; without it a new, empty one is made.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark, "digests")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"digest_index_{uuid.uuid4().hex}"
        if path is None:
            self._write(spark.createDataFrame([], INDEX_SCHEMA))
        else:
            spark.sql(
                f"CREATE TABLE {self.table} ({INDEX_SCHEMA}) USING parquet LOCATION '{path}' "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
            )

    def _write(self, df: DataFrame) -> None:
        (
            df.write.format("parquet")
            .mode("append")
            .option("path", self.path)
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.table)
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self, delete: bool = False) -> None:
        """Forget the table's name in this session's catalog; with ``delete`` its files go, too."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if delete:
            remove(self.spark, self.path)

    def missing(self, digests: DataFrame) -> DataFrame:
        """Those of ``digests`` that the index lacks."""
        return digests.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, digests: DataFrame, batch: str) -> None:
        """Add what the index lacks of (digest, keep_id); a second call with the same rows adds nothing."""
        new = self.missing(digests).select("digest", "keep_id", F.lit(batch).alias("batch"))
        self._write(new.repartition(self.buckets, "digest"))


def digested(docs: DataFrame) -> DataFrame:
    """``docs`` with the digest of each text, which is all that verdicts depend on beside the id."""
    return docs.withColumn("__digest", F.unhex(F.sha2(text_of(), 256)))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``keep_id``: the id of the row that stays, the largest of its text in the batch that brought the text
    first. ``group_size``: this batch's rows with the text. A text of another batch keeps no row. ``batch`` names this
    one; without a name every call is a batch of its own. Without ``index`` one is made for this call alone.
    """
    return verdicts(digested(docs), docs.columns, index, batch)


def verdicts(rows: DataFrame, columns: list[str], index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """``exact_dedup`` for rows that are digested; ``columns`` of theirs pass through."""
    own = index is None
    index = index or DigestIndex(rows.sparkSession)
    batch = batch or uuid.uuid4().hex
    rows = row_numbers(rows, "digested")
    top = F.max(F.struct("doc_id", (-F.col("__row")).alias("o")))  # a null id is the least
    texts = rows.groupBy(F.col("__digest").alias("digest")).agg(top.alias("top"), F.count(F.lit(1)).alias("n"))
    texts = written(texts.select("digest", F.col("top.doc_id").alias("keep_id"), (-F.col("top.o")).alias("first"), "n"), "texts")
    index.append(texts.select("digest", "keep_id"), batch)
    known = texts.drop("keep_id").join(index.rows().hint("merge"), "digest")
    kept = F.when(F.col("batch") == batch, F.col("first"))
    known = written(known.select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"), F.col("n").alias("__n"), kept.alias("__first")), "known")
    discard(texts)
    if own:
        index.close(delete=True)
    found = spread_join(rows, known, "__digest", "__row", finer=16)
    return with_results(
        found,
        columns,
        {"keep_id": F.col("__keep"), "group_size": F.col("__n"), "kept": F.coalesce(F.col("__row") == F.col("__first"), F.lit(False)), "text_sha256": F.lower(F.hex("__digest"))},
    )


def distinct_texts(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they came with."""
    marked = docs.withColumn("__whole", F.struct("*")).select("__whole", "doc_id", "text")
    return exact_dedup(marked, index, batch).where("kept").select("__whole.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = digested(docs).select("doc_id", "__digest")  # texts themselves need not be written
    return verdicts(rows, ["doc_id"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
