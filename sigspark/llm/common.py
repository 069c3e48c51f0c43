"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words, for a Java character class (fixed values).
SPACE = r"\x20\x09-\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Let Arrow batches hold few rows, as a text may be very long; a smaller number that the user set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def lowest_hashes(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the lowest hashes (all, if there are fewer): a sample that does not depend on partitions.

    The rows are counted first, so that few more than ``n`` are sorted, whatever the input's size.
    """
    mark = F.xxhash64(*rows.columns)
    total = rows.count()
    share = (1.2 * n + 1000) / max(total, 1)
    few = rows.where(mark < int(-(2**63) + share * 2**64)) if share < 1 else rows
    return few.orderBy(mark, *rows.columns).limit(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is unset, a session of one machine (``local``) takes a temporary folder; on a cluster it is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("sigspark.shared.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sigspark-")
        spark.conf.set("sigspark.shared.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; those of one application lie in a folder of its own, to be removed behind it."""
    return f"{shared_dir(spark)}/sigspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` that nothing reads any more."""
    for table in tables:
        for place in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            remove(table.sparkSession, place)


def remove(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, by: str, how: str = "inner", finer: int = 1) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a ``key``, so that no task gets all rows of a hot key.

    Rows are dealt by (key, salt), the salt coming from column ``by``. The pairs that occur, at most one row a pair and
    map task, meet ``keyed`` first; there are ``finer`` times as many salts as shuffle partitions, so a hot key fills
    all of them, the more evenly the finer.
    """
    salts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8) * finer
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    shares = salted.select(key, "__salt").distinct().join(keyed, key)
    return salted.join(shares, [key, "__salt"], how).drop("__salt")


def row_numbers(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``__row``, a number of its own for each, written to the shared folder, so that a row has the same number
    whenever it is read again. What tells apart rows that repeat each other goes by it."""
    return written(rows.withColumn("__row", F.monotonically_increasing_id()), name)


def copy_numbers(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (with ``__row``) with ``__copy``: 1, 2, ... among those of one ``key``.

    Rows are numbered within (key, part of the input); from part to part goes one row a key and part. So no
    task holds all rows of a hot key.
    """
    rows = rows.withColumn("__part", F.shiftright("__row", 33))
    shares = rows.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(key, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(key, "__part").orderBy("__row"))
    return rows.join(shares, [key, "__part"]).withColumn("__copy", F.col("__before") + nth).drop("__part", "__before")


def with_results(df: DataFrame, source: list[str], results: dict[str, Column]) -> DataFrame:
    """The input's columns and the results; a result replaces an input column of the same name (in any case)."""
    taken = {name.lower() for name in results}
    kept = [F.col(f"`{c}`") for c in source if c.lower() not in taken]
    return df.select(*kept, *[column.alias(name) for name, column in results.items()])
