"""Tables as streams: landed in files that come in order, run to their end, and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def landed(df: DataFrame, by: str, per_part: int, parts: int) -> DataFrame:
    """``df`` (rec, ...) as a stream of files. Rows of a recording come in the order of ``by``, cut after every ``per_part`` of
    it; what lies beyond ``parts`` comes with the last part."""
    spark = df.sparkSession
    place = shared_folder(spark, "landed")
    part = F.least(F.floor(F.col(by) / per_part), F.lit(parts - 1))
    for i in range(parts):
        # A recording's rows of one part lie in one file, so that no trigger sees a later one before them.
        df.where(part == i).repartition("rec").write.parquet(f"{place}/{i:04d}")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{place}/*")


def played(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What a streaming query gives from its sources' beginning to their end, as a table. ``make`` builds the query, under
    a state store that has maps and lists."""
    place, before = shared_folder(spark, "played"), spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        df = make()
        query = df.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(df.schema).parquet(f"{place}/rows")
