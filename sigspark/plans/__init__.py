"""The named queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import signals


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(signals.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(signals.SQL)
