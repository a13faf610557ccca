"""Range-partitioned database extract."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def slice_count(lo: int, hi: int, width: int) -> int:
    """Number of key ranges of ``width`` that cover ``lo`` to ``hi``."""
    return max(1, -(-(hi - lo) // width))


def read_partitioned(
    spark: SparkSession, url: str, table: str, key: str, lo: int, hi: int, width: int,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """JDBC table read as key ranges of ``width``, one task each.

    ``table`` may be a sub-query, so that an aggregation runs at the source; ranges are cut by entity and
    never by time, hence a distinct count never spans two of them. Rows outside ``lo`` to ``hi`` go to the
    first and last range, not lost. How many ranges run at once is ``spark.executor.cores``' business.
    """
    reader = spark.read.options(**dict(options or {}))
    return reader.jdbc(
        url=url, table=table, column=key, lowerBound=lo, upperBound=hi, numPartitions=slice_count(lo, hi, width),
        properties={},
    )


def key_slices(df: DataFrame, key: str, lo: int, width: int, out: str = "slice") -> DataFrame:
    """The same ranges for a file source: rows and distinct keys per slice (S1, offline form)."""
    number = F.floor((F.col(key) - F.lit(lo)) / width)
    per_key = df.groupBy(number.alias(out), key).agg(F.count(F.lit(1)).alias("__rows"))
    return per_key.groupBy(out).agg(F.sum("__rows").alias("rows"), F.count(F.lit(1)).alias("keys"))
