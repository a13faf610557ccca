"""Small helpers the operators of this folder share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; always through Spark, so that any store Spark can read will do."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def held_out(key: str = "doc_id") -> Column:
    """Rows never learned from: the CRC-32 of the key as text leaves 2 when divided by 4. A NULL key counts as held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sampled(df: DataFrame, rows: int, salt: str = "sample") -> DataFrame:
    """About ``rows`` different rows of ``df``, chosen by a hash of all columns: the same ones however the table is partitioned.

    Only for fitting; the bound keeps what reaches the driver fixed whatever the size of ``df``. Rows that share an id
    are drawn each on their own, and equal rows among the drawn, which come together, once.
    """
    total = df.count()
    if total <= rows:
        return df
    slots = 1 << 30
    drawn = df.where(F.pmod(F.xxhash64(*df.columns, F.lit(salt)), F.lit(slots)) < int(slots * rows / total))
    return drawn.distinct()


def groups_of(texts: list[str], most_rows: int = 256, most_chars: int = 1 << 22) -> Iterator[list[str]]:
    """Texts in runs of bounded rows and characters, so that working arrays stay small; a longer text is a run alone."""
    run: list[str] = []
    chars = 0
    for text in texts:
        if run and (len(run) >= most_rows or chars + len(text) > most_chars):
            yield run
            run, chars = [], 0
        run.append(text)
        chars += len(text)
    if run:
        yield run


def lean(compute: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches, called for one batch after the other, that gives its memory back to the system in between.

    For functions that keep nothing from batch to batch. Spark keeps Python workers for the next stages; without this
    each would go on holding as much as its largest batch took.
    """

    @wraps(compute)
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            yield from compute(iter((batch,)))
            del batch
            give_back()

    return run


def give_back() -> None:
    """Give memory that is not used any more back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
