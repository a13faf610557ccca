"""The shared folder for written intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

# Paths of the stored tables; inside a ``scope`` those of the scope, else those of the process
_stored: list[str] = []
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without the setting (tests) gets a temporary folder of this machine.
    """
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="newsreach-")
    spark.conf.set(SETTING, folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept_path(spark: SparkSession, name: str) -> str:
    """A fresh path that is deleted together with the stored tables."""
    path = fresh_path(spark, name)
    (_scopes.get() or (_stored,))[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    Used where several branches of a plan need one expensive intermediate result. The written table
    outlives executors, so a lost executor costs a re-read and not a recomputation.
    """
    path = kept_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> bool:
    """Delete a folder that is not needed any more; whether there was one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def release(spark: SparkSession) -> None:
    """Have the driver give up what nothing refers to any more, and Spark the broadcasts and shuffles that hang on it."""
    gc.collect()
    spark._jvm.System.gc()


def copy(spark: SparkSession, source: str, path: str) -> None:
    """Copy a folder to a path where nothing is yet."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    old, new = hadoop.Path(source), hadoop.Path(path)
    hadoop.FileUtil.copy(old.getFileSystem(conf), old, new.getFileSystem(conf), new, False, conf)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the ``with`` block are deleted at its end, and no others.

    Write the results that rest on them inside the block. Scopes may be nested, and each thread has its own.
    """
    mine: list[str] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in mine:
            discard(spark, path)


def drop_materialized(spark: SparkSession) -> int:
    """Delete the intermediate tables this process has stored outside of any ``scope``; gives their number.

    Call it once all results that rest on them have been written; a ``scope`` deletes those of one result only.
    """
    dropped = 0
    while _stored:
        dropped += discard(spark, _stored.pop())
    return dropped
