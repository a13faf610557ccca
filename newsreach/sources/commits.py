"""Numbered commit files: small texts of which each appears whole or not at all, and none twice.

They say which data files belong together: versions of published tables, segments of an event log, finished chunks of a
job. A writer first writes its data where nobody looks and then puts the next number; if another was faster, it sees that.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target = _path(spark, path)
    return bool(_system(spark, target).exists(target))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, ascending; none if there is no such folder."""
    target = _path(spark, folder)
    if not exists(spark, folder):
        return []
    return sorted(status.getPath().getName() for status in _system(spark, target).listStatus(target))


def read_text(spark: SparkSession, path: str) -> str:
    target = _path(spark, path)
    stream = _system(spark, target).open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not exist yet; False if it does. Nobody ever sees a part of it."""
    target, staged = _path(spark, path), _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    system = _system(spark, target)
    system.mkdirs(target.getParent())
    stream = system.create(staged, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(system.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    kinds = getattr(fs, "Options$Rename")
    options = spark._sc._gateway.new_array(kinds, 1)
    options[0] = kinds.NONE
    try:
        context.rename(system.makeQualified(staged), system.makeQualified(target), options)
        return True
    except Exception:
        system.delete(staged, False)
        if exists(spark, path):
            return False
        raise


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers committed below ``folder``, ascending."""
    return [int(name[:-5]) for name in names(spark, folder) if name.endswith(".json") and name[:-5].isdigit()]


def load(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, dict]:
    """(number, content) of a commit, the latest by default; (0, {}) if there is none."""
    if version is None:
        version = max(versions(spark, folder), default=0)
    return (version, json.loads(read_text(spark, f"{folder}/{version:020d}.json"))) if version else (0, {})


def commit(spark: SparkSession, folder: str, version: int, content: dict) -> bool:
    """Put commit number ``version``; False if somebody else has."""
    return put_new(spark, f"{folder}/{version:020d}.json", json.dumps(content))
