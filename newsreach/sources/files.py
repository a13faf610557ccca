"""File sources and sinks."""

from __future__ import annotations

import csv
import uuid
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsreach.sources import commits
from newsreach.sources.workspace import discard, materialize


def read_table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table of a folder, limited to the columns asked for."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df if columns is None else df.select(*columns)


# Keys up to this many travel to the tasks
KEY_ROWS = 1_000_000


def rows_of(df: DataFrame, columns: Sequence[str], keys: DataFrame) -> DataFrame:
    """Rows of a table whose ``columns`` are among ``keys`` (as many columns); NULL is none.

    The keys are stored and counted. Up to ``KEY_ROWS`` of them travel to the tasks, so a long table is filtered where it
    lies; more are joined as Spark plans it.
    """
    names = [f"__key{i}" for i in range(len(columns))]
    known = materialize(keys.toDF(*names).distinct(), "keys")
    few = F.broadcast(known) if known.count() <= KEY_ROWS else known
    return df.join(few, [F.col(column) == F.col(name) for column, name in zip(columns, names)], "left_semi")


# Files whose first lines are read at a time, and bytes of a first line at most
HEADER_READERS = 16
HEADER_BYTES = 1 << 20


def _first_line(spark: SparkSession, path: str) -> str:
    """First line of a plain or gzip file; no more than its first block is read."""
    java, target = spark._jvm.java.io, spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        raw = spark._jvm.java.util.zip.GZIPInputStream(stream) if path.endswith(".gz") else stream
        reader = java.BufferedReader(java.InputStreamReader(raw, "UTF-8"), 1 << 13)
        line = reader.readLine() or ""
        if len(line) > HEADER_BYTES:
            raise ValueError(f"{path} begins with a line of {len(line)} characters")
        return line.removeprefix("\ufeff")
    finally:
        stream.close()


def _headers(spark: SparkSession, pattern: str) -> dict[tuple[str, ...], list[str]]:
    """Files of a glob, grouped by their header: a catalogue of first lines, read side by side without any Spark job.

    A header is one line; its names may be quoted. Empty files have none and no rows.
    """
    paths = sorted(spark.read.text(pattern).inputFiles())
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        for path, line in zip(paths, pool.map(lambda path: _first_line(spark, path), paths)):
            header = next(csv.reader([line]), [])
            if header:
                groups[tuple(header)].append(path)
    return groups


def read_csv_glob(spark: SparkSession, pattern: str, types: Mapping[str, str] | None = None) -> DataFrame:
    """CSV parts (plain or gzip) as one table, columns matched by name.

    Spark's reader maps columns by position, so parts with another header order would silently land in
    wrong columns. Parts are therefore read per distinct header and united by name; a missing column is
    NULL. Quotes are doubled, fields may hold line breaks, and an unquoted empty field is NULL. Without
    ``types`` they are inferred per header, which costs a pass over the files.

    The first lines of all files are catalogued first, so the number of jobs is that of the distinct headers. As fields may
    hold line breaks, each file is one task; a gzip file is so in any case. Write many files of some 100 MB.
    """
    parts = []
    for header, paths in sorted(_headers(spark, pattern).items()):
        reader = (
            spark.read.option("header", True)
            .option("multiLine", True)
            .option("escape", '"')
            .option("emptyValue", "")
            .option("nullValue", None)
        )
        if types is None:
            parts.append(reader.option("inferSchema", True).csv(paths))
        else:
            schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
            raw = reader.schema(schema).csv(paths)
            parts.append(raw.select(*[F.col(c).cast(types.get(c, "string")).alias(c) for c in header]))
    if not parts:
        raise FileNotFoundError(pattern)
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part, allowMissingColumns=True)
    return united


def write_table(df: DataFrame, path: str, order: Sequence[str] = (), partition_by: Sequence[str] = ()) -> DataFrame:
    """Parquet with ZSTD, rows in key order inside each file so that key ranges skip row groups."""
    if order:
        df = df.sortWithinPartitions(*order)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_if_absent(df: DataFrame, path: str) -> DataFrame:
    """First version of a derived table: written only if there is none yet."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        write_table(df, path)
    return spark.read.parquet(path)


def write_csv_gz(df: DataFrame, path: str) -> int:
    """Gzip CSV with header; the commit protocol makes it all or nothing. Gives the row count.

    The rows are counted while they are written, without a second pass.
    """
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").option("header", True).option("compression", "gzip").option("escape", '"').option(
        "emptyValue", '""'
    ).csv(path)
    return seen.get["rows"]


def publish(
    tables: Mapping[str, DataFrame], folder: str, unique: Mapping[str, Sequence[str]] | None = None, required: Sequence[str] | None = None
) -> dict[str, int]:
    """Full refresh of serving tables as one version; gives the rows written per table.

    All tables are written where nobody reads, then checked: each that is ``required`` (by default, each of the version
    before) is there, none has lost rows on the way, and the ``unique`` keys are. Only then the next numbered pointer is put,
    which readers resolve with ``published``; they see the version before or after it, whole. Any failure leaves the old
    tables as they are and its own files are deleted.
    """
    if not tables:
        raise ValueError("nothing to publish")
    spark = next(iter(tables.values())).sparkSession
    version, current = commits.load(spark, f"{folder}/versions")
    missing = set(current.get("tables", {}) if required is None else required) - set(tables)
    if missing:
        raise ValueError(f"tables missing from the version: {sorted(missing)}")
    name = uuid.uuid4().hex
    rows = {}
    try:
        for table, df in tables.items():
            seen = Observation()
            counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            path = f"{folder}/data/{name}/{table}"
            counted.write.option("compression", "zstd").parquet(path)
            rows[table] = seen.get["rows"]
            written = spark.read.schema(df.schema).parquet(path)
            if written.count() != rows[table]:
                raise ValueError(f"{table}: {written.count()} rows written of {rows[table]}")
            keys = (unique or {}).get(table)
            if keys and not written.groupBy(*keys).count().where("count > 1").isEmpty():
                raise ValueError(f"{table}: repeated keys {list(keys)}")
        content = {"tables": {table: f"data/{name}/{table}" for table in tables}, "rows": rows}
        if not commits.commit(spark, f"{folder}/versions", version + 1, content):
            raise RuntimeError(f"version {version + 1} of {folder} was published by somebody else meanwhile")
    except Exception:
        discard(spark, f"{folder}/data/{name}")
        raise
    return rows


def published(spark: SparkSession, folder: str, table: str, version: int | None = None) -> DataFrame:
    """A published table of the latest version, or of an earlier one; ask for several with one ``version``."""
    number, content = commits.load(spark, f"{folder}/versions", version)
    if table not in content.get("tables", {}):
        raise FileNotFoundError(f"{table} in version {number} of {folder}")
    return spark.read.parquet(f"{folder}/{content['tables'][table]}")


def missing_rows(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has no result yet."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def run_missing(df: DataFrame, path: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``work`` to rows that have no result below ``path`` and append what it gives.

    A failed run leaves complete rows only, and the next run takes up what is missing.
    """
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    todo = missing_rows(df, spark.read.parquet(path), keys) if exists else df
    work(todo).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def write_metrics(df: DataFrame, path: str) -> DataFrame:
    """Metrics as JSON lines."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)
