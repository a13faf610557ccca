"""Jobs cut into chunks of which one may fail without the others."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newsreach.sources import commits
from newsreach.sources.workspace import discard

# Chunks of a job at most; their ledger entries are read by the driver
MOST_CHUNKS = 100_000

ENTRY = "chunk string, state string, attempt int, rows long, error string, name string"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Every attempt at every chunk: ``chunk, state`` (done or failed), ``attempt, rows, error, name``."""
    if not commits.exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json(f"{path}/ledger/*.json")


def run_chunks(
    df: DataFrame, chunk: str, path: str, work: Callable[[DataFrame], DataFrame], together: int = 4
) -> dict[str, list[str]]:
    """Apply ``work`` to each chunk of rows that is not done yet, and commit each by itself; the chunks done and failed now.

    ``chunk`` is a column whose values the source can prune by, such as a partition or a key range; NULL is a chunk too. A
    chunk that fails is noted with its error and its attempt, the others go on, and the next run takes the open chunks only.
    Results of a failed or interrupted attempt are never read. ``together`` chunks run at a time.
    """
    spark = df.sparkSession
    entries = ledger(spark, path).select("chunk", "state", "attempt").collect()
    done = {r["chunk"] for r in entries if r["state"] == "done"}
    attempts = {c: max(r["attempt"] for r in entries if r["chunk"] == c) for c in {r["chunk"] for r in entries}}
    values = [r[0] for r in df.select(chunk).distinct().limit(MOST_CHUNKS + 1).collect()]
    if len(values) > MOST_CHUNKS:
        raise ValueError(f"more than {MOST_CHUNKS} chunks")
    found: dict[str, list[str]] = {"done": [], "failed": []}

    def one(value: object) -> tuple[str, str]:
        label, name = str(value), uuid.uuid4().hex
        attempt = attempts.get(label, 0) + 1
        entry = {"chunk": label, "attempt": attempt, "name": name, "state": "done", "rows": 0}
        try:
            seen = Observation()
            part = work(df.where(F.col(chunk).eqNullSafe(F.lit(value))))
            part.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(f"{path}/data/{name}")
            entry["rows"] = seen.get["rows"]
        except Exception as error:  # noqa: BLE001 - whatever it is, the other chunks go on
            discard(spark, f"{path}/data/{name}")
            entry |= {"state": "failed", "error": f"{type(error).__name__}: {error}"[:2000]}
        commits.put_new(spark, f"{path}/ledger/{name}.json", json.dumps(entry))
        return entry["state"], label

    with ThreadPoolExecutor(together) as pool:
        for state, label in pool.map(one, [v for v in values if str(v) not in done]):
            found[state].append(label)
    return found


def read_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all chunks that are done; None before the first is."""
    names = [r["name"] for r in ledger(spark, path).where("state = 'done'").select("name").collect()]
    return spark.read.parquet(*[f"{path}/data/{name}" for name in names]) if names else None
