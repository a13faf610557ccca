"""The event table as a log of changes, kept up to date in micro-batches.

A table is a base and segments of changes after it; a numbered manifest names them in order, with the batches they
hold and the number of buckets of the base. A batch is one new segment and one new manifest: no stored file is rewritten, a
reader sees the table before or after it, and a batch that is replayed is found in the manifest and skipped. Readers
fold the rows of each key: the first gives id and whatever a fetch does not bring, the last the fetched columns, the
last that has one the location and the score. Folding neighbouring segments gives a segment of the same form, so the
newest ones are merged once there are several, and all with the base once they have grown to a part of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsreach.operators.events import EVENT_KEY, UPDATED, collapse_batch, has_key, rescore_stale, stale, with_event_text
from newsreach.sources import commits
from newsreach.sources.workspace import discard, materialize

# Rows of a bucket of the base, about
BUCKET_ROWS = 1_000_000
# Segments after the base from which the newest are merged; one joins the merge up to this many times its size so far
MERGE_SEGMENTS = 8
MERGE_FACTOR = 2
# The base is rewritten once the changes have this part of its rows
BASE_PART = 0.25
# Batches without a number are known by their content, as many as this
KNOWN_BATCHES = 1000

SCORE = ("score", "scored_text")
HIDDEN = "__loose string, __has boolean, __scored boolean"


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _whole(events: DataFrame, key: Sequence[str], has: bool = True, scored: bool = True) -> DataFrame:
    """Rows of a segment; those without a key get a name of their own, as they conflict with nothing."""
    name = F.concat(F.lit(uuid.uuid4().hex), F.monotonically_increasing_id().cast("string"))
    return events.withColumns({"__loose": F.when(~has_key(key), name), "__has": F.lit(has), "__scored": F.lit(scored)})


def _fold(rows: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """One row per key of segments in order ``__at``, in the form of a segment."""
    score = [c for c in SCORE if c in columns]
    rest = [c for c in columns if c not in (*key, *UPDATED, *score)]
    here, scored = F.when(F.col("__has"), F.col("__at")), F.when(F.col("__scored"), F.col("__at"))
    located = F.when(F.col("__has") & (F.col("location") != ""), F.col("location"))
    found = rows.groupBy(*key, "__loose").agg(
        F.min_by(F.struct(*rest), here).alias("__first"),
        F.max_by(F.struct(*UPDATED), here).alias("__last"),
        F.max_by(located, F.when(located.isNotNull(), F.col("__at"))).alias("__location"),
        *([F.max_by(F.struct(*score), scored).alias("__score")] if score else []),
        F.max("__has").alias("__has"), F.max("__scored").alias("__scored"),
    )
    values = {c: F.col(f"__first.{c}") for c in rest} | {c: F.col(f"__last.{c}") for c in UPDATED} | {c: F.col(f"__score.{c}") for c in score}
    values["location"] = F.coalesce("__location", "__first.location")
    return found.select(*key, *[values[c].alias(c) for c in columns if c not in key], "__loose", "__has", "__scored")


def _segments(spark: SparkSession, path: str, manifest: dict, parts: Sequence[dict]) -> DataFrame:
    schema = T.StructType.fromJson(manifest["schema"])
    found = None
    for part in parts:
        rows = spark.read.schema(schema).parquet(f"{path}/data/{part['name']}").select(*schema.names).withColumn("__at", F.lit(part["at"]))
        found = rows if found is None else found.unionByName(rows)
    return found


def _write(rows: DataFrame, path: str, key: Sequence[str], buckets: int = 0) -> tuple[str, int]:
    """(name, rows) of a new segment: a base in buckets, or changes in as many files as they need."""
    name = uuid.uuid4().hex
    if buckets:
        rows.withColumn("__bucket", _bucket(key, buckets)).repartition(buckets, "__bucket").write.option("compression", "zstd").partitionBy(
            "__bucket").parquet(f"{path}/data/{name}")
    else:
        rows.write.option("compression", "zstd").parquet(f"{path}/data/{name}")
    return name, rows.sparkSession.read.parquet(f"{path}/data/{name}").count()


def create_state(events: DataFrame, path: str, key: Sequence[str] = EVENT_KEY, buckets: int | None = None) -> None:
    """Begin the log with ``events`` as its base; a log that is there already goes on from them."""
    spark = events.sparkSession
    rows = _whole(events, key)
    # all fields may be missing in a change
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    buckets = buckets or max(1, -(-events.count() // BUCKET_ROWS))
    name, count = _write(rows, path, key, buckets)
    while True:
        version, old = commits.load(spark, f"{path}/manifest")
        content = {
            "schema": schema.jsonValue(), "columns": events.columns, "key": list(key), "buckets": buckets, "last": 0,
            "segments": [{"name": name, "rows": count, "at": 0}], "sources": old.get("sources", {}), "batches": old.get("batches", []),
        }
        if commits.commit(spark, f"{path}/manifest", version + 1, content):
            return


def _state(spark: SparkSession, path: str, version: int | None = None) -> tuple[dict, DataFrame]:
    _, manifest = commits.load(spark, f"{path}/manifest", version)
    if not manifest:
        raise FileNotFoundError(f"no event log below {path}")
    rows = _segments(spark, path, manifest, manifest["segments"])
    return manifest, _fold(rows, manifest["columns"], manifest["key"]).where("__has")


def read_state(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Current event table, or that of an earlier version of the log."""
    manifest, rows = _state(spark, path, version)
    return rows.select(*manifest["columns"])


def _append(spark: SparkSession, path: str, rows: DataFrame, mark: Callable[[dict], bool]) -> bool:
    """Add a segment; ``mark`` notes its batch in the manifest and says whether it is new."""
    if not mark(commits.load(spark, f"{path}/manifest")[1]):
        return False
    _, manifest = commits.load(spark, f"{path}/manifest")
    name, count = _write(rows, path, manifest["key"])
    while True:
        version, manifest = commits.load(spark, f"{path}/manifest")
        if not mark(manifest):
            discard(spark, f"{path}/data/{name}")
            return False
        manifest["last"] += 1
        manifest["segments"].append({"name": name, "rows": count, "at": manifest["last"]})
        if commits.commit(spark, f"{path}/manifest", version + 1, manifest):
            return True


def _content(batch: DataFrame) -> str:
    """Identity of a batch without a number: its rows, in whatever order."""
    digest = F.xxhash64(*[part for c in sorted(batch.columns) for part in (F.col(c), F.col(c).isNull())])
    rows, total = batch.agg(F.count(F.lit(1)), F.sum(digest.cast("decimal(38,0)"))).first()
    return f"{rows}:{total}"


def apply_batch(
    path: str, batch: DataFrame, order: str = "seq", source: str | None = None, batch_id: int | None = None, merge: bool = True
) -> bool:
    """Append a fetched batch to the log; False if it is in the log already.

    A batch is known by its number among those of its ``source``, which ascend, or without one by its content. Rows without a
    complete key are inserted, each as often as its batch holds it.
    """
    spark = batch.sparkSession
    _, manifest = commits.load(spark, f"{path}/manifest")
    key, columns = manifest["key"], manifest["columns"]
    identity = _content(batch) if batch_id is None else None

    def mark(found: dict) -> bool:
        if identity is not None:
            if identity in found["batches"]:
                return False
            found["batches"] = [*found["batches"], identity][-KNOWN_BATCHES:]
            return True
        if batch_id <= found["sources"].get(source, -1):
            return False
        found["sources"][source] = batch_id
        return True

    keyed = _whole(collapse_batch(batch.where(has_key(key)), key, order), key, scored=False)
    loose = batch.where(~has_key(key))
    loose = _whole(loose.select(*[c for c in columns if c in loose.columns]), key)
    schema = T.StructType.fromJson(manifest["schema"])
    empty = spark.createDataFrame([], schema)
    rows = empty.unionByName(keyed, allowMissingColumns=True).unionByName(loose, allowMissingColumns=True)
    done = _append(spark, path, rows, mark)
    if done and merge and len(commits.load(spark, f"{path}/manifest")[1]["segments"]) > MERGE_SEGMENTS:
        merge_segments(spark, path)
    return done


def merge_segments(spark: SparkSession, path: str) -> None:
    """Merge the newest segments into one, and with the base once the changes have grown to a part of it.

    Old files stay for readers of earlier versions until ``vacuum``. If another writer was faster, its version stays.
    """
    version, manifest = commits.load(spark, f"{path}/manifest")
    parts = manifest["segments"]
    first, total = len(parts) - 1, parts[-1]["rows"]
    while first > 1 and parts[first - 1]["rows"] <= MERGE_FACTOR * total:
        first -= 1
        total += parts[first]["rows"]
    whole = sum(x["rows"] for x in parts[1:]) >= BASE_PART * parts[0]["rows"]
    if whole:
        first = 0
    if first == len(parts) - 1:
        return
    rows = _fold(_segments(spark, path, manifest, parts[first:]), manifest["columns"], manifest["key"])
    if whole:
        manifest["buckets"] = max(manifest["buckets"], -(-sum(x["rows"] for x in parts) // BUCKET_ROWS))
    name, count = _write(rows, path, manifest["key"], manifest["buckets"] if whole else 0)
    manifest["segments"] = [*parts[:first], {"name": name, "rows": count, "at": parts[-1]["at"]}]
    if not commits.commit(spark, f"{path}/manifest", version + 1, manifest):
        discard(spark, f"{path}/data/{name}")


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the segments that the latest version no longer names; gives their number. Earlier versions end with it."""
    _, manifest = commits.load(spark, f"{path}/manifest")
    named = {x["name"] for x in manifest["segments"]}
    return sum(discard(spark, f"{path}/data/{name}") for name in commits.names(spark, f"{path}/data") if name not in named)


def sync_stream(stream: DataFrame, path: str, checkpoint: str, order: str = "seq", every: str | None = None) -> StreamingQuery:
    """Keep the event table up to date from a stream of fetched entries.

    The number of a micro-batch below its checkpoint is its identity, so one that is repeated after a failure changes
    nothing. Processes what is there and stops, or goes on in steps of ``every`` (such as "1 minute").
    """

    def step(batch: DataFrame, number: int) -> None:
        apply_batch(path, batch, order, checkpoint, number)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def rescore_state(
    spark: SparkSession, path: str, corpus: DataFrame, keys: Sequence[str], embed_fn: Callable[[DataFrame], DataFrame]
) -> int:
    """Re-score the stale events and append their scores (U2); gives their number. Nothing else is written.

    Events are known by ``id``; one without it, or without a vector, stays stale.
    """
    manifest, rows = _state(spark, path)
    waiting = materialize(stale(rows).drop("new_text"), "stale-events")
    if not waiting.count():
        return 0
    scored = rescore_stale(waiting, corpus, keys, embed_fn)
    done = materialize(with_event_text(scored).where(F.col("scored_text").eqNullSafe(F.col("new_text"))), "scored-events")
    given = [*manifest["key"], "__loose", *[c for c in SCORE if c in manifest["columns"]]]
    segment = done.select(*given, F.lit(False).alias("__has"), F.lit(True).alias("__scored"))
    empty = spark.createDataFrame([], T.StructType.fromJson(manifest["schema"]))
    _append(spark, path, empty.unionByName(segment, allowMissingColumns=True), lambda found: True)
    return done.count()
