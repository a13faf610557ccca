"""Calendar events: filters, views, upsert, re-scoring, change capture."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsreach import constants as K
from newsreach.functions.moments import is_all_day, parse_moment, render_moment, wall_literal
from newsreach.functions.text import event_text, fit_columns
from newsreach.operators.place import resolve_place
from newsreach.operators.vectors import SCORE_BONUS, plan_score
from newsreach.sources.workspace import materialize

EVENT_KEY = ("user_id", "external_id")


def events_between(
    df: DataFrame, start: datetime | None = None, end: datetime | None = None, user: object | None = None
) -> DataFrame:
    """Events that touch the closed interval, earliest first."""
    if user is not None:
        df = df.where(F.col("user_id") == F.lit(user))
    if start is not None:
        df = df.where(F.col("ends_at") >= wall_literal(start, df.schema["ends_at"].dataType))
    if end is not None:
        df = df.where(F.col("starts_at") <= wall_literal(end, df.schema["starts_at"].dataType))
    return df.orderBy("starts_at", "id")


def _month_start(year_month: str) -> datetime:
    return datetime.strptime(year_month, "%Y-%m")  # noqa: DTZ007 - wall-clock month


def _between(df: DataFrame, at: str, start: datetime, end: datetime) -> DataFrame:
    dtype = df.schema[at].dataType
    return df.where((F.col(at) >= wall_literal(start, dtype)) & (F.col(at) < wall_literal(end, dtype)))


def listing_order(df: DataFrame, by: Sequence[str] = (), at: str = "starts_at", zone: str = K.LOCAL_ZONE) -> DataFrame:
    """Add ``start_text``, the start as it is shown, and ``position`` (from 1) in the order of these texts.

    A list of events is finally ordered by the shown text, in which a whole-day event is a plain date; so it comes before
    all timed events whose text begins with that date, whatever the instants are. Equal texts go by id.
    """
    shown = df.withColumn("start_text", render_moment(at, "all_day", zone))
    return shown.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("start_text", "id")))


def in_month(df: DataFrame, year_month: str, at: str = "starts_at") -> DataFrame:
    """Rows of one month, written as a range so that it reaches the file scan."""
    first = _month_start(year_month)
    following = datetime(first.year + first.month // 12, first.month % 12 + 1, 1)  # noqa: DTZ001
    return _between(df, at, first, following)


def ranked_month(df: DataFrame, year_month: str, at: str = "starts_at", score: str = "score") -> DataFrame:
    """Events of a month, best score first, unscored last, then by date."""
    return in_month(df, year_month, at).orderBy(F.col(score).desc_nulls_last(), F.col(at).cast("date"), "id")


def grid_start(month: Column) -> Column:
    """Sunday on or before the first of the month."""
    first = F.trunc(month, "month")
    return F.date_sub(first, F.dayofweek(first) - 1)


def calendar_grid(months: DataFrame, month: str) -> DataFrame:
    """The 42 days shown for each month, from the Sunday on or before its first day."""
    start = grid_start(F.col(month))
    days = F.sequence(start, F.date_add(start, K.GRID_DAYS - 1))
    return months.select(month, F.explode(days).alias("day")).withColumn(
        "in_month", F.trunc("day", "month") == F.trunc(month, "month")
    )


def events_on(df: DataFrame, day: datetime, at: str = "starts_at") -> DataFrame:
    """Events of a single day."""
    start = datetime(day.year, day.month, day.day)  # noqa: DTZ001
    return _between(df, at, start, start + timedelta(days=1))


def clean_events(df: DataFrame) -> DataFrame:
    """Fetched calendar entries in event form; those without id, start or end are dropped.

    Input: ``id, summary, description, location, start_datetime, start_date, end_datetime, end_date``.
    """
    return df.select(
        F.col("id").alias("external_id"),
        F.coalesce("summary", F.lit(K.NO_TITLE)).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce("start_datetime", "start_date").alias("start"),
        F.coalesce("end_datetime", "end_date").alias("end"),
        *[c for c in df.columns if c in ("user_id", "seq")],
    ).where((F.col("external_id") != "") & (F.col("start") != "") & (F.col("end") != ""))


def event_rows(cleaned: DataFrame) -> DataFrame:
    """Cleaned entries in the types and widths of the event table."""
    typed = cleaned.withColumns(
        {"starts_at": parse_moment("start"), "ends_at": parse_moment("end"), "all_day": is_all_day("start")}
    ).drop("start", "end")
    return fit_columns(typed, {"title": K.TITLE_CHARS, "location": K.LOCATION_CHARS})


def events_by_day(df: DataFrame, n: int, at: str = "starts_at", keys: Sequence[str] = ("id",)) -> DataFrame:
    """At most ``n`` events per day, with the number of further ones.

    The limit is pushed below the shuffle; the day totals are counted map-side.
    """
    dated = df.withColumn("day", F.col(at).cast("date"))
    window = Window.partitionBy("day").orderBy(at, *keys)
    shown = dated.withColumn("position", F.row_number().over(window)).where(F.col("position") <= n)
    totals = dated.groupBy("day").agg(F.count(F.lit(1)).alias("__total"))
    return (
        shown.join(totals, "day")
        .withColumn("overflow", F.greatest(F.col("__total") - F.lit(n), F.lit(0)))
        .drop("__total")
    )


UPDATED = ("title", "description", "starts_at", "ends_at", "all_day")


def collapse_batch(batch: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key of an incoming batch, as if its rows had been applied one by one.

    The last row wins, except that the last *non-empty* location does; ``created_at`` and the id come
    from the first. Plain aggregates, so repeated keys are combined before the shuffle.
    """
    located = F.when(F.col("location") != "", F.col("location"))
    last = F.max_by(F.struct(*UPDATED), F.col(order))
    return (
        batch.groupBy(*key)
        .agg(
            last.alias("__last"),
            F.coalesce(F.max_by(located, F.when(located.isNotNull(), F.col(order))), F.lit("")).alias("location"),
            F.min_by("id", order).alias("id"),
            F.min_by("created_at", order).alias("created_at"),
        )
        .select(*key, "__last.*", "location", "id", "created_at")
    )


def has_key(key: Sequence[str]) -> Column:
    """Whether a row has all parts of its key; one that lacks a part conflicts with nothing."""
    found = F.col(key[0]).isNotNull()
    for part in key[1:]:
        found = found & F.col(part).isNotNull()
    return found


def upsert_events(
    target: DataFrame, batch: DataFrame, key: Sequence[str] = EVENT_KEY, order: str = "seq"
) -> DataFrame:
    """Apply a batch to the event table.

    A known key gets the new title, description, times and, if it is not empty, location; id,
    ``created_at`` and every other column stay. An unknown key is inserted. Rows that lack a part of the key
    conflict with nothing. Events that vanished at the source are kept. Applying a batch twice equals
    applying it once.
    """
    keyed = batch.where(has_key(key))
    loose = batch.where(~has_key(key))
    change = collapse_batch(keyed, key, order)
    new = change.select(*key, *[F.col(c).alias(f"__n_{c}") for c in change.columns if c not in key], F.lit(True).alias("__hit"))
    merged = target.where(has_key(key)).withColumn("__old", F.lit(True)).join(new, list(key), "full_outer")
    hit, old = F.col("__hit").isNotNull(), F.col("__old").isNotNull()
    columns = []
    for name in target.columns:
        if name in UPDATED:
            value = F.when(hit, F.col(f"__n_{name}")).otherwise(F.col(name))
        elif name == "location":
            given = hit & (~old | (F.col("__n_location") != ""))
            value = F.when(given, F.col("__n_location")).otherwise(F.col(name))
        elif name in ("id", "created_at"):
            value = F.when(old, F.col(name)).otherwise(F.col(f"__n_{name}"))
        else:
            value = F.col(name)
        columns.append(value.alias(name))
    return (
        merged.select(*columns)
        .unionByName(target.where(~has_key(key)))
        .unionByName(loose.select(*[c for c in target.columns if c in loose.columns]), allowMissingColumns=True)
    )


def with_event_text(events: DataFrame, out: str = "new_text") -> DataFrame:
    """Append the text an event would be scored by now."""
    return events.withColumn(out, event_text("title", "location", "description"))


def stale(events: DataFrame) -> DataFrame:
    """Events whose text differs from the one they were scored by."""
    return with_event_text(events).where(~F.col("scored_text").eqNullSafe(F.col("new_text")))


def rescore_stale(
    events: DataFrame,
    corpus: DataFrame,
    keys: Sequence[str],
    embed_fn: Callable[[DataFrame], DataFrame],
    places: DataFrame | None = None,
    k: int = K.NEIGHBORS,
) -> DataFrame:
    """Score the events whose text changed, all in one search, and leave the others alone.

    ``embed_fn`` adds ``embedding`` to a table that has ``new_text``. Events it leaves without a vector
    keep their old score and text, so the next run picks them up again. The place comes from the location
    when ``places`` is given.
    """
    changed = embed_fn(stale(events).select("id", "location", "new_text"))
    if places is not None:
        changed = resolve_place(changed, "location", places, "place")
    else:
        changed = changed.withColumn("place", F.lit(None).cast("int"))
    found = changed.where(F.col("embedding").isNotNull()).withColumn("category", F.lit(None).cast("int"))
    queries = materialize(found.select("id", "new_text", "embedding", "category", "place"), "stale-events")
    # Events with the same vector and classes ask one question: two hashes of these name it.
    asked = ["embedding", "category", "place"]
    named = queries.where(F.col("id").isNotNull()).withColumn("__asked", F.struct(F.xxhash64(*asked), F.xxhash64(F.lit("again"), *asked)).cast("string"))
    answers = materialize(plan_score(named.select("__asked", *asked).distinct(), corpus, "__asked", keys, k=k, bonus=SCORE_BONUS), "stale-scores")
    fresh = named.select("id", "__asked", F.col("new_text").alias("__text")).join(answers, "__asked").select("id", "plan_score", "__text")
    repeated = materialize(named.groupBy("id").count().where("count > 1").select("id"), "repeated-events")
    if not repeated.isEmpty():
        # several rows of one id are one question about all of their neighbours
        again = materialize(queries.join(repeated, "id", "left_semi"), "repeated-rows")
        joint = plan_score(again, corpus, "id", keys, k=k, bonus=SCORE_BONUS).join(again.select("id", F.col("new_text").alias("__text")), "id")
        fresh = fresh.join(repeated, "id", "left_anti").unionByName(joint)
    done = F.col("__text").isNotNull()
    return (
        events.join(fresh, "id", "left")
        .withColumn("score", F.when(done, F.col("plan_score")).otherwise(F.col("score")))
        .withColumn("scored_text", F.when(done, F.col("__text")).otherwise(F.col("scored_text")))
        .select(*events.columns)
    )


def attach_draft(events: DataFrame, drafts: DataFrame, on: str = "id") -> DataFrame:
    """Store drafts on events; a drafted place fills an empty location.

    ``drafts`` has the event id, ``draft`` (JSON) and ``draft_place``, one row per event.
    """
    given = drafts.select(on, F.col("draft").alias("__draft"), F.col("draft_place").alias("__place"))
    fills = (F.coalesce("location", F.lit("")) == "") & (F.col("__place") != "")
    return (
        events.join(given, on, "left")
        .withColumn("location", F.when(fills, F.left("__place", F.lit(K.LOCATION_CHARS))).otherwise(F.col("location")))
        .withColumn("draft", F.coalesce("__draft", "draft"))
        .select(*events.columns)
    )


# Ranges that the keys of two versions are dealt to before they are compared
DIGEST_RANGES = 4096


def differing_ranges(before: DataFrame, after: DataFrame, ranges: int) -> DataFrame:
    """Ranges (``__range``) whose rows (``__key``, ``__digest``) are not the same in both; ``ranges`` rows at most."""

    def digests(version: DataFrame, name: str) -> DataFrame:
        rows = F.struct(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("__key", "__digest").cast("decimal(38,0)")).alias("sum"))
        return version.groupBy(F.pmod("__key", F.lit(ranges)).alias("__range")).agg(rows.alias(name))

    both = digests(before, "__before").join(digests(after, "__after"), "__range", "full_outer")
    return both.where(~F.col("__before").eqNullSafe(F.col("__after"))).select("__range")


def diff_versions(old: DataFrame, new: DataFrame, keys: Sequence[str], ranges: int = DIGEST_RANGES) -> DataFrame:
    """Keys that are new, changed or gone between two versions of a table (U4).

    Columns of either version count; one that a version lacks is NULL there. NULL is a value and a key like any other.
    Keys are dealt to ``ranges`` by their hash; one digest of each range is compared first, counted before the shuffle, and
    only rows of ranges that differ meet in a join. Versions that differ in few rows shuffle few rows.
    """
    rest = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]

    def hashed(version: DataFrame, columns: Sequence[str]) -> Column:
        # The hash passes over NULL, so where the NULLs are is hashed too.
        cells = [F.col(c) if c in version.columns else F.lit(None).cast("string") for c in columns]
        return F.xxhash64(F.lit(0), *[part for cell in cells for part in (cell, cell.isNull())])

    before = old.select(*keys, hashed(old, rest).alias("__digest"), hashed(old, keys).alias("__key"))
    after = new.select(*keys, hashed(new, rest).alias("__digest"), hashed(new, keys).alias("__key"))
    differ = materialize(differing_ranges(before, after, ranges), "differing-ranges")

    def kept(version: DataFrame) -> DataFrame:
        marked = version.withColumn("__range", F.pmod("__key", F.lit(ranges)))
        return marked.join(F.broadcast(differ), "__range", "left_semi")  # as many rows as there are ranges, at most

    left = kept(before).select(*keys, F.col("__digest").alias("__old"))
    right = kept(after).select(*[F.col(key).alias(f"__n_{key}") for key in keys], F.col("__digest").alias("__new"))
    same = F.lit(True)
    for position, key in enumerate(keys):
        pair = F.col(key).eqNullSafe(F.col(f"__n_{key}"))
        same = pair if position == 0 else same & pair
    change = (
        F.when(F.col("__old").isNull(), "new")
        .when(F.col("__new").isNull(), "gone")
        .when(F.col("__old") != F.col("__new"), "changed")
    )
    named = [F.when(F.col("__old").isNull(), F.col(f"__n_{key}")).otherwise(F.col(key)).alias(key) for key in keys]
    return left.join(right, same, "full_outer").select(*named, change.alias("change")).where("change IS NOT NULL")
