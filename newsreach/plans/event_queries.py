"""Calendar events and incremental maintenance."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsreach.operators import events as E
from newsreach.plans.registry import query, rounded
from newsreach.plans.search_queries import top_sql
from newsreach.plans.stand_ins import KEY, Roles
from newsreach.sources.workspace import fresh_path
from newsreach.streaming.calendar_sync import create_state, read_state, sync_stream


@query("F3_events_between", """
    SELECT id, user_id, starts_at, ends_at FROM calendar
    WHERE ends_at >= TIMESTAMP '2024-01-05' AND starts_at <= TIMESTAMP '2024-01-20'""", "calendar")
def f3(r: Roles) -> DataFrame:
    found = E.events_between(r.events(), datetime(2024, 1, 5), datetime(2024, 1, 20))
    return found.select("id", "user_id", "starts_at", "ends_at")


@query("F3_listing_order", """
    WITH shown AS (SELECT id, user_id, CASE WHEN title = 'view' THEN strftime(starts_at + INTERVAL 9 HOUR, '%Y-%m-%d')
                          ELSE strftime(starts_at, '%Y-%m-%dT%H:%M:%S')
                               || CASE WHEN microsecond(starts_at) % 1000000 = 0 THEN '' ELSE strftime(starts_at, '.%f') END || '+00:00' END AS start_text FROM calendar)
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_text, id)::INTEGER AS position FROM shown""", "calendar")
def f3_listing(r: Roles) -> DataFrame:
    """Every user's events in the order of the shown start; views last all day."""
    instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("starts_at")).cast("timestamp")
    events = r.events().withColumns({"starts_at": instant, "all_day": F.col("title") == "view"})
    return E.listing_order(events, ["user_id"]).select("id", "user_id", "start_text", "position")


@query("F4_in_month", "SELECT o_orderkey, o_orderdate FROM orders WHERE date_trunc('month', o_orderdate) = DATE '1998-12-01'")
def f4(r: Roles) -> DataFrame:
    return E.in_month(r.table("orders", "o_orderkey", "o_orderdate"), "1998-12", "o_orderdate")


@query("F5_calendar_grid", """
    SELECT month, day::DATE AS day, date_trunc('month', day)::DATE = month AS in_month
    FROM (SELECT month, unnest(generate_series(month - INTERVAL (dayofweek(month)) DAY,
                                               month - INTERVAL (dayofweek(month)) DAY + INTERVAL 41 DAY, INTERVAL 1 DAY)) AS day
          FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month FROM orders))""")
def f5(r: Roles) -> DataFrame:
    months = r.table("orders", "o_orderdate").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).distinct()
    return E.calendar_grid(months, "month")


@query("F5_events_on_day", "SELECT id, starts_at FROM calendar WHERE starts_at::DATE = DATE '2024-01-10'", "calendar")
def f5_day(r: Roles) -> DataFrame:
    return E.events_on(r.events(), datetime(2024, 1, 10)).select("id", "starts_at")


@query("F6_clean_events", """
    SELECT event_id::VARCHAR AS external_id, CASE WHEN event_type = 'view' THEN '(タイトルなし)' ELSE event_type END AS title,
           '' AS description, CASE WHEN event_type = 'error' THEN '' ELSE 'room' END AS location,
           CASE WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS start,
           strftime(ts, '%Y-%m-%d') AS "end"
    FROM events WHERE event_type <> 'signup'""")
def f6(r: Roles) -> DataFrame:
    kind, day = F.col("event_type"), F.date_format("ts", "yyyy-MM-dd")
    raw = r.table("events", "event_id", "event_type", "ts").select(
        F.col("event_id").cast("string").alias("id"),
        F.when(kind != "view", kind).alias("summary"),
        F.lit(None).cast("string").alias("description"),
        F.when(kind != "error", "room").alias("location"),
        F.when(kind != "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("start_datetime"),
        day.alias("start_date"),
        F.lit(None).cast("string").alias("end_datetime"),
        F.when(kind != "signup", day).alias("end_date"),
    )
    return E.clean_events(raw)


@query("O4_ranked_month", """
    SELECT id, starts_at::DATE AS day, score FROM calendar WHERE date_trunc('month', starts_at) = DATE '2024-01-01'
    ORDER BY score DESC NULLS LAST, day, id""", "calendar")
def o4(r: Roles) -> DataFrame:
    ranked = E.ranked_month(r.events().select("id", "starts_at", "score"), "2024-01")
    return ranked.select("id", F.col("starts_at").cast("date").alias("day"), "score")


@query("O5_events_by_day", """
    SELECT starts_at::DATE AS day, id, row_number() OVER (PARTITION BY starts_at::DATE ORDER BY starts_at, id)::INTEGER AS position,
           greatest(count(*) OVER (PARTITION BY starts_at::DATE) - 3, 0)::BIGINT AS overflow
    FROM calendar QUALIFY position <= 3""", "calendar")
def o5(r: Roles) -> DataFrame:
    return E.events_by_day(r.events(), 3).select("day", "id", "position", "overflow")


def upsert_inputs(r: Roles) -> tuple[DataFrame, DataFrame]:
    """Table: the first purchase of every (user, external id). Batch: all events in order of arrival."""
    events = r.events().withColumn("created_at", F.col("starts_at"))
    first = events.where("title = 'purchase'").groupBy("user_id", "external_id").agg(
        F.min_by(F.struct("id", "title", "description", "location", "starts_at", "ends_at", "all_day", "created_at", "score"), "id").alias("e")
    )
    return first.select("user_id", "external_id", "e.*"), events.drop("score").withColumn("seq", F.col("id"))


UPSERT_SQL = """
    WITH target AS (SELECT * FROM calendar WHERE title = 'purchase'
                    QUALIFY row_number() OVER (PARTITION BY user_id, external_id ORDER BY id) = 1),
    change AS (SELECT user_id, external_id, arg_max(title, id) AS title, arg_max(starts_at, id) AS starts_at,
                      coalesce(arg_max(location, id) FILTER (WHERE location <> ''), '') AS location, min(id) AS id
               FROM calendar GROUP BY 1, 2)
    SELECT c.user_id, c.external_id, coalesce(t.id, c.id) AS id, c.title, c.starts_at,
           CASE WHEN t.id IS NULL OR c.location <> '' THEN c.location ELSE t.location END AS location, t.score
    FROM change c LEFT JOIN target t USING (user_id, external_id)"""


@query("U1_upsert_events", UPSERT_SQL, "calendar")
def u1(r: Roles) -> DataFrame:
    merged = E.upsert_events(*upsert_inputs(r))
    return merged.select("user_id", "external_id", "id", "title", "starts_at", "location", "score")


@query("U1_stream_sync", UPSERT_SQL, "calendar")
def u1_stream(r: Roles) -> DataFrame:
    """The same upsert fed by a file stream into the bucketed event table."""
    target, batch = upsert_inputs(r)
    state, inbox = fresh_path(r.spark, "event-state"), fresh_path(r.spark, "event-inbox")
    create_state(target, state)
    batch.write.parquet(inbox)
    stream = r.spark.readStream.schema(batch.schema).parquet(inbox)
    query_handle = sync_stream(stream, state, fresh_path(r.spark, "event-stream"))
    query_handle.awaitTermination()
    return read_state(r.spark, state).select("user_id", "external_id", "id", "title", "starts_at", "location", "score")


@query("U2_rescore_stale", f"""
    WITH stored AS (SELECT *, CASE WHEN title = 'view' THEN concat_ws(chr(10), title, nullif(location, ''), description) END AS scored_text
                    FROM calendar),
    scored AS (SELECT s.id AS query_id, c.release_id, c.pv_score, round(list_dot_product(q.embedding::DOUBLE[], c.embedding), 9) AS score
               FROM stored s JOIN embeddings q ON q.vec_id = s.external_id::BIGINT, vectors c WHERE s.scored_text IS NULL),
    {top_sql(20)}
    SELECT s.id, round(coalesce(n.plan_score, s.score), 9) AS score,
           concat_ws(chr(10), title, nullif(location, ''), description) AS scored_text
    FROM stored s LEFT JOIN (SELECT query_id, median(pv_score) AS plan_score FROM top GROUP BY 1) n ON n.query_id = s.id""",
    "calendar vectors")
def u2(r: Roles) -> DataFrame:
    """Views were scored by their present text; all other events are stale."""
    events = E.with_event_text(r.events(), "current").withColumn(
        "scored_text", F.when(F.col("title") == "view", F.col("current"))
    )
    vectors = r.table("embeddings", "vec_id", "embedding")
    sources = events.select("id", F.col("external_id").cast("bigint").alias("vec_id"))

    def embed(changed: DataFrame) -> DataFrame:
        return changed.join(sources, "id").join(vectors, "vec_id").drop("vec_id")

    scored = E.rescore_stale(events.drop("current"), r.vectors(), KEY, embed)
    return rounded(scored.select("id", "score", "scored_text"), "score", digits=9)


@query("U3_attach_draft", """
    SELECT id, CASE WHEN location = '' AND event_id IS NOT NULL THEN 'Hall ' || user_id ELSE location END AS location,
           CASE WHEN event_id IS NOT NULL THEN '{"title":"' || title || '"}' END AS draft
    FROM calendar LEFT JOIN (SELECT event_id FROM events WHERE event_type IN ('purchase', 'click')) ON event_id = id""", "calendar")
def u3(r: Roles) -> DataFrame:
    events = r.events().withColumn("draft", F.lit(None).cast("string"))
    drafts = r.events().where("title IN ('purchase', 'click')").select(
        "id", F.concat(F.lit('{"title":"'), "title", F.lit('"}')).alias("draft"),
        F.concat(F.lit("Hall "), "user_id").alias("draft_place"),
    )
    return E.attach_draft(events, drafts).select("id", "location", "draft")


@query("U4_diff_versions", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'new' WHEN o_orderstatus = 'F' THEN 'gone' ELSE 'changed' END AS change
    FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice > 100000""")
def u4(r: Roles) -> DataFrame:
    """Old version: all but open orders. New version: all but finished ones, large amounts raised."""
    orders = r.table("orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    old = orders.where("o_orderstatus <> 'O'")
    new = orders.where("o_orderstatus <> 'F'").withColumn(
        "o_totalprice", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    return E.diff_versions(old, new, ["o_orderkey"])


@query("U4_diff_few_rows", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 1 THEN 'gone' ELSE 'changed' END AS change
    FROM orders WHERE o_orderkey % 1000 = 1 OR (o_orderkey % 1000 = 2 AND o_orderpriority IS NOT NULL)""")
def u4_few(r: Roles) -> DataFrame:
    """Versions that differ in few rows, so that few of the ranges are compared row by row."""
    orders = r.table("orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    new = orders.where("o_orderkey % 1000 <> 1").withColumn(
        "o_orderpriority", F.when(F.col("o_orderkey") % 1000 != 2, F.col("o_orderpriority"))
    )
    return E.diff_versions(orders, new, ["o_orderkey"])
