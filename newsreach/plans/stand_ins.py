"""The roles of the announcement schema, played by the test tables.

Each role exists twice: as a DataFrame and, in ``SQL``, as a common table expression of the same rows for
the independent check. Nothing is cut down: every role covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsreach.operators.outcome import regional_reach
from newsreach.operators.rollup import clip_rollup, outlet_frequency, outlet_set, outlet_total
from newsreach.sources.files import read_table, rows_of
from newsreach.sources.workspace import materialize

KEY = ["release_id"]
OWN_OUTLET = 5
LIFT_MIN = 1.2


class Roles:
    """Lazily read roles of one data folder; the corpus with vectors is stored once for all its uses."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self._vectors: DataFrame | None = None

    def table(self, name: str, *columns: str) -> DataFrame:
        return read_table(self.spark, self.folder, name, columns or None)

    def release(self, orders: DataFrame | None = None) -> DataFrame:
        """Announcements: orders (all, or those given) with their customer's segment and nation."""
        customer = self.table("customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
        orders = self.table("orders") if orders is None else orders
        return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("release_id"),
            F.col("o_custkey").alias("company_id"),
            F.col("c_name").alias("company_name"),
            F.col("o_orderdate").alias("created_at"),
            F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("title"),
            F.col("c_mktsegment").alias("category"),
            F.col("o_orderpriority").alias("release_type"),
            F.when(F.col("o_orderstatus") != "P", F.col("c_nationkey")).alias("place"),
            F.col("o_totalprice").alias("page_view"),
        )

    def clip_log(self) -> DataFrame:
        """Republication log: order lines, the supplier as outlet."""
        return self.table("lineitem", "l_orderkey", "l_suppkey", "l_shipdate").select(
            F.col("l_orderkey").alias("release_id"),
            F.col("l_suppkey").alias("outlet"),
            F.col("l_shipdate").alias("insert_date"),
        )

    def rollup(self) -> DataFrame:
        return clip_rollup(self.clip_log(), KEY, "outlet", OWN_OUTLET, "insert_date")

    def media(self) -> DataFrame:
        return outlet_set(self.clip_log(), KEY, "outlet", OWN_OUTLET)

    def reached(self) -> DataFrame:
        """Announcements with their reach."""
        return self.release().join(self.rollup().select("release_id", "reach"), KEY)

    def corpus(self) -> DataFrame:
        """Announcements with reach and regional reach."""
        regional = regional_reach(self.release(), self.media(), KEY, "place", "outlet", LIFT_MIN)
        return self.reached().join(regional, KEY, "left").withColumn(
            "regional_reach", F.coalesce("regional_reach", F.lit(0))
        )

    def frequency(self) -> DataFrame:
        return outlet_frequency(self.media(), KEY, "outlet")

    def total(self) -> DataFrame:
        return outlet_total(self.media(), KEY)

    def vectors(self) -> DataFrame:
        """Corpus with vectors: an embedding belongs to the order of the same number."""
        if self._vectors is None:
            orders = rows_of(self.table("orders"), ["o_orderkey"], self.table("embeddings", "vec_id"))
            release = self.release(orders).select(
                "release_id", "company_id", "created_at", "title", F.col("place"), F.col("page_view")
            )
            embedding = self.table("embeddings").select(F.col("vec_id").alias("release_id"), "embedding", F.col("label").alias("category"))
            rows = embedding.join(release, KEY).withColumns(
                {
                    "reach_score": F.round(F.col("page_view") / 500000, 6),
                    "pv_score": F.round(F.log1p("page_view") / 14, 6),
                }
            )
            self._vectors = materialize(rows, "vectors")
        return self._vectors

    def queries(self) -> DataFrame:
        """Search requests: every vector with its own category and place."""
        return self.vectors().select(F.col("release_id").alias("query_id"), "embedding", "category", "place")

    def locations(self) -> DataFrame:
        """Several locations per announcement: the suppliers' nations, a city only for returned lines."""
        lines = self.table("lineitem", "l_orderkey", "l_suppkey", "l_returnflag")
        supplier = self.table("supplier", "s_suppkey", "s_nationkey")
        return lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(
            F.col("l_orderkey").alias("release_id"),
            F.when(F.col("l_returnflag") != "A", F.col("s_nationkey")).alias("prefecture_id"),
            F.when(F.col("l_returnflag") == "R", F.col("l_suppkey").cast("int")).alias("city_id"),
        )

    def categories(self) -> DataFrame:
        """Several categories per announcement: the sizes of its parts."""
        lines = self.table("lineitem", "l_orderkey", "l_partkey")
        part = self.table("part", "p_partkey", "p_size")
        return lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").select(
            F.col("l_orderkey").alias("release_id"), F.col("p_size").alias("business_category_id")
        )

    def events(self) -> DataFrame:
        """Calendar events; error events have no score yet."""
        return self.table("events").select(
            F.col("event_id").alias("id"),
            "user_id",
            F.get_json_object("props", "$.k").alias("external_id"),
            F.col("event_type").alias("title"),
            F.col("props").alias("description"),
            F.when(F.col("event_type") == "purchase", "").otherwise(F.concat(F.lit("Room "), F.col("user_id"))).alias("location"),
            F.col("ts").alias("starts_at"),
            (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ends_at"),
            F.lit(False).alias("all_day"),
            F.when(F.col("event_type") != "error", F.col("value")).alias("score"),
        )

    def predictions(self) -> DataFrame:
        """Orders with an outcome and two predictions of it."""
        lines = self.table("lineitem", "l_orderkey", "l_extendedprice").groupBy("l_orderkey").agg(
            F.round(F.sum("l_extendedprice"), 2).alias("pred_sum"), F.count(F.lit(1)).cast("double").alias("pred_lines")
        )
        orders = self.table("orders", "o_orderkey", "o_custkey", "o_totalprice")
        return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
            "o_orderkey", "o_custkey", F.col("o_totalprice").alias("actual"), "pred_sum", "pred_lines"
        )

    def judged(self) -> DataFrame:
        """Labelled documents: quality as the outcome, length and word count as predictions."""
        labels = self.table("labels", "doc_id", "quality")
        docs = self.table("documents", "doc_id", "source", "text", "n_chars")
        return labels.join(docs, "doc_id").select(
            "doc_id",
            "source",
            F.col("quality").cast("double").alias("actual"),
            F.col("n_chars").cast("double").alias("pred_chars"),
            F.length(F.regexp_replace("text", "[^a-z]", "")).cast("double").alias("pred_letters"),
        )

    def drafts(self) -> DataFrame:
        """Drafts, partly filled from the order they belong to, with newly read answers beside them."""
        status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
        none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
        rows = self.table("orders").join(
            self.table("customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
            F.col("o_custkey") == F.col("c_custkey"),
        ).join(self.table("nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
        segment = F.col("c_mktsegment")
        return rows.select(
            F.col("o_orderkey").alias("draft_id"),
            F.col("c_name").alias("title"),
            F.when(status == "F", F.col("n_name")).alias("place"),
            F.when(segment == "BUILDING", F.array("c_name")).otherwise(empty).alias("partner"),
            F.when(priority == "1-URGENT", F.lit("staff")).alias("people"),
            none.alias("novelty"),
            F.when(F.col("o_totalprice") > 200000, F.lit("large")).alias("observation"),
            none.alias("video"),
            F.when(status == "P", F.array(F.lit("video"))).otherwise(empty).alias("skipped"),
            F.when(segment == "MACHINERY", F.array(F.lit("place"))).otherwise(empty).alias("retried"),
            F.when(priority == "2-HIGH", F.lit("hall")).when(priority == "3-MEDIUM", F.lit("")).alias("fill_place"),
            F.when(status == "O", F.array(F.lit("school"))).otherwise(empty).alias("fill_partner"),
            none.alias("fill_people"),
            F.when(segment == "FURNITURE", F.lit("first")).alias("fill_novelty"),
            none.alias("fill_observation"),
            none.alias("fill_video"),
            F.when(priority == "5-LOW", F.array(F.lit("place"), F.lit("novelty"))).otherwise(empty).alias("fill_unavailable"),
            F.when(status != "P", F.array(F.lit("place"), F.lit("people"))).otherwise(empty).alias("fill_written"),
            F.when(status == "O", F.lit("place")).when(status == "F", F.lit("people")).otherwise(F.lit("novelty")).alias("asked"),
        )


# The same roles for the check in SQL.
SQL = {
    "release": """release AS (
        SELECT o_orderkey AS release_id, o_custkey AS company_id, c_name AS company_name, o_orderdate AS created_at,
               o_orderstatus || ' ' || o_orderpriority AS title, c_mktsegment AS category,
               o_orderpriority AS release_type, CASE WHEN o_orderstatus <> 'P' THEN c_nationkey END AS place,
               o_totalprice AS page_view
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "clip_log": """clip_log AS (
        SELECT l_orderkey AS release_id, l_suppkey AS outlet, l_shipdate AS insert_date FROM lineitem)""",
    "rollup": """rollup AS (
        SELECT release_id, count(*) AS clip_rows, count(DISTINCT outlet) AS outlets,
               count(DISTINCT outlet) FILTER (WHERE outlet <> 5) AS reach,
               min(insert_date) AS first_clip, max(insert_date) AS last_clip
        FROM clip_log GROUP BY release_id)""",
    "media": "media AS (SELECT DISTINCT release_id, outlet FROM clip_log WHERE outlet <> 5)",
    "reached": "reached AS (SELECT r.*, u.reach FROM release r JOIN rollup u USING (release_id))",
    "placed": """placed AS (
        SELECT m.release_id, m.outlet, r.place FROM media m JOIN release r USING (release_id) WHERE r.place IS NOT NULL)""",
    # Rate of an outlet among the cases of a place over its rate among all placed cases.
    "lift": """rates AS (
        SELECT place, count(*) AS in_place, sum(count(*)) OVER () AS everywhere FROM release WHERE place IS NOT NULL GROUP BY place),
    seen AS (SELECT place, outlet, count(*) AS hits FROM placed GROUP BY place, outlet),
    lift AS (
        SELECT seen.place, outlet, hits,
               (hits::DOUBLE / in_place) / (sum(hits) OVER (PARTITION BY outlet)::DOUBLE / everywhere) AS lift
        FROM seen JOIN rates ON seen.place = rates.place)""",
    "regional": """regional AS (
        SELECT release_id, count(*) AS regional_reach
        FROM placed SEMI JOIN (SELECT place, outlet FROM lift WHERE lift >= 1.2) AS pairs USING (place, outlet) GROUP BY release_id)""",
    "corpus": """corpus AS (
        SELECT r.*, coalesce(g.regional_reach, 0) AS regional_reach
        FROM reached r LEFT JOIN regional g USING (release_id))""",
    "frequency": "frequency AS (SELECT outlet, count(DISTINCT release_id) AS case_count FROM media GROUP BY 1)",
    "vectors": """vectors AS (
        SELECT vec_id AS release_id, embedding::DOUBLE[] AS embedding, label AS category, company_id, created_at, title,
               place, page_view, round(page_view / 500000, 6) AS reach_score,
               round(ln(1 + page_view) / 14, 6) AS pv_score
        FROM embeddings JOIN release ON vec_id = release_id)""",
    "locations": """locations AS (
        SELECT l_orderkey AS release_id, CASE WHEN l_returnflag <> 'A' THEN s_nationkey END AS prefecture_id,
               CASE WHEN l_returnflag = 'R' THEN l_suppkey::INTEGER END AS city_id
        FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey)""",
    "categories": """categories AS (
        SELECT l_orderkey AS release_id, p_size AS business_category_id
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)""",
    "calendar": """calendar AS (
        SELECT event_id AS id, user_id, json_extract_string(props, '$.k') AS external_id, event_type AS title,
               props AS description, CASE WHEN event_type = 'purchase' THEN '' ELSE 'Room ' || user_id END AS location,
               ts AS starts_at, ts + INTERVAL 1 HOUR AS ends_at, false AS all_day,
               CASE WHEN event_type <> 'error' THEN value END AS score
        FROM events)""",
    "predictions": """predictions AS (
        SELECT o_orderkey, o_custkey, o_totalprice AS actual, pred_sum, pred_lines
        FROM orders JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS pred_sum, count(*)::DOUBLE AS pred_lines
                          FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)""",
    "judged": """judged AS (
        SELECT doc_id, source, quality::DOUBLE AS actual, n_chars::DOUBLE AS pred_chars,
               length(regexp_replace(text, '[^a-z]', '', 'g'))::DOUBLE AS pred_letters
        FROM labels JOIN documents USING (doc_id))""",
    "drafts": """drafts AS (
        SELECT o_orderkey AS draft_id, c_name AS title,
               CASE WHEN o_orderstatus = 'F' THEN n_name END AS place,
               CASE WHEN c_mktsegment = 'BUILDING' THEN [c_name] ELSE []::VARCHAR[] END AS partner,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'staff' END AS people,
               NULL::VARCHAR AS novelty,
               CASE WHEN o_totalprice > 200000 THEN 'large' END AS observation,
               NULL::VARCHAR AS video,
               CASE WHEN o_orderstatus = 'P' THEN ['video'] ELSE []::VARCHAR[] END AS skipped,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN ['place'] ELSE []::VARCHAR[] END AS retried,
               CASE WHEN o_orderpriority = '2-HIGH' THEN 'hall' WHEN o_orderpriority = '3-MEDIUM' THEN '' END AS fill_place,
               CASE WHEN o_orderstatus = 'O' THEN ['school'] ELSE []::VARCHAR[] END AS fill_partner,
               CASE WHEN c_mktsegment = 'FURNITURE' THEN 'first' END AS fill_novelty,
               CASE WHEN o_orderpriority = '5-LOW' THEN ['place', 'novelty'] ELSE []::VARCHAR[] END AS fill_unavailable,
               CASE WHEN o_orderstatus <> 'P' THEN ['place', 'people'] ELSE []::VARCHAR[] END AS fill_written,
               CASE o_orderstatus WHEN 'O' THEN 'place' WHEN 'F' THEN 'people' ELSE 'novelty' END AS asked
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
}

# What each role is built from, so that a check names only what it uses.
NEEDS = {
    "rollup": ["clip_log"],
    "media": ["clip_log"],
    "reached": ["release", "rollup"],
    "placed": ["media", "release"],
    "lift": ["placed", "release"],
    "regional": ["placed", "lift"],
    "corpus": ["reached", "regional"],
    "frequency": ["media"],
    "vectors": ["release"],
}


def with_roles(names: str, body: str) -> str:
    """``WITH`` the named roles and everything they need, followed by ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    body = body.strip()
    parts = ",\n".join(SQL[name] for name in order)
    if body.upper().startswith("WITH "):
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"


