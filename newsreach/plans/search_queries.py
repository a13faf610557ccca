"""Similarity search, neighbour scores, distinctive outlets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsreach import constants as K
from newsreach.functions.arrays import dot
from newsreach.operators import vectors as V
from newsreach.operators.rollup import outlet_frequency, outlet_total
from newsreach.plans.case_retrieval import case_bundle
from newsreach.plans.registry import query, rounded
from newsreach.plans.stand_ins import KEY, Roles
from newsreach.sources.workspace import materialize

SCORED = """scored AS (
    SELECT q.release_id AS query_id, c.release_id, c.pv_score, q.category AS q_category, q.place AS q_place,
           c.category, c.place, round(list_dot_product(q.embedding, c.embedding)
           + {reach} * c.reach_score + 0.04 * coalesce((q.category = c.category)::INT, 0)
           + 0.04 * coalesce((q.place = c.place)::INT, 0), 9) AS score
    FROM vectors q, vectors c)"""
SEARCH = SCORED.format(reach=0.05)
NEAR = SCORED.format(reach=0.0)


def top_sql(k: int, source: str = "scored") -> str:
    return f"""top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, release_id)::INTEGER AS rank
        FROM {source} QUALIFY rank <= {k})"""


@query("V1_hashed_embedding", """
    SELECT doc_id, 64::INTEGER AS dimensions, CASE WHEN regexp_matches(text, '\\S') THEN 1.0 ELSE 0.0 END::DOUBLE AS length
    FROM documents""")
def v1(r: Roles) -> DataFrame:
    """Default vectors of all documents; 1 where the vector has unit length."""
    docs = V.hashed_embedding(r.table("documents", "doc_id", "text"), "text", 64)
    return docs.select("doc_id", F.size("embedding").alias("dimensions"), F.round(dot("embedding", "embedding"), 4).alias("length"))


def letter_counts(texts: list[str]):
    """Example of a user's embedding function: letter counts."""
    return np.array([[text.count(chr(97 + i)) for i in range(26)] for text in texts], dtype=float)


@query("V1_embed_function", """
    SELECT doc_id, 26::INTEGER AS dimensions,
           round(coalesce((length(text) - length(replace(text, 'e', ''))) / nullif(sqrt(list_sum(list_transform(range(26),
               lambda i: (length(text) - length(replace(text, chr((97 + i)::INTEGER), ''))) ** 2))), 0), 0), 4) AS e_share
    FROM documents""")
def v1_function(r: Roles) -> DataFrame:
    docs = V.embed(r.table("documents", "doc_id", "text"), "text", letter_counts)
    return docs.select("doc_id", F.size("embedding").alias("dimensions"), F.round(F.col("embedding")[4].cast("double"), 4).alias("e_share"))


@query("V2_with_vectors", """
    SELECT release_id, category, place, pv_score, len(embedding)::INTEGER AS dimensions FROM vectors""", "vectors")
def v2(r: Roles) -> DataFrame:
    embedding = r.table("embeddings").select(F.col("vec_id").alias("release_id"), "embedding", F.col("label").alias("category"))
    rows = r.release().withColumn("pv_score", F.round(F.log1p("page_view") / 14, 6))
    return V.with_vectors(rows.drop("category"), embedding, KEY).select(
        "release_id", "category", "place", "pv_score", F.size("embedding").alias("dimensions")
    )


@query("V3_search", f"WITH {SEARCH}, {top_sql(8)} SELECT query_id, release_id, score, rank FROM top", "vectors")
def v3(r: Roles) -> DataFrame:
    return V.search(r.queries(), r.vectors(), "query_id", KEY)


@query("V3_search_grid", f"WITH {SEARCH}, {top_sql(8)} SELECT query_id, release_id, score, rank FROM top", "vectors")
def v3_grid(r: Roles) -> DataFrame:
    """The same search in the form for query sets of any size, by the index of pivot cells."""
    return V.nearest(r.queries(), r.vectors(), "query_id", KEY, 8, V.SEARCH_BONUS, broadcast_cells=0, block_rows=200)


@query("V3_search_pivots", f"WITH {SEARCH}, {top_sql(8)} SELECT query_id, release_id, score, rank FROM top", "vectors")
def v3_pivots(r: Roles) -> DataFrame:
    """The index of pivot cells with leaves of the usual size."""
    return V.nearest(r.queries(), r.vectors(), "query_id", KEY, 8, V.SEARCH_BONUS, broadcast_cells=0)


@query("V4_plan_score", f"""
    WITH {NEAR}, {top_sql(20)} SELECT query_id, round(median(pv_score), 9) AS plan_score FROM top GROUP BY 1""", "vectors")
def v4(r: Roles) -> DataFrame:
    return rounded(V.plan_score(r.queries(), r.vectors(), "query_id", KEY), "plan_score", digits=9)


DISTINCTIVE = """
    taken AS (SELECT t.query_id, t.release_id, m.outlet FROM top t JOIN media m USING (release_id)),
    sizes AS (SELECT query_id, count(*) AS n FROM top GROUP BY 1),
    hits AS (SELECT query_id, outlet, count(*) AS hits FROM taken GROUP BY 1, 2),
    rare AS (SELECT query_id, outlet, hits, round(hits * ln((SELECT count(DISTINCT release_id) FROM media)::DOUBLE
                    / greatest(coalesce(case_count, 1), 1)), 9) AS score
             FROM hits JOIN sizes USING (query_id) LEFT JOIN frequency USING (outlet) WHERE hits <= greatest(n * 0.5, 1)),
    by_set AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, outlet)::INTEGER AS rank
               FROM rare QUALIFY rank <= 6),
    by_case AS (SELECT query_id, release_id, outlet, rare.score,
                       row_number() OVER (PARTITION BY query_id, release_id ORDER BY rare.score DESC, outlet)::INTEGER AS rank
                FROM taken JOIN rare USING (query_id, outlet) QUALIFY rank <= 4)"""


@query("V5_distinctive_by_case", f"""
    WITH {SEARCH}, {top_sql(8)}, {DISTINCTIVE} SELECT query_id, release_id, outlet, score, rank FROM by_case""",
    "vectors media frequency")
def v5_case(r: Roles) -> DataFrame:
    by_case, _ = distinctive(r)
    return by_case.select("query_id", "release_id", "outlet", "score", "rank")


@query("V5_distinctive_overall", f"""
    WITH {SEARCH}, {top_sql(8)}, {DISTINCTIVE} SELECT query_id, outlet, hits, score, rank FROM by_set""",
    "vectors media frequency")
def v5_set(r: Roles) -> DataFrame:
    _, by_set = distinctive(r)
    return by_set.select("query_id", "outlet", "hits", "score", "rank")


def distinctive(r: Roles) -> tuple[DataFrame, DataFrame]:
    cases = V.search(r.queries(), r.vectors(), "query_id", KEY).select("query_id", *KEY)
    return V.distinctive(cases, *lookups(r), "query_id", KEY, "outlet")


def lookups(r: Roles) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outlets per case, their frequency and the number of cases: tables that a search finds ready."""
    media = materialize(r.media(), "media")
    return media, outlet_frequency(media, KEY, "outlet", unique=True), outlet_total(media, KEY)


BUNDLE_SQL = f"""
    WITH {SEARCH}, {top_sql(24).replace("top AS", "fetched AS", 1)},
    lifted AS (SELECT *, round(score + 0.02 * 3 * (coalesce((q_category = category)::INT, 0) + coalesce((q_place = place)::INT, 0)), 9) AS lifted FROM fetched),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lifted DESC, rank)::INTEGER AS new_rank FROM lifted QUALIFY new_rank <= 8),
    {DISTINCTIVE},
    listed AS (SELECT query_id, release_id, string_agg(outlet::VARCHAR, '+' ORDER BY rank) AS media FROM by_case GROUP BY 1, 2),
    cases AS (SELECT query_id, string_agg(release_id || ':' || coalesce(media, ''), ',' ORDER BY new_rank) AS cases
              FROM top LEFT JOIN listed USING (query_id, release_id) GROUP BY 1),
    overall AS (SELECT query_id, string_agg(outlet::VARCHAR, ',' ORDER BY rank) AS media FROM by_set GROUP BY 1)
    SELECT query_id, cases, coalesce(media, '') AS media FROM cases LEFT JOIN overall USING (query_id)"""


@query("V6_case_bundle", BUNDLE_SQL, "vectors media frequency")
def v6(r: Roles) -> DataFrame:
    bundle = case_bundle(
        r.queries().withColumn("open_count", F.lit(3)), r.vectors(), *lookups(r), "query_id", KEY, "outlet"
    )

    def case(c):
        outlets = F.concat_ws("+", F.transform(c["media"], lambda m: m.cast("string")))
        return F.concat_ws(":", c["release_id"].cast("string"), outlets)

    media = F.concat_ws(",", F.transform("media", lambda m: m.cast("string")))
    return bundle.select("query_id", F.concat_ws(",", F.transform("cases", case)).alias("cases"), media.alias("media"))


@query("J10_vector_top_k", """
    WITH scored AS (SELECT q.release_id AS query_id, c.release_id, round(list_dot_product(q.embedding, c.embedding), 9) AS score
                    FROM vectors q, vectors c),
    """ + top_sql(5) + " SELECT query_id, release_id, score, rank FROM top", "vectors")
def j10(r: Roles) -> DataFrame:
    return V.nearest(r.queries(), r.vectors(), "query_id", KEY, 5, V.Bonus(matches={}))


@query("J11_with_frequency", """
    SELECT m.release_id, m.outlet, coalesce(f.case_count, 1) AS case_count
    FROM (SELECT DISTINCT release_id, outlet FROM clip_log) m LEFT JOIN frequency f USING (outlet)""", "frequency")
def j11(r: Roles) -> DataFrame:
    """All outlets, the own one included, which was never counted."""
    pairs = r.clip_log().select("release_id", "outlet").distinct()
    return V.with_frequency(pairs, r.frequency(), "outlet").select("release_id", "outlet", "case_count")


@query("W6_top_k_per_query", """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice,
           row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey)::INTEGER AS rank
    FROM lineitem QUALIFY rank <= 10""")
def w6(r: Roles) -> DataFrame:
    lines = r.table("lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return V.top_k(lines, ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"], 10).drop("l_partkey")


@query("W7_top_outlets", """
    SELECT release_id, outlet, case_count, row_number() OVER (PARTITION BY release_id ORDER BY case_count DESC, outlet)::INTEGER AS rank
    FROM media JOIN frequency USING (outlet) QUALIFY rank <= 4""", "media frequency")
def w7(r: Roles) -> DataFrame:
    pairs = r.media().join(r.frequency(), "outlet")
    return V.top_k(pairs, KEY, "case_count", ["outlet"], K.OUTLETS_PER_CASE).select("release_id", "outlet", "case_count", "rank")


@query("O2_limit_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def o2(r: Roles) -> DataFrame:
    return V.limit_top(r.table("orders", "o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 100)


@query("O3_rerank", f"""
    WITH {SEARCH}, {top_sql(24)},
    lifted AS (SELECT *, round(score + 0.02 * 6 * (coalesce((q_category = category)::INT, 0) + coalesce((q_place = place)::INT, 0)), 9) AS lifted FROM top)
    SELECT query_id, release_id, lifted, row_number() OVER (PARTITION BY query_id ORDER BY lifted DESC, rank)::INTEGER AS new_rank
    FROM lifted QUALIFY new_rank <= 8""", "vectors")
def o3(r: Roles) -> DataFrame:
    fetched = V.search(r.queries(), r.vectors(), "query_id", KEY, K.SEARCH_TOP_K * K.FETCH_MULTIPLIER, ["category", "place"])
    wanted = r.queries().select("query_id", F.col("category").alias("q_category"), F.col("place").alias("q_place"))
    cases = fetched.join(wanted, "query_id").withColumn("open_count", F.lit(6))
    matches = {"category": ("q_category", "category"), "place": ("q_place", "place")}
    return V.rerank(cases, "query_id", matches, "open_count").select("query_id", "release_id", "lifted", "new_rank")
