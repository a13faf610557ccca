"""Regional lift, regional reach and normalised outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsreach.operators import outcome as O
from newsreach.operators import rollup as R
from newsreach.operators.effects import regional_supply
from newsreach.plans.registry import query, rounded
from newsreach.plans.stand_ins import KEY, LIFT_MIN, Roles


def lift_table(r: Roles) -> DataFrame:
    return O.lift(r.release(), r.media(), KEY, "place", "outlet")


@query("A5_lift", "SELECT place, outlet, hits, round(lift, 9) AS lift FROM lift", "lift")
def a5(r: Roles) -> DataFrame:
    return rounded(lift_table(r), "lift", digits=9)


@query("A6_regional_reach", "SELECT release_id, regional_reach FROM regional", "regional")
def a6(r: Roles) -> DataFrame:
    return O.regional_reach(r.release(), r.media(), KEY, "place", "outlet", LIFT_MIN)


@query("A7_regional_media", """
    SELECT p.place, p.outlet, count(*) AS cases, round(count(*) / any_value(n.n)::DOUBLE, 9) AS share
    FROM placed p JOIN (SELECT place, count(*) AS n FROM release GROUP BY 1) n ON n.place = p.place
    GROUP BY 1, 2""", "placed release")
def a7(r: Roles) -> DataFrame:
    table = O.regional_media(r.release(), r.media(), KEY, ["place"], "outlet")
    return rounded(table.select("place", "outlet", "cases", "share"), "share", digits=9)


@query("A8_place_weight", """
    SELECT place, round(avg((regional_reach > 0)::INT), 9) AS regional_weight FROM corpus
    WHERE place IS NOT NULL GROUP BY 1""", "corpus")
def a8(r: Roles) -> DataFrame:
    return rounded(O.place_weight(r.corpus(), "place", "regional_reach"), "regional_weight", digits=9)


@query("A8_weight_default", """
    SELECT release_id, round(coalesce(w.w, 0.77), 9) AS regional_weight
    FROM release LEFT JOIN (SELECT place, avg((regional_reach > 0)::INT) AS w FROM corpus
                            WHERE place IS NOT NULL GROUP BY 1) w USING (place)""", "release corpus")
def a8_default(r: Roles) -> DataFrame:
    weights = O.place_weight(r.corpus(), "place", "regional_reach")
    weighted = O.with_place_weight(r.release().select("release_id", "place"), weights, "place")
    return rounded(weighted.select("release_id", "regional_weight"), "regional_weight", digits=9)


@query("A14_score_drift", """
    SELECT year(created_at)::INTEGER AS year, count(*) AS n, round(median(pv_score), 9) AS median_score
    FROM (SELECT created_at, (percent_rank() OVER m + cume_dist() OVER m) / 2 AS pv_score FROM release
          WINDOW m AS (PARTITION BY date_trunc('month', created_at) ORDER BY page_view)) GROUP BY 1""", "release")
def a14(r: Roles) -> DataFrame:
    ranked = O.month_midrank(r.release().select("created_at", "page_view"), "created_at", "page_view")
    return rounded(R.score_drift(ranked, "created_at", "pv_score"), "median_score", digits=9)


@query("A32_regional_supply", """
    SELECT place, count(*) AS outlets, sum(hits)::BIGINT AS listings FROM lift WHERE lift >= 1.2 GROUP BY 1""", "lift")
def a32(r: Roles) -> DataFrame:
    return regional_supply(lift_table(r), "place", "outlet", LIFT_MIN)


@query("W4_month_midrank", """
    SELECT release_id, round((percent_rank() OVER m + cume_dist() OVER m) / 2, 9) AS pv_score FROM release
    WINDOW m AS (PARTITION BY date_trunc('month', created_at) ORDER BY page_view)""", "release")
def w4(r: Roles) -> DataFrame:
    ranked = O.month_midrank(r.release().select("release_id", "created_at", "page_view"), "created_at", "page_view")
    return rounded(ranked.select("release_id", "pv_score"), "pv_score", digits=9)


PLACE_RANK_SQL = """
    SELECT release_id, round((percent_rank() OVER m + cume_dist() OVER m) / 2, 9) AS regional_score FROM corpus
    WINDOW m AS (PARTITION BY place ORDER BY regional_reach)"""


@query("W5_place_midrank", PLACE_RANK_SQL, "corpus")
def w5(r: Roles) -> DataFrame:
    ranked = O.place_midrank(r.corpus().select("release_id", "place", "regional_reach"), "place", "regional_reach")
    return rounded(ranked.select("release_id", "regional_score"), "regional_score", digits=9)


@query("W5_place_midrank_split", PLACE_RANK_SQL, "corpus")
def w5_split(r: Roles) -> DataFrame:
    """The same ranks with every place treated as a hot one."""
    ranked = O.place_midrank(r.corpus().select("release_id", "place", "regional_reach"), "place", "regional_reach", hot_rows=0)
    return rounded(ranked.select("release_id", "regional_score"), "regional_score", digits=9)


@query("corpus_enriched", """
    WITH told AS (SELECT o_orderkey AS release_id, o_orderpriority AS subtitle, CASE WHEN o_orderstatus = 'O' THEN o_orderstatus END AS body_head
                  FROM orders WHERE o_orderstatus <> 'P'),
    viewed AS (SELECT o_orderkey AS release_id, o_totalprice AS page_view FROM orders WHERE o_totalprice > 100000),
    joined AS (SELECT r.release_id, r.created_at, r.place, coalesce(t.subtitle, '') AS subtitle, coalesce(t.body_head, '') AS body_head,
                      coalesce(v.page_view, 0)::DOUBLE AS page_view, coalesce(g.regional_reach, 0) AS regional_reach
               FROM release r LEFT JOIN told t USING (release_id) LEFT JOIN viewed v USING (release_id) LEFT JOIN regional g USING (release_id))
    SELECT release_id, subtitle, body_head, page_view, regional_reach,
           round((percent_rank() OVER m + cume_dist() OVER m) / 2, 9) AS pv_score,
           round((percent_rank() OVER p + cume_dist() OVER p) / 2, 9) AS regional_score
    FROM joined WINDOW m AS (PARTITION BY date_trunc('month', created_at) ORDER BY page_view), p AS (PARTITION BY place ORDER BY regional_reach)""",
    "release regional")
def enriched(r: Roles) -> DataFrame:
    """The working corpus in one go: text and views where there are any, regional reach, both scores on a fair scale."""
    orders = r.table("orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    status = F.col("o_orderstatus")
    told = orders.where(status != "P").select(
        F.col("o_orderkey").alias("release_id"), F.col("o_orderpriority").alias("subtitle"), F.when(status == "O", status).alias("body_head"))
    viewed = orders.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("release_id"), F.col("o_totalprice").cast("double").alias("page_view"))
    base = r.release().select("release_id", "created_at", "place")
    corpus = O.enrich(base, told, viewed, r.media(), KEY, "place", "outlet", lift_min=LIFT_MIN)
    picked = corpus.select("release_id", "subtitle", "body_head", "page_view", "regional_reach", "pv_score", "regional_score")
    return rounded(picked, "pv_score", "regional_score", digits=9)
