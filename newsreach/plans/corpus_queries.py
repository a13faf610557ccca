"""Corpus building: extract, roll-up, selection, lookups, ordering."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsreach.operators import corpus as C
from newsreach.operators import rollup as R
from newsreach.operators.outcome import month_midrank
from newsreach.operators.place import name_leaks, resolve_place
from newsreach.plans.registry import query, rounded
from newsreach.plans.stand_ins import KEY, OWN_OUTLET, Roles
from newsreach.sources.database import key_slices


@query("flagship_stratified_midrank", """
    SELECT release_id, category, release_type, place, reach, round(pv_score, 9) AS pv_score
    FROM (SELECT *, (percent_rank() OVER m + cume_dist() OVER m) / 2 AS pv_score
          FROM (SELECT *, row_number() OVER (PARTITION BY category, release_type, place
                                             ORDER BY reach DESC, release_id) AS rn
                FROM reached WHERE reach > 0) WHERE rn <= 5
          WINDOW m AS (PARTITION BY date_trunc('month', created_at) ORDER BY page_view))
    """, "reached")
def flagship(r: Roles) -> DataFrame:
    """Which announcements reached most outlets in their stratum, and how do they rank in their month?"""
    picked = C.stratified_top(r.reached().where("reach > 0"), ["category", "release_type", "place"], "reach", KEY, 5)
    ranked = month_midrank(picked, "created_at", "page_view")
    return rounded(ranked.select("release_id", "category", "release_type", "place", "reach", "pv_score"), "pv_score", digits=9)


@query("S1_key_slices", """
    SELECT CAST(floor(l_orderkey / 2000.0) AS BIGINT) AS slice, count(*) AS rows, count(DISTINCT l_orderkey) AS keys
    FROM lineitem GROUP BY 1""")
def s1(r: Roles) -> DataFrame:
    return key_slices(r.table("lineitem", "l_orderkey"), "l_orderkey", 0, 2000)


@query("S2_project_release", """
    SELECT event_id, user_id, ts, length(props)::INTEGER AS props_len, event_type <> '' AS has_event_type
    FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2025-01-01'""")
def s2(r: Roles) -> DataFrame:
    return R.project_release(
        r.table("events"), datetime(2024, 1, 1), datetime(2025, 1, 1), ["event_id", "user_id", "ts"], ["props"],
        ["event_type"], "ts",
    )


@query("S3_main_rows", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1")
def s3(r: Roles) -> DataFrame:
    return R.main_rows(r.table("lineitem"), ["l_orderkey", "l_partkey"], "l_linenumber")


@query("S5_column_pruned_scan", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def s5(r: Roles) -> DataFrame:
    return r.table("orders", "o_orderkey", "o_custkey", "o_orderdate")


@query("S6_fetch_by_keys", """
    SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def s6(r: Roles) -> DataFrame:
    keys = r.table("orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("l_orderkey")
    )
    return C.fetch_by_keys(r.table("lineitem", "l_orderkey", "l_linenumber", "l_suppkey"), keys, ["l_orderkey"])


@query("F1_candidates", """
    SELECT release_id, created_at, reach FROM reached
    WHERE created_at >= TIMESTAMP '1998-01-01' AND reach > 0 AND title <> ''""", "reached")
def f1(r: Roles) -> DataFrame:
    return C.candidates(r.reached(), "1998-01-01").select("release_id", "created_at", "reach")


@query("F2_exclude_self", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey <> 5")
def f2(r: Roles) -> DataFrame:
    return R.exclude_self(r.table("lineitem", "l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", OWN_OUTLET)


@query("J1_inner_join", """
    SELECT release_id, company_id, clip_rows, outlets FROM release JOIN rollup USING (release_id)""", "release rollup")
def j1(r: Roles) -> DataFrame:
    return r.release().select("release_id", "company_id").join(r.rollup().select("release_id", "clip_rows", "outlets"), KEY)


@query("J2_left_enrich", """
    SELECT release_id, page_view, clip_rows FROM release LEFT JOIN rollup USING (release_id)""", "release rollup")
def j2(r: Roles) -> DataFrame:
    return C.left_enrich(r.release().select("release_id", "page_view"), r.rollup().select("release_id", "clip_rows"), KEY)


@query("J3_star_lookup", """
    SELECT l_orderkey, l_linenumber, p_name, s_name, n_name, r_name, o_orderpriority
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
    LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN orders ON l_orderkey = o_orderkey""")
def j3(r: Roles) -> DataFrame:
    def dimension(name: str, key: str, fact_key: str, *columns: str) -> DataFrame:
        return r.table(name, key, *columns).withColumnRenamed(key, fact_key)

    named = C.add_names(
        r.table("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        {
            "l_partkey": dimension("part", "p_partkey", "l_partkey", "p_name"),
            "l_suppkey": dimension("supplier", "s_suppkey", "l_suppkey", "s_name", "s_nationkey"),
            "s_nationkey": dimension("nation", "n_nationkey", "s_nationkey", "n_name", "n_regionkey"),
            "n_regionkey": dimension("region", "r_regionkey", "n_regionkey", "r_name"),
            "l_orderkey": dimension("orders", "o_orderkey", "l_orderkey", "o_orderpriority"),
        },
    )
    return named.select("l_orderkey", "l_linenumber", "p_name", "s_name", "n_name", "r_name", "o_orderpriority")


@query("J4_pair_list_join", """
    SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
    WHERE (l_orderkey, l_suppkey) IN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')""")
def j4(r: Roles) -> DataFrame:
    pairs = r.table("lineitem", "l_orderkey", "l_suppkey", "l_returnflag").where("l_returnflag = 'R'")
    return C.fetch_by_keys(
        r.table("lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity"), pairs, ["l_orderkey", "l_suppkey"]
    )


@query("J5_share_of_total", """
    SELECT outlet, count(*) AS cases, round(count(*) / (SELECT count(*) FROM media)::DOUBLE, 9) AS share
    FROM media GROUP BY outlet""", "media")
def j5(r: Roles) -> DataFrame:
    counts = r.media().groupBy("outlet").agg(F.count(F.lit(1)).alias("cases"))
    return rounded(R.with_share(counts, F.col("cases")), "share", digits=9)


@query("J6_share_within_group", """
    SELECT place, outlet, count(*) AS cases,
           round(count(*) / (SELECT count(*) FROM release r WHERE r.place = p.place)::DOUBLE, 9) AS share
    FROM placed p GROUP BY place, outlet""", "placed")
def j6(r: Roles) -> DataFrame:
    release = r.release().where("place IS NOT NULL")
    counts = r.media().join(release.select("release_id", "place"), KEY).groupBy("place", "outlet").agg(
        F.count(F.lit(1)).alias("cases")
    )
    sizes = release.groupBy("place").agg(F.count(F.lit(1)).alias("size"))
    return rounded(C.share_within(counts, "place", "cases", sizes, "size"), "share", digits=9)


@query("J7_not_seen_before", """
    SELECT o_orderkey, o_custkey, o_orderpriority FROM orders l WHERE o_orderdate >= TIMESTAMP '2000-01-01'
      AND NOT EXISTS (SELECT 1 FROM orders e WHERE e.o_orderdate < TIMESTAMP '2000-01-01'
                      AND e.o_custkey = l.o_custkey AND e.o_orderpriority = l.o_orderpriority)""")
def j7(r: Roles) -> DataFrame:
    orders = r.table("orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    later, earlier = orders.where("o_orderdate >= '2000-01-01'"), orders.where("o_orderdate < '2000-01-01'")
    return C.not_seen_before(later, earlier, ["o_custkey", "o_orderpriority"]).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("J8_assign_group", """
    SELECT o_orderkey, o_custkey, c_mktsegment AS split FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def j8(r: Roles) -> DataFrame:
    members = r.table("customer", "c_custkey", "c_mktsegment").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("split")
    )
    return C.assign_group(r.table("orders", "o_orderkey", "o_custkey"), members, ["o_custkey"])


PLACE_TEXT_SQL = """
    texts AS (
        SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Hall in ' || r_name || ' near ' || n_name
                               WHEN 'MACHINERY' THEN n_name || ' centre'
                               WHEN 'AUTOMOBILE' THEN n_name || ' and NATION_3 fair'
                               WHEN 'FURNITURE' THEN substr(r_name, 1, 3) || ' office'
                               ELSE 'online' END AS place_text
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    full_hit AS (SELECT c_custkey, min(r_regionkey) AS id FROM texts JOIN region ON contains(place_text, r_name) GROUP BY 1),
    votes AS (SELECT c_custkey, n_regionkey AS id, count(*) AS v FROM texts JOIN nation ON contains(place_text, n_name) GROUP BY 1, 2),
    best AS (SELECT c_custkey, max(v) AS v FROM votes GROUP BY 1),
    city_hit AS (SELECT c_custkey, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM votes JOIN best USING (c_custkey, v) GROUP BY 1)"""


@query("J9_resolve_place", f"""
    WITH {PLACE_TEXT_SQL}
    SELECT t.c_custkey, place_text, coalesce(f.id, c.id) AS prefecture_id
    FROM texts t LEFT JOIN full_hit f USING (c_custkey) LEFT JOIN city_hit c USING (c_custkey)""")
def j9(r: Roles) -> DataFrame:
    nation, region = r.table("nation"), r.table("region")
    places = C.place_index(
        region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("prefecture_id")),
        nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("prefecture_id")),
    )
    segment, n_name, r_name = F.col("c_mktsegment"), F.col("n_name"), F.col("r_name")
    text = (
        F.when(segment == "BUILDING", F.concat(F.lit("Hall in "), r_name, F.lit(" near "), n_name))
        .when(segment == "MACHINERY", F.concat(n_name, F.lit(" centre")))
        .when(segment == "AUTOMOBILE", F.concat(n_name, F.lit(" and NATION_3 fair")))
        .when(segment == "FURNITURE", F.concat(F.left(r_name, F.lit(3)), F.lit(" office")))
        .otherwise("online")
    )
    customers = (
        r.table("customer", "c_custkey", "c_nationkey", "c_mktsegment")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", text.alias("place_text"))
    )
    return resolve_place(customers, "place_text", places)


SUFFIX_TEXT = """
    texts AS (
        SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Hall in ' || r_name || '県 near ' || n_name
                               WHEN 'MACHINERY' THEN r_name || ' centre, ' || n_name
                               WHEN 'AUTOMOBILE' THEN n_name || ' fair'
                               ELSE substr(r_name, 1, 3) || '都' END AS place_text
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    full_hit AS (SELECT c_custkey, min(r_regionkey) AS id FROM texts JOIN region ON contains(place_text, r_name || '県') GROUP BY 1),
    short_hit AS (SELECT c_custkey, min(r_regionkey) AS id FROM texts JOIN region ON contains(place_text, r_name) GROUP BY 1),
    votes AS (SELECT c_custkey, n_regionkey AS id, count(*) AS v FROM texts JOIN nation ON contains(place_text, n_name) GROUP BY 1, 2),
    best AS (SELECT c_custkey, max(v) AS v FROM votes GROUP BY 1),
    city_hit AS (SELECT c_custkey, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM votes JOIN best USING (c_custkey, v) GROUP BY 1)"""


@query("J9_suffix_stage", f"""
    WITH {SUFFIX_TEXT}
    SELECT t.c_custkey, place_text, coalesce(f.id, s.id, c.id) AS prefecture_id
    FROM texts t LEFT JOIN full_hit f USING (c_custkey) LEFT JOIN short_hit s USING (c_custkey) LEFT JOIN city_hit c USING (c_custkey)""")
def j9_suffix(r: Roles) -> DataFrame:
    """Names with a suffix, which texts give with it, without it or not at all: all three stages decide."""
    nation, region = r.table("nation"), r.table("region")
    places = C.place_index(
        region.select(F.concat("r_name", F.lit("県")).alias("name"), F.col("r_regionkey").alias("prefecture_id")),
        nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("prefecture_id")),
    )
    segment, n_name, r_name = F.col("c_mktsegment"), F.col("n_name"), F.col("r_name")
    text = (
        F.when(segment == "BUILDING", F.concat(F.lit("Hall in "), r_name, F.lit("県 near "), n_name))
        .when(segment == "MACHINERY", F.concat(r_name, F.lit(" centre, "), n_name))
        .when(segment == "AUTOMOBILE", F.concat(n_name, F.lit(" fair")))
        .otherwise(F.concat(F.left(r_name, F.lit(3)), F.lit("都")))
    )
    customers = (
        r.table("customer", "c_custkey", "c_nationkey", "c_mktsegment")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", text.alias("place_text"))
    )
    return resolve_place(customers, "place_text", places)


@query("J12_legal_forms", """
    WITH cases AS (SELECT c_mktsegment AS category, trim(replace(replace(CASE WHEN c_acctbal > 7000 THEN '株式会社' || c_name
                          ELSE c_name || ' 合同会社' END, '株式会社', ''), '合同会社', '')) AS name
                   FROM customer WHERE c_acctbal > 5000 UNION SELECT DISTINCT c_mktsegment, '' FROM customer)
    SELECT category, count(*) AS proposals,
           count(*) FILTER (WHERE EXISTS (SELECT 1 FROM cases c WHERE c.category = r.category AND c.name <> '' AND c.name = r.company_name)) AS leaks
    FROM release r GROUP BY 1""", "release")
def j12_legal(r: Roles) -> DataFrame:
    """Company names with legal forms before and behind, and a case whose name is a legal form alone."""
    proposals = r.release().select(
        "category", "release_id", F.concat(F.lit("Follow "), "company_name", F.lit(" up")).alias("text")
    )
    customers = r.table("customer", "c_name", "c_mktsegment", "c_acctbal")
    name = F.when(F.col("c_acctbal") > 7000, F.concat(F.lit("株式会社"), "c_name")).otherwise(F.concat("c_name", F.lit(" 合同会社")))
    cases = customers.where("c_acctbal > 5000").select(F.col("c_mktsegment").alias("category"), name.alias("company_name"))
    bare = customers.select(F.col("c_mktsegment").alias("category"), F.lit("有限会社").alias("company_name")).distinct()
    return name_leaks(proposals, cases.union(bare), ["category"], ["release_id"], "text", "company_name")


@query("J12_name_leaks", """
    SELECT category, count(*) AS proposals, count(*) FILTER (WHERE c_acctbal > 5000) AS leaks
    FROM release JOIN customer ON company_id = c_custkey GROUP BY 1""", "release")
def j12(r: Roles) -> DataFrame:
    proposals = r.release().select(
        "category", "release_id", F.concat(F.lit("Follow "), "company_name", F.lit(" up")).alias("text")
    )
    cases = r.table("customer", "c_name", "c_mktsegment", "c_acctbal").where("c_acctbal > 5000").select(
        F.col("c_mktsegment").alias("category"), F.col("c_name").alias("company_name")
    )
    return name_leaks(proposals, cases, ["category"], ["release_id"], "text", "company_name")


@query("J13_lookup_name", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'UNKNOWN' ELSE n_name END AS place_name,
           CASE WHEN c_acctbal >= 0 THEN n_nationkey END AS place_id
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def j13(r: Roles) -> DataFrame:
    nation = r.table("nation", "n_nationkey", "n_name")
    named = r.table("customer", "c_custkey", "c_nationkey", "c_acctbal").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.when(F.col("c_acctbal") < 0, "UNKNOWN").otherwise(F.col("n_name")).alias("place_name"))
    renamed = nation.select(F.col("n_name").alias("place_name"), "n_nationkey")
    return C.lookup_name(named, renamed, "place_name", "n_nationkey", "place_id")


@query("A1_clip_rollup", "SELECT * FROM rollup", "rollup")
def a1(r: Roles) -> DataFrame:
    return r.rollup()


@query("A2_outlet_set", "SELECT release_id, outlet FROM media", "media")
def a2(r: Roles) -> DataFrame:
    return r.media()


@query("A3_corpus_report", """
    SELECT count(*)::BIGINT AS rows, count(DISTINCT company_id) AS entities, median(reach)::DOUBLE AS reach_median,
           min(reach) AS reach_min, max(reach) AS reach_max, count(place) AS with_place
    FROM reached""", "reached")
def a3(r: Roles) -> DataFrame:
    return R.corpus_report(r.reached(), "company_id", "reach", "place")


@query("A4_category_counts", """
    SELECT place, category, count(*) AS cases FROM release WHERE place IS NOT NULL GROUP BY 1, 2""", "release")
def a4(r: Roles) -> DataFrame:
    return R.category_counts(r.release(), ["place", "category"])


@query("A9_outlet_frequency", "SELECT outlet, case_count FROM frequency", "frequency")
def a9(r: Roles) -> DataFrame:
    return r.frequency()


@query("A9_outlet_total", "SELECT count(DISTINCT release_id) AS case_count FROM media", "media")
def a9_total(r: Roles) -> DataFrame:
    return r.total()


@query("A10_fill_report", """
    SELECT count(*) AS rows, count(*) FILTER (WHERE title <> '') AS bodies,
           count(*) FILTER (WHERE page_view > 0) AS with_views, count(*) FILTER (WHERE regional_reach > 0) AS with_regional,
           (SELECT count(*) FROM media) AS media_rows, (SELECT count(DISTINCT outlet) FROM media) AS media_outlets
    FROM corpus""", "corpus media")
def a10(r: Roles) -> DataFrame:
    return R.fill_report(r.corpus(), r.media(), "title", "page_view", "regional_reach", "outlet")


@query("A11_duplicate_keys", """
    SELECT l_orderkey, l_suppkey, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def a11(r: Roles) -> DataFrame:
    return R.duplicate_keys(r.table("lineitem", "l_orderkey", "l_suppkey"), ["l_orderkey", "l_suppkey"])


@query("A12_key_parity", """
    SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(*) FROM lineitem) AS right_rows,
           (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS only_left,
           (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS only_right""")
def a12(r: Roles) -> DataFrame:
    lines = r.table("lineitem", "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.key_parity(r.table("orders", "o_orderkey"), lines, ["o_orderkey"])


@query("A13_reach_score", """
    SELECT release_id, reach, round(ln(1 + reach) / (SELECT ln(1 + max(reach)) FROM rollup), 9) AS reach_score
    FROM rollup""", "rollup")
def a13(r: Roles) -> DataFrame:
    return rounded(R.reach_score(r.rollup().select("release_id", "reach"), "reach"), "reach_score", digits=9)


@query("W1_primary_location", """
    SELECT release_id, prefecture_id, city_id FROM (
        SELECT *, row_number() OVER (PARTITION BY release_id
               ORDER BY (city_id IS NULL), prefecture_id NULLS LAST, city_id NULLS LAST) AS rn FROM locations)
    WHERE rn = 1""", "locations")
def w1(r: Roles) -> DataFrame:
    return C.primary_location(r.locations(), KEY)


@query("W2_primary_category", """
    SELECT release_id, min(business_category_id) AS business_category_id FROM categories GROUP BY 1""", "categories")
def w2(r: Roles) -> DataFrame:
    return C.primary_category(r.categories(), KEY)


@query("W3_stratified_top", """
    SELECT release_id, category, release_type, place, reach FROM (
        SELECT *, row_number() OVER (PARTITION BY category, release_type, place ORDER BY reach DESC, release_id) AS rn
        FROM reached) WHERE rn <= 25""", "reached")
def w3(r: Roles) -> DataFrame:
    top = C.stratified_top(r.reached(), ["category", "release_type", "place"], "reach", KEY)
    return top.select("release_id", "category", "release_type", "place", "reach")


@query("O1_key_order", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey")
def o1(r: Roles) -> DataFrame:
    return C.key_order(r.table("orders", "o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"])


@query("O6_place_index", """
    SELECT 'prefecture' AS kind, r_name AS name, r_regionkey AS prefecture_id FROM region
    UNION ALL SELECT 'city', n_name, n_regionkey FROM nation""")
def o6(r: Roles) -> DataFrame:
    return C.place_index(
        r.table("region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("prefecture_id")),
        r.table("nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("prefecture_id")),
    )


@query("O7_distinct", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def o7(r: Roles) -> DataFrame:
    return r.table("lineitem", "l_orderkey", "l_suppkey").distinct()
