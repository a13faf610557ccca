"""Distribution profiles and effects inside comparable cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsreach.operators import effects as E
from newsreach.plans.registry import ORACLES, query, rounded
from newsreach.plans.stand_ins import KEY, Roles

SUMMARY = ("mean_difference", "win_rate", "median_difference", "median_ratio")
TERMS = ["the", "la", "der", "que", "and", "un", "ti", "en"]

# Cells of one SQL relation "rows" with the columns cell..., flag, outcome, and their summary.
SUMMARY_SQL = """
    count(*) AS cells, round(avg(a - b), 6) AS mean_difference, round(avg((a > b)::INT), 6) AS win_rate,
    round(median(a - b), 6) AS median_difference, round(median(CASE WHEN b <> 0 THEN a / b END), 6) AS median_ratio"""


def cells_sql(cell: str, flag: str, outcome: str, source: str, least: int = 3) -> str:
    return f"""cells AS (
        SELECT {cell}, median({outcome}) FILTER (WHERE {flag})::DOUBLE AS a, median({outcome}) FILTER (WHERE NOT {flag})::DOUBLE AS b,
               count({outcome}) FILTER (WHERE {flag}) AS n_with, count({outcome}) FILTER (WHERE NOT {flag}) AS n_without
        FROM {source} GROUP BY ALL HAVING n_with >= {least} AND n_without >= {least})"""


def flagged(r: Roles) -> DataFrame:
    """Announcements with reach and the flag "has a returned line"."""
    returned = r.table("lineitem", "l_orderkey", "l_returnflag").groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("flag")
    )
    return r.reached().join(returned, F.col("release_id") == F.col("l_orderkey")).drop("l_orderkey")


FLAGGED = """flagged AS (
    SELECT r.*, f.flag FROM reached r JOIN (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS flag FROM lineitem GROUP BY 1) f
    ON r.release_id = f.l_orderkey)"""


@query("A15_profile", """
    SELECT metric, count(*) AS n, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS p25,
           quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90,
           round(stddev(value), 6) AS sd
    FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS metric,
                 unnest([l_quantity, l_extendedprice, l_discount]) AS value FROM lineitem) GROUP BY 1""")
def a15(r: Roles) -> DataFrame:
    metrics = ["l_quantity", "l_extendedprice", "l_discount"]
    return rounded(E.profile(r.table("lineitem", *metrics), metrics), "sd")


@query("A16_value_histogram", """
    SELECT l_quantity, count(*) AS rows,
           l_quantity = (SELECT l_quantity FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS is_mode
    FROM lineitem GROUP BY 1""")
def a16(r: Roles) -> DataFrame:
    return E.value_histogram(r.table("lineitem", "l_quantity"), "l_quantity")


@query("A17_zero_rate", """
    SELECT metric, count(value) AS n, round(avg((value = 0)::INT), 9) AS zero_rate, max(value) AS max_value
    FROM (SELECT unnest(['l_tax', 'l_discount']) AS metric, unnest([l_tax, l_discount]) AS value FROM lineitem) GROUP BY 1""")
def a17(r: Roles) -> DataFrame:
    return rounded(E.zero_rate(r.table("lineitem", "l_tax", "l_discount"), ["l_tax", "l_discount"]), "zero_rate", digits=9)


@query("A18_fill_rate", """
    SELECT date_trunc('month', starts_at)::DATE AS period, count(*) AS rows,
           round(avg((coalesce(location <> '', false))::INT), 9) AS location_rate,
           round(avg((coalesce(description <> '', false))::INT), 9) AS description_rate
    FROM calendar GROUP BY 1""", "calendar")
def a18(r: Roles) -> DataFrame:
    rates = E.fill_rate(r.events(), ["location", "description"], "starts_at")
    return rounded(rates, "location_rate", "description_rate", digits=9)


@query("A19_activity_buckets", """
    SELECT bucket, count(*) AS entities, round(count(*) / (SELECT count(DISTINCT l_orderkey) FROM lineitem)::DOUBLE, 9) AS share
    FROM (SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' ELSE '11+' END AS bucket
          FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)) GROUP BY 1""")
def a19(r: Roles) -> DataFrame:
    return rounded(E.activity_buckets(r.table("lineitem", "l_orderkey"), ["l_orderkey"]), "share", digits=9)


ORDINAL_SQL = """
    SELECT ordinal, metric, count(*) AS n, round(median(value), 6) AS median, round(avg(value), 4) AS mean
    FROM (SELECT ordinal, unnest(['page_view', 'reach']) AS metric, unnest([page_view, reach::DOUBLE]) AS value
          FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY created_at, release_id)::INTEGER AS ordinal
                FROM reached)) GROUP BY 1, 2"""


@query("A20_by_ordinal", ORDINAL_SQL, "reached")
def a20(r: Roles) -> DataFrame:
    table = E.by_ordinal(r.reached(), ["company_id"], "created_at", KEY, ["page_view", "reach"])
    return rounded(rounded(table, "median"), "mean", digits=4)


@query("A20_ordinal_in_a_day_split", """
    WITH numbered AS (SELECT row_number() OVER (PARTITION BY starts_at::DATE ORDER BY id) AS ordinal, score FROM calendar)
    SELECT ordinal::INTEGER AS ordinal, 'score' AS metric, count(score) AS n, round(median(score), 6) AS median, round(avg(score), 9) AS mean
    FROM numbered GROUP BY 1 HAVING count(score) > 0""", "calendar")
def a20_day(r: Roles) -> DataFrame:
    """Entities whose rows all fall on one moment, split by what breaks the ties."""
    days = r.events().select(F.col("starts_at").cast("date").alias("day"), "id", "score")
    table = E.by_ordinal(days, ["day"], "day", ["id"], ["score"], hot_rows=0)
    return rounded(rounded(table, "median"), "mean", digits=9)


@query("A20_by_ordinal_split", ORDINAL_SQL, "reached")
def a20_split(r: Roles) -> DataFrame:
    """The same with every entity treated as a hot one."""
    table = E.by_ordinal(r.reached(), ["company_id"], "created_at", KEY, ["page_view", "reach"], hot_rows=0)
    return rounded(rounded(table, "median"), "mean", digits=4)


PAIRED_SQL = f"WITH {FLAGGED}, {cells_sql('company_id', 'flag', 'reach', 'flagged')} SELECT {SUMMARY_SQL} FROM cells"


@query("A21_paired_effect", PAIRED_SQL, "reached")
def a21(r: Roles) -> DataFrame:
    return rounded(E.paired_effect(flagged(r), ["company_id"], "flag", "reach"), *SUMMARY)


@query("A21_paired_effect_split", PAIRED_SQL, "reached")
def a21_split(r: Roles) -> DataFrame:
    """The same with every cell treated as a hot one."""
    return rounded(E.paired_effect(flagged(r), ["company_id"], "flag", "reach", hot_rows=0), *SUMMARY)


@query("A21_accepted_effects", f"""
    WITH {FLAGGED}, {cells_sql('category, release_type, place', 'flag', 'reach', 'flagged')},
    effects AS (SELECT category, {SUMMARY_SQL} FROM cells GROUP BY category)
    SELECT *, coalesce(win_rate >= 0.6 AND median_ratio >= 1.15, false) AS accepted FROM effects""", "reached")
def a21_accepted(r: Roles) -> DataFrame:
    """Effect per category, judged by the rule for win rate and median ratio."""
    effects = E.paired_effect(flagged(r), ["release_type", "place"], "flag", "reach", by=["category"])
    return E.accepted(rounded(effects, *SUMMARY))


TIMED_SQL = f"""
    WITH {FLAGGED},
    months AS (SELECT date_trunc('month', created_at) AS m, median(page_view) AS med FROM flagged GROUP BY 1),
    timed AS (SELECT category, date_trunc('quarter', created_at) AS q, flag, CASE WHEN med <> 0 THEN page_view / med END AS rel
              FROM flagged JOIN months ON date_trunc('month', created_at) = m),
    {cells_sql('category, q', 'flag', 'rel', 'timed')}
    SELECT {SUMMARY_SQL} FROM cells"""


@query("A22_timed_effect", TIMED_SQL, "reached")
def a22(r: Roles) -> DataFrame:
    return rounded(E.timed_effect(flagged(r), ["category"], "flag", "page_view", "created_at"), *SUMMARY)


@query("A23_recent_effect", f"""
    WITH latest AS (SELECT max(created_at) AS t FROM reached),
    recent AS (SELECT category, release_type, page_view,
                      created_at >= (SELECT t::DATE - INTERVAL 3 MONTH FROM latest) AS flag FROM reached),
    {cells_sql('category, release_type', 'flag', 'page_view', 'recent')}
    SELECT {SUMMARY_SQL} FROM cells""", "reached")
def a23(r: Roles) -> DataFrame:
    return rounded(E.recent_effect(r.reached(), ["category", "release_type"], "page_view", "created_at"), *SUMMARY)


@query("A24_one_vs_rest", f"""
    WITH dated AS (SELECT category, date_trunc('quarter', created_at) AS q, place, page_view FROM release WHERE place IS NOT NULL),
    crossed AS (SELECT p.place, d.category, d.q, d.page_view, d.place = p.place AS flag
                FROM dated d JOIN (SELECT DISTINCT category, q, place FROM dated) p ON d.category = p.category AND d.q = p.q),
    {cells_sql('place, category, q', 'flag', 'page_view', 'crossed')}
    SELECT place, {SUMMARY_SQL} FROM cells GROUP BY place""", "release")
def a24(r: Roles) -> DataFrame:
    dated = r.release().withColumn("quarter", F.trunc(F.col("created_at").cast("date"), "quarter"))
    return rounded(E.one_vs_rest(dated, ["category", "quarter"], "place", "page_view"), *SUMMARY)


@query("A24_one_vs_rest_split", ORACLES["A24_one_vs_rest"])
def a24_split(r: Roles) -> DataFrame:
    """The same with every cell treated as a hot one."""
    dated = r.release().withColumn("quarter", F.trunc(F.col("created_at").cast("date"), "quarter"))
    return rounded(E.one_vs_rest(dated, ["category", "quarter"], "place", "page_view", hot_rows=0), *SUMMARY)


@query("A25_rate_contrast", f"""
    WITH {FLAGGED}
    SELECT outlet, count(*) FILTER (WHERE flag) AS cases_with, count(*) FILTER (WHERE NOT flag) AS cases_without,
           round(100 * (count(*) FILTER (WHERE flag) / (SELECT count(*) FROM flagged WHERE flag)::DOUBLE
                      - count(*) FILTER (WHERE NOT flag) / (SELECT count(*) FROM flagged WHERE NOT flag)::DOUBLE), 6) AS gap_points
    FROM media JOIN flagged USING (release_id) GROUP BY 1""", "media reached")
def a25(r: Roles) -> DataFrame:
    return rounded(E.rate_contrast(flagged(r), r.media(), KEY, "flag", "outlet"), "gap_points")


@query("A26_segment_effect", f"""
    WITH {FLAGGED}, {cells_sql('category, release_type', 'flag', 'reach', 'flagged', 30)}
    SELECT category, release_type, n_with, n_without, a AS median_with, b AS median_without, a - b AS difference FROM cells""",
    "reached")
def a26(r: Roles) -> DataFrame:
    return E.segment_effect(flagged(r), ["category", "release_type"], "flag", "reach")


def term_rows_sql(outcome: str) -> str:
    listed = ", ".join(f"'{t}'" for t in TERMS)
    return f"""rows AS (SELECT term, source, lang, {outcome} AS outcome, contains(text, term) AS flag
        FROM documents, (SELECT unnest([{listed}]) AS term))"""


@query("A27_term_effect", f"""
    WITH {term_rows_sql('n_chars')}, {cells_sql('term, source, lang', 'flag', 'outcome', 'rows')}
    SELECT term, {SUMMARY_SQL} FROM cells GROUP BY term""")
def a27(r: Roles) -> DataFrame:
    docs = r.table("documents", "text", "source", "lang", "n_chars")
    return rounded(E.term_effect(docs, "text", TERMS, ["source", "lang"], "n_chars"), *SUMMARY)


@query("A27_term_effect_split", ORACLES["A27_term_effect"])
def a27_split(r: Roles) -> DataFrame:
    """The same with every cell treated as a hot one."""
    docs = r.table("documents", "text", "source", "lang", "n_chars")
    return rounded(E.term_effect(docs, "text", TERMS, ["source", "lang"], "n_chars", hot_rows=0), *SUMMARY)


@query("A27_effect_correlation", f"""
    WITH base AS (SELECT source, lang, text, n_chars, length(text) - length(replace(text, '.', '')) AS dots FROM documents),
    t AS (SELECT term, source, lang, n_chars, dots, contains(text, term) AS flag
          FROM base, (SELECT unnest([{', '.join(f"'{t}'" for t in TERMS)}]) AS term)),
    c AS (SELECT term, source, lang, median(n_chars) FILTER (WHERE flag) AS a1, median(n_chars) FILTER (WHERE NOT flag) AS b1,
                 median(dots) FILTER (WHERE flag) AS a2, median(dots) FILTER (WHERE NOT flag) AS b2
          FROM t GROUP BY ALL HAVING count(*) FILTER (WHERE flag) >= 3 AND count(*) FILTER (WHERE NOT flag) >= 3),
    e AS (SELECT term, median(a1 - b1) AS x, median(a2 - b2) AS y FROM c GROUP BY 1)
    SELECT count(*) AS terms, round(corr(x, y), 6) AS correlation FROM e""")
def a27_correlation(r: Roles) -> DataFrame:
    docs = r.table("documents", "text", "source", "lang", "n_chars").withColumn(
        "dots", F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))
    )
    by_length = E.term_effect(docs, "text", TERMS, ["source", "lang"], "n_chars")
    by_dots = E.term_effect(docs, "text", TERMS, ["source", "lang"], "dots")
    return rounded(E.effect_correlation(by_length, by_dots, value="median_difference"), "correlation")


@query("A28_size_correlation", """
    SELECT metric, round(corr(value, n), 6) AS correlation
    FROM (SELECT unnest(['page_view', 'reach']) AS metric, unnest([page_view, reach::DOUBLE]) AS value, n
          FROM reached JOIN (SELECT company_id, count(*) AS n FROM reached GROUP BY 1) USING (company_id)) GROUP BY 1""",
    "reached")
def a28(r: Roles) -> DataFrame:
    return rounded(E.entity_size_correlation(r.reached(), ["company_id"], ["page_view", "reach"]), "correlation")


@query("A28_metric_correlation", """
    SELECT metric, round(corr(value, l_quantity), 6) AS correlation
    FROM (SELECT unnest(['l_extendedprice', 'l_tax']) AS metric, unnest([l_extendedprice, l_tax]) AS value, l_quantity
          FROM lineitem) GROUP BY 1""")
def a28_metric(r: Roles) -> DataFrame:
    lines = r.table("lineitem", "l_extendedprice", "l_tax", "l_quantity")
    return rounded(E.metric_correlation(lines, ["l_extendedprice", "l_tax"], "l_quantity"), "correlation")


@query("A30_term_position", """
    SELECT metric, count(*) AS rows, round(avg(position), 9) AS mean_position
    FROM (SELECT metric, text, percent_rank() OVER (PARTITION BY metric ORDER BY value DESC) AS position
          FROM (SELECT text, unnest(['n_chars', 'dots']) AS metric, unnest([n_chars, length(text) - length(replace(text, '.', ''))]) AS value
                FROM documents)) WHERE contains(text, 'the') GROUP BY 1""")
def a30(r: Roles) -> DataFrame:
    docs = r.table("documents", "text", "n_chars").withColumn(
        "dots", F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))
    )
    return rounded(E.term_position(docs, "text", "the", ["n_chars", "dots"]), "mean_position", digits=9)


@query("A31_coverage", """
    SELECT count(*) AS keys, count(l.k) AS matched, round(avg((l.k IS NOT NULL)::INT), 9) AS coverage
    FROM (SELECT DISTINCT o_orderkey FROM orders) o LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o_orderkey = k""")
def a31(r: Roles) -> DataFrame:
    lines = r.table("lineitem", "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey"))
    return rounded(E.coverage(r.table("orders", "o_orderkey"), lines, ["o_orderkey"]), "coverage", digits=9)
