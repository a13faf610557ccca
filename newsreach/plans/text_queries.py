"""Text, dates and draft fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsreach import constants as K
from newsreach.functions import arrays as A
from newsreach.functions import fields as D
from newsreach.functions import moments as M
from newsreach.functions import scoring as S
from newsreach.functions import text as X
from newsreach.plans.registry import joined, query, rounded
from newsreach.plans.stand_ins import Roles

# The rule in one step: tags, references and white space separate words, which are joined by one space.
STRIPPED = r"array_to_string(list_filter(regexp_split_to_array({0}, '(<[^>]*>|&[a-zA-Z]+;|&#[0-9]+;|\s)+'), lambda word: word <> ''), ' ')"


@query("C1_html_to_text", f"SELECT page_id, {STRIPPED.format('html')} AS body FROM pages")
def c1(r: Roles) -> DataFrame:
    return r.table("pages", "page_id", "html").select("page_id", X.html_to_text("html").alias("body"))


@query("C1_body_head", f"SELECT page_id, left({STRIPPED.format('left(html, 2500)')}, 1000) AS body_head FROM pages")
def c1_head(r: Roles) -> DataFrame:
    """The stored head of a body: 2500 characters of HTML read, 1000 characters of text kept."""
    head = X.html_to_text("html", K.BODY_RAW_CHARS, K.BODY_TEXT_CHARS)
    return r.table("pages", "page_id", "html").select("page_id", head.alias("body_head"))


@query("C2_flatten_lines", "SELECT doc_id, replace(coalesce(text, ''), chr(10), ' ') AS line FROM documents")
def c2(r: Roles) -> DataFrame:
    return r.table("documents", "doc_id", "text").select("doc_id", X.flatten_lines("text").alias("line"))


@query("C3_text_flags", """
    SELECT id, length(location)::INTEGER AS location_len, length(description)::INTEGER AS description_len,
           location <> '' AS has_location FROM calendar""", "calendar")
def c3(r: Roles) -> DataFrame:
    flagged = X.text_flags(r.events(), ["location", "description"], ["location"])
    return flagged.select("id", "location_len", "description_len", "has_location")


@query("C4_present_text", """
    SELECT p_partkey, concat_ws(chr(10), coalesce(p_name, ''), coalesce(p_type, ''), coalesce(p_brand, '')) AS body FROM part""")
def c4(r: Roles) -> DataFrame:
    part = r.table("part")
    return part.select("p_partkey", X.present_text(part, ["p_name", "p_subtitle", "p_type", "p_brand"]).alias("body"))


@query("C5_event_text", """
    SELECT id, concat_ws(chr(10), nullif(title, ''), nullif(location, ''), nullif(left(description, 500), '')) AS scored_text
    FROM calendar""", "calendar")
def c5(r: Roles) -> DataFrame:
    return r.events().select("id", X.event_text("title", "location", "description").alias("scored_text"))


@query("C6_query_text", """
    SELECT draft_id, concat_ws(' ', title, 'category ' || asked, nullif(place, ''), nullif(array_to_string(partner, ' '), ''), novelty,
                               observation) AS query_text
    FROM drafts""", "drafts")
def c6(r: Roles) -> DataFrame:
    category = F.concat(F.lit("category "), F.col("asked"))
    text = X.query_text("title", "place", "partner", "novelty", "observation", category)
    return r.drafts().select("draft_id", text.alias("query_text"))


@query("C6_advised_text", """
    SELECT draft_id, concat_ws(' ', title, nullif(place, ''), nullif(array_to_string(partner, ' '), ''), novelty, observation,
                               'call ' || asked, 'add a photo') AS advised_text
    FROM drafts""", "drafts")
def c6_advised(r: Roles) -> DataFrame:
    """Text of a plan after two proposals were added to it."""
    plan = X.query_text("title", "place", "partner", "novelty", "observation")
    actions = F.array(F.concat(F.lit("call "), F.col("asked")), F.lit("add a photo"))
    return r.drafts().select("draft_id", X.advised_text(plan, actions).alias("advised_text"))


MOMENTS = """moments AS (
    SELECT event_id, ts, event_type, CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%d')
           WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 'error' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
           WHEN 'signup' THEN 'no date' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS start_text FROM events)"""


def moments(r: Roles) -> DataFrame:
    kind, stamp = F.col("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(kind == "view", F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == "click", F.concat(stamp, F.lit("Z")))
        .when(kind == "error", F.concat(stamp, F.lit("+02:00")))
        .when(kind == "signup", F.lit("no date"))
        .otherwise(stamp)
    )
    return r.table("events", "event_id", "ts", "event_type").withColumn("start_text", text)


@query("C7_parse_moment", f"""
    WITH {MOMENTS}
    SELECT event_id, length(start_text) = 10 AS all_day,
           epoch_us(CASE event_type WHEN 'signup' THEN NULL WHEN 'view' THEN date_trunc('day', ts) - INTERVAL 9 HOUR
                    WHEN 'click' THEN date_trunc('second', ts) WHEN 'error' THEN date_trunc('second', ts) - INTERVAL 2 HOUR
                    ELSE date_trunc('second', ts) - INTERVAL 9 HOUR END) AS micros
    FROM moments""")
def c7(r: Roles) -> DataFrame:
    return moments(r).select(
        "event_id", M.is_all_day("start_text").alias("all_day"), F.unix_micros(M.parse_moment("start_text")).alias("micros")
    )


@query("C8_render_moment", """
    SELECT event_id, CASE WHEN event_type = 'view' THEN strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d')
                          ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS start_text
    FROM events""")
def c8(r: Roles) -> DataFrame:
    # the wall time of the table is UTC, whatever the session zone is
    instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    events = r.table("events", "event_id", "ts", "event_type").withColumn("moment", instant)
    return events.select("event_id", M.render_moment("moment", F.col("event_type") == "view").alias("start_text"))


@query("C9_calendar_parts", """
    SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month, date_trunc('quarter', o_orderdate)::DATE AS quarter,
           o_orderdate::DATE AS day, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders""")
def c9(r: Roles) -> DataFrame:
    at = "o_orderdate"
    return r.table("orders", "o_orderkey", at).select(
        "o_orderkey", M.month_of(at).alias("month"), M.quarter_of(at).alias("quarter"), M.date_of(at).alias("day"),
        M.iso_date(at).alias("iso"),
    )


@query("C10_presence_flag", """
    SELECT p_partkey, regexp_matches(coalesce(p_name, ''), 'ring|gear|bolt')::INT::FLOAT AS presence FROM part""")
def c10(r: Roles) -> DataFrame:
    return r.table("part", "p_partkey", "p_name").select(
        "p_partkey", X.presence_flag("p_name", ["ring", "gear", "bolt"]).alias("presence")
    )


@query("C10_presence_words", f"""
    SELECT p_partkey, (list_has_any([{', '.join(f"'{w}'" for w in K.PRESENCE_KEYWORDS)}], [words[1 + p_partkey % 9]]))::INT::FLOAT AS presence
    FROM part, (SELECT [{', '.join(f"'{w}'" for w in K.PRESENCE_KEYWORDS)}, '発売'] AS words)""")
def c10_words(r: Roles) -> DataFrame:
    """The published words, each inside a longer title, and one that is none."""
    words = F.array(*[F.lit(w) for w in (*K.PRESENCE_KEYWORDS, "発売")])
    title = F.concat("p_name", F.lit("の"), F.element_at(words, (1 + F.col("p_partkey") % 9).cast("int")), F.lit("!"))
    return r.table("part", "p_partkey", "p_name").select("p_partkey", X.presence_flag(title).alias("presence"))


@query("C11_bare_name", """
    SELECT s_suppkey, trim(replace('株式会社 ' || s_name || ' 有限会社', '株式会社', '').replace('有限会社', '')) AS bare FROM supplier""")
def c11(r: Roles) -> DataFrame:
    name = F.concat(F.lit("株式会社 "), "s_name", F.lit(" 有限会社"))
    return r.table("supplier", "s_suppkey", "s_name").select("s_suppkey", X.bare_name(name).alias("bare"))


@query("C12_short_place", """
    SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN n_name WHEN 1 THEN n_name || '道' WHEN 2 THEN n_name ELSE n_name END AS short
    FROM nation""")
def c12(r: Roles) -> DataFrame:
    region = F.col("n_regionkey")
    ending = F.when(region == 0, "県").when(region == 1, "道").when(region == 2, "府").otherwise("都")
    return r.table("nation").select("n_nationkey", X.short_place(F.concat("n_name", ending)).alias("short"))


@query("C13_log_scores", """
    SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity) / ln(1 + (SELECT max(l_quantity) FROM lineitem)), 9) AS log_score,
           round(ln(1000.0 / greatest(l_quantity, 1)), 9) AS rarity FROM lineitem""")
def c13(r: Roles) -> DataFrame:
    lines = r.table("lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    top = lines.agg(F.max("l_quantity")).scalar()
    scored = lines.select(
        "l_orderkey", "l_linenumber", S.log_score("l_quantity", top).alias("log_score"),
        S.rarity(F.lit(1000.0), "l_quantity").alias("rarity"),
    )
    return rounded(scored, "log_score", "rarity", digits=9)


@query("C14_match_bonus", """
    SELECT release_id, 0.04::DOUBLE * coalesce((place = 3)::INT, 0) AS bonus,
           0.04::DOUBLE * (place IS NOT DISTINCT FROM NULL)::INT AS null_bonus FROM release""", "release")
def c14(r: Roles) -> DataFrame:
    missing = F.lit(None).cast("int")
    return r.release().select(
        "release_id", S.match_bonus("place", F.lit(3), K.SAME_PLACE_BONUS).alias("bonus"),
        S.match_bonus("place", missing, K.SAME_PLACE_BONUS, null_matches_null=True).alias("null_bonus"),
    )


@query("C15_l2_normalize", """
    SELECT vec_id, i::INTEGER AS i, round((embedding[i + 1]::DOUBLE * 3) / sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 3) * (x::DOUBLE * 3)))), 6) AS x
    FROM embeddings, (SELECT unnest(range(64)) AS i)""")
def c15(r: Roles) -> DataFrame:
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = r.table("embeddings", "vec_id", "embedding").select("vec_id", F.posexplode(A.l2_normalize(tripled)).alias("i", "x"))
    return rounded(unit, "x")


@query("C16_dot", """
    SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS self_dot,
           round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 6) AS mirror_dot FROM embeddings""")
def c16(r: Roles) -> DataFrame:
    dots = r.table("embeddings", "vec_id", "embedding").select(
        "vec_id", A.dot("embedding", "embedding").alias("self_dot"), A.dot("embedding", F.reverse("embedding")).alias("mirror_dot")
    )
    return rounded(dots, "self_dot", "mirror_dot")


@query("C17_clean_refs", """
    SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(
               [l_linenumber, l_linenumber + 2, 0, l_linenumber, 1], lambda n: n BETWEEN 1 AND 4), lambda n: n - 1))), ',') AS refs
    FROM lineitem""")
def c17(r: Roles) -> DataFrame:
    n = F.col("l_linenumber")
    cited = r.table("lineitem", "l_orderkey", "l_linenumber", "l_partkey").withColumn("cited", F.array(n, n + 2, F.lit(0), n, F.lit(1)))
    refs = joined(A.clean_refs("cited", 4).cast("array<string>"))
    return cited.select("l_orderkey", "l_linenumber", "l_partkey", refs.alias("refs"))


@query("C18_parse_draft", """
    SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS title,
           CASE WHEN event_type = 'view' THEN 'hall' END AS place FROM events""")
def c18(r: Roles) -> DataFrame:
    kind = F.col("event_type")
    stored = (
        F.when(kind == "view", F.concat(F.lit('{"title":"'), kind, F.lit('","place":"hall","partner":["a"]}')))
        .when(kind == "click", F.concat(F.lit('{"title":"'), kind, F.lit('"}')))
        .when(kind == "error", F.lit("{broken"))
    )
    drafts = r.table("events", "event_id", "event_type").select("event_id", D.parse_draft(stored).alias("draft"))
    return drafts.select("event_id", "draft.title", "draft.place")


MERGED_SQL = """merged AS (
    SELECT * REPLACE (coalesce(place, nullif(fill_place, '')) AS place,
                      CASE WHEN len(partner) > 0 THEN partner ELSE fill_partner END AS partner,
                      coalesce(novelty, fill_novelty) AS novelty) FROM drafts)"""

OPEN_SQL = """list_filter([CASE WHEN place IS NULL THEN 'place' END, CASE WHEN len(partner) = 0 THEN 'partner' END,
    CASE WHEN people IS NULL THEN 'people' END, CASE WHEN novelty IS NULL THEN 'novelty' END,
    CASE WHEN observation IS NULL THEN 'observation' END, CASE WHEN video IS NULL THEN 'video' END], lambda c: c IS NOT NULL)"""


@query("C19_merge_fill", f"""
    WITH {MERGED_SQL} SELECT draft_id, place, array_to_string(partner, ',') AS partner, people, novelty, observation FROM merged""",
    "drafts")
def c19(r: Roles) -> DataFrame:
    merged = D.merge_fill(r.drafts())
    return merged.select("draft_id", "place", joined("partner").alias("partner"), "people", "novelty", "observation")


@query("C20_open_fields", f"""
    SELECT draft_id, array_to_string({OPEN_SQL}, ',') AS open_codes,
           list_filter({OPEN_SQL}, lambda c: NOT list_contains(skipped, c))[1] AS next_code FROM drafts""", "drafts")
def c20(r: Roles) -> DataFrame:
    return r.drafts().select("draft_id", joined(D.open_fields()).alias("open_codes"), D.next_open().alias("next_code"))


@query("C21_field_states", f"""
    WITH codes AS (SELECT unnest(['place', 'partner', 'people', 'novelty', 'observation', 'video']) AS code, unnest(range(6)) AS position)
    SELECT draft_id, position::INTEGER AS position, code, NOT list_contains({OPEN_SQL}, code) AS filled,
           list_contains(d.skipped, code) AS skipped, CASE WHEN code = 'place' THEN 'causal' ELSE 'functional' END AS tone
    FROM drafts d, codes""", "drafts")
def c21(r: Roles) -> DataFrame:
    return D.field_states(r.drafts(), ["draft_id"])


@query("C22_settle_form", f"""
    WITH {MERGED_SQL},
    opened AS (SELECT *, {OPEN_SQL} AS open_codes FROM merged),
    again AS (SELECT *, CASE WHEN list_contains(fill_written, 'place') AND list_contains(open_codes, 'place')
                              AND NOT list_contains(retried, 'place') AND NOT list_contains(fill_unavailable, 'place')
                             THEN ['place'] ELSE []::VARCHAR[] END AS vague FROM opened)
    SELECT draft_id, array_to_string(list_sort(list_filter(open_codes, lambda c: NOT list_contains(vague, c))), ',') AS skipped,
           array_to_string(list_sort(list_distinct(list_concat(retried, vague))), ',') AS retried FROM again""", "drafts")
def c22(r: Roles) -> DataFrame:
    settled = D.settle_form(r.drafts())
    return settled.select("draft_id", joined("skipped").alias("skipped"), joined("retried").alias("retried"))


@query("C22_settle_reply", f"""
    WITH {MERGED_SQL},
    opened AS (SELECT *, {OPEN_SQL} AS open_codes FROM merged),
    gone AS (SELECT *, list_distinct(list_concat(skipped, list_filter(fill_unavailable, lambda c: list_contains(open_codes, c)))) AS s FROM opened),
    judged AS (SELECT *, list_contains(open_codes, asked) AND NOT list_contains(s, asked) AS unread FROM gone),
    told AS (SELECT *, unread AND asked = 'place' AND NOT list_contains(retried, 'place') AS again FROM judged)
    SELECT draft_id, array_to_string(list_sort(CASE WHEN unread AND NOT again THEN list_distinct(list_append(s, asked)) ELSE s END), ',') AS skipped,
           array_to_string(list_sort(CASE WHEN again THEN list_append(retried, asked) ELSE retried END), ',') AS retried
    FROM told""", "drafts")
def c22_reply(r: Roles) -> DataFrame:
    settled = D.settle_reply(r.drafts())
    return settled.select("draft_id", joined("skipped").alias("skipped"), joined("retried").alias("retried"))


@query("C23_draft_from_row", """
    SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN n_name ELSE r_name END AS place,
           'novelty,observation,partner,people,video' AS skipped
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def c23(r: Roles) -> DataFrame:
    rows = (
        r.table("customer", "c_custkey", "c_nationkey", "c_acctbal")
        .join(r.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("n_name")).alias("city_name"), F.col("r_name").alias("prefecture_name"))
    )
    rebuilt = D.draft_from_row(rows, keep_place=True)
    return rebuilt.select("c_custkey", "place", joined(F.array_sort("skipped")).alias("skipped"))


@query("O8_open_first", f"""
    SELECT draft_id, position::INTEGER AS position, code,
           row_number() OVER (PARTITION BY draft_id ORDER BY list_contains({OPEN_SQL}, code) DESC, position)::INTEGER AS shown
    FROM drafts, (SELECT unnest(['place', 'partner', 'people', 'novelty', 'observation', 'video']) AS code, unnest(range(6)) AS position)""",
    "drafts")
def o8(r: Roles) -> DataFrame:
    from pyspark.sql import Window

    items = r.drafts().withColumn("open_codes", D.open_fields()).select(
        "draft_id", "open_codes", F.posexplode(F.array(*[F.lit(c) for c in K.FIELD_ORDER])).alias("position", "code")
    )
    # six items per draft
    order = Window.partitionBy("draft_id").orderBy(*D.open_first("code", "position", "open_codes"))
    return items.select("draft_id", "position", "code", F.row_number().over(order).alias("shown"))


@query("F8_clip01", "SELECT event_id, least(greatest(value / 50 - 0.2, 0), 1)::DOUBLE AS clipped FROM events")
def f8(r: Roles) -> DataFrame:
    return r.table("events", "event_id", "value").select("event_id", S.clip01(F.col("value") / 50 - 0.2).alias("clipped"))


@query("F9_fill_category", "SELECT release_id, coalesce(place, 0) AS place FROM release", "release")
def f9(r: Roles) -> DataFrame:
    return r.release().select("release_id", S.fill_category("place").alias("place"))


@query("F10_fit_columns", "SELECT doc_id, left(text, 255) AS title, left(text, 500) AS description FROM documents")
def f10(r: Roles) -> DataFrame:
    docs = r.table("documents", "doc_id", "text").select("doc_id", F.col("text").alias("title"), F.col("text").alias("description"))
    return X.fit_columns(docs, {"title": K.TITLE_CHARS, "description": K.DESCRIPTION_CHARS})
