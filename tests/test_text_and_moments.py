"""Literal fixtures for text, date and array rules."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from newsreach import constants as K
from newsreach.functions import arrays as A
from newsreach.functions import moments as M
from newsreach.functions import scoring as S
from newsreach.functions import text as X


def one(spark, row, schema, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("a<b>b</b>&nbsp;&#160; c", "a b c"),
        ("<p>one<br/>two</p>", "one two"),
        ("<div><p><i>x</i></p></div>\n\n y", "x y"),
        (None, ""),
    ],
)
def test_html_steps_run_in_order(spark, html, want):
    assert one(spark, (html,), "h string", X.html_to_text("h"))[0] == want


def test_body_head_reads_and_keeps_a_limited_number_of_characters(spark):
    html = "<b>" + "あ" * 3000
    text = one(spark, (html,), "h string", X.html_to_text("h", K.BODY_RAW_CHARS, K.BODY_TEXT_CHARS))[0]
    assert text == "あ" * 1000
    whole = one(spark, (html,), "h string", X.html_to_text("h"))[0]
    assert len(whole) == 3000


def test_event_text_holds_the_place_and_drops_empties(spark):
    text = X.event_text("t", "l", "d")
    assert "熊本市中央区" in one(spark, ("直販を始めます", "熊本市中央区", "9月から"), "t string, l string, d string", text)[0]
    assert one(spark, ("直販を始めます", "", ""), "t string, l string, d string", text)[0] == "直販を始めます"
    assert one(spark, ("直販", None, None), "t string, l string, d string", text)[0] == "直販"


def test_long_description_is_cut_for_scoring(spark):
    text = one(spark, ("件名", "", "あ" * 600), "t string, l string, d string", X.event_text("t", "l", "d"))[0]
    assert len(text) == 2 + 1 + 500


def test_corpus_text_keeps_empty_lines_and_skips_absent_columns(spark):
    df = spark.createDataFrame([("a", None, "c")], "title string, body_head string, other string")
    assert df.select(X.present_text(df)).first()[0] == "a\n"


@pytest.mark.parametrize(("length", "want"), [(255, 255), (256, 255), (3, 3)])
def test_columns_are_cut_to_their_width(spark, length, want):
    df = spark.createDataFrame([("あ" * length, "い" * length)], "title string, location string")
    row = X.fit_columns(df, {"title": K.TITLE_CHARS, "location": K.LOCATION_CHARS}).first()
    assert len(row.title) == want
    assert len(row.location) == want


def test_query_text_skips_what_is_missing(spark):
    row = ("t", None, ["p", "", "q"], None, "o")
    schema = "title string, place string, partner array<string>, novelty string, observation string"
    text = X.query_text("title", "place", "partner", "novelty", "observation", F.lit("cat"), F.lit(None).cast("string"))
    assert one(spark, row, schema, text)[0] == "t cat p q o"


def test_presence_and_names(spark):
    assert one(spark, ("新店舗オープン",), "t string", X.presence_flag("t"))[0] == 1.0
    assert one(spark, ("定例会議",), "t string", X.presence_flag("t"))[0] == 0.0
    assert one(spark, (None,), "t string", X.presence_flag("t"))[0] == 0.0
    assert one(spark, ("株式会社GF　",), "n string", X.bare_name("n"))[0] == "GF"
    got = [r[0] for r in spark.createDataFrame([("東京都",), ("北海道",), ("京都",), ("大阪府",)], "n string").select(X.short_place("n")).collect()]
    assert got == ["東京", "北海道", "京都", "大阪"]


def test_text_flags_keep_null(spark):
    df = spark.createDataFrame([("abc",), ("",), (None,)], "lead string")
    rows = X.text_flags(df, ["lead"], ["lead"]).collect()
    assert [(r.lead_len, r.has_lead) for r in rows] == [(3, True), (0, False), (None, None)]


JST = timezone(timedelta(hours=9))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2026-08-14", datetime(2026, 8, 14, tzinfo=JST)),
        ("2026-08-14T10:00:00+00:00", datetime(2026, 8, 14, 10, tzinfo=timezone.utc)),
        ("2026-08-14T10:00:00Z", datetime(2026, 8, 14, 10, tzinfo=timezone.utc)),
        ("2026-08-14T10:00:00", datetime(2026, 8, 14, 10, tzinfo=JST)),
    ],
)
def test_moments_get_the_local_zone_only_when_they_have_none(spark, text, want):
    micros = one(spark, (text,), "m string", F.unix_micros(M.parse_moment("m")))[0]
    assert micros == int(want.timestamp() * 1_000_000)


def test_unreadable_moment_is_null(spark):
    assert one(spark, ("soon",), "m string", M.parse_moment("m"))[0] is None


def test_render_moment(spark):
    df = spark.createDataFrame([("2026-08-14",), ("2026-08-14T10:00:00.5+00:00",)], "m string")
    rows = df.select(M.render_moment(M.parse_moment("m"), M.is_all_day("m")).alias("x")).collect()
    assert [r.x for r in rows] == ["2026-08-14", "2026-08-14T10:00:00.500000+00:00"]


def test_zero_vector_has_similarity_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<float>, b array<float>")
    row = df.select(A.l2_normalize("a").alias("a"), A.l2_normalize("b").alias("b"), A.dot(A.l2_normalize("a"), "b").alias("d")).first()
    assert row.a == [0.0, 0.0]
    assert row.b == pytest.approx([0.6, 0.8])
    assert row.d == 0.0


def test_citations_are_cleaned(spark):
    assert one(spark, ([3, 1, 9, 3, 0],), "r array<int>", A.clean_refs("r", 4))[0] == [0, 2]


def test_null_bonus_conventions(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, None), (1, None)], "a int, b int")
    rows = df.select(S.match_bonus("a", "b", 0.04).alias("sql"), S.match_bonus("a", "b", 0.04, True).alias("filled")).collect()
    assert [r.sql for r in rows] == [0.04, 0.0, 0.0, 0.0]
    assert [r.filled for r in rows] == [0.04, 0.0, 0.04, 0.0]
