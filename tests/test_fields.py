"""Draft fields: order, completion, settling."""

import pytest
from pyspark.sql import functions as F

from newsreach import constants as K
from newsreach.functions import fields as D

EMPTY = {"title": "t", "place": None, "partner": [], "people": None, "novelty": None, "observation": None, "video": None,
         "skipped": [], "retried": []}
FILL = {f"fill_{c}": ([] if c == "partner" else None) for c in K.FIELD_ORDER} | {
    "fill_written": [], "fill_unavailable": [], "asked": "place"}
SCHEMA = ", ".join(
    f"{name} {'array<string>' if name in ('partner', 'skipped', 'retried', 'fill_partner', 'fill_written', 'fill_unavailable') else 'string'}"
    for name in [*EMPTY, *FILL]
)


def draft(spark, **values):
    row = EMPTY | FILL | values
    return spark.createDataFrame([tuple(row.values())], SCHEMA)


def next_code(df):
    return df.select(D.next_open().alias("n")).first().n


def test_place_comes_first_then_the_next_open_field(spark):
    assert next_code(draft(spark)) == "place"
    assert next_code(draft(spark, place="熊本市中央区")) == "partner"
    assert next_code(draft(spark, skipped=["place"])) == "partner"
    assert next_code(draft(spark, skipped=list(K.FIELD_ORDER))) is None


@pytest.mark.parametrize("code", K.FIELD_ORDER)
def test_every_field_ends_when_skipped(spark, code):
    assert not draft(spark).select(D.is_done(code)).first()[0]
    assert draft(spark, skipped=[code]).select(D.is_done(code)).first()[0]


def test_empty_list_is_not_filled(spark):
    assert not draft(spark, partner=[]).select(D.has_value("partner")).first()[0]
    assert draft(spark, partner=["郵便局"]).select(D.has_value("partner")).first()[0]


def test_only_place_claims_causality(spark):
    states = D.field_states(draft(spark, place="x", skipped=["video"]), ["title"]).orderBy("position").collect()
    assert [s.code for s in states] == list(K.FIELD_ORDER)
    assert {s.code for s in states if s.tone == "causal"} == {"place"}
    assert [s.filled for s in states] == [True, False, False, False, False, False]
    assert states[-1].skipped


def settle(df):
    row = D.settle_form(df).first()
    return row


def test_merge_keeps_what_is_set_and_ignores_empties(spark):
    row = D.merge_fill(draft(spark, place="a", fill_place="b", fill_people="", fill_partner=["x"], fill_video="v")).first()
    assert (row.place, row.people, row.partner, row.video) == ("a", None, ["x"], "v")


def test_form_vague_place_is_asked_once_more(spark):
    row = settle(draft(spark, fill_written=["place"]))
    assert row.retried == ["place"]
    assert "place" not in row.skipped
    again = settle(draft(spark, fill_written=["place"], retried=["place"]))
    assert "place" in again.skipped


def test_form_unavailable_is_not_asked_again(spark):
    row = settle(draft(spark, fill_written=["place"], fill_unavailable=["place"]))
    assert "place" in row.skipped
    assert row.retried == []


def test_form_unavailable_does_not_erase_a_value(spark):
    row = settle(draft(spark, fill_place="熊本市", fill_written=["place"], fill_unavailable=["place"]))
    assert row.place == "熊本市"
    assert "place" not in row.skipped


def test_form_blank_skips_everything(spark):
    row = settle(draft(spark))
    assert row.skipped == sorted(K.FIELD_ORDER)
    assert row.retried == []


def test_reply_rules(spark):
    gone = D.settle_reply(draft(spark, fill_unavailable=["place"])).first()
    assert gone.skipped == ["place"] and gone.retried == []
    other = D.settle_reply(draft(spark, place="x", asked="partner", fill_partner=["郵便局"], fill_unavailable=["video"])).first()
    assert other.partner == ["郵便局"] and other.skipped == ["video"]
    vague = D.settle_reply(draft(spark)).first()
    assert vague.retried == ["place"] and vague.skipped == []
    given_up = D.settle_reply(draft(spark, retried=["place"])).first()
    assert given_up.skipped == ["place"] and given_up.retried == ["place"]
    people = D.settle_reply(draft(spark, place="x", asked="people")).first()
    assert people.skipped == ["people"]


def test_draft_from_row(spark):
    rows = spark.createDataFrame([("t", "市", "県"), ("t", None, "県"), ("t", None, None)], "title string, city_name string, prefecture_name string")
    kept = D.draft_from_row(rows, keep_place=True).collect()
    assert [r.place for r in kept] == ["市", "県", None]
    assert "place" not in kept[0].skipped and "place" in kept[2].skipped
    assert all(set(r.skipped) == set(K.FIELD_ORDER) for r in D.draft_from_row(rows).collect())


def test_stored_draft(spark):
    df = spark.createDataFrame([('{"title":"a","partner":["x"]}',), ("{broken",), (None,)], "d string")
    got = [r.p for r in df.select(D.parse_draft("d").alias("p")).collect()]
    assert got[0].partner == ["x"]
    assert got[1] is None and got[2] is None


def test_open_fields_are_shown_first_in_their_old_order(spark):
    items = spark.createDataFrame([(0, "people"), (1, "place"), (2, "video"), (3, None)], "p int, code string").withColumn(
        "open", F.array(F.lit("video"), F.lit("place")))
    assert [r.code for r in items.orderBy(*D.open_first("code", "p", "open")).collect()] == ["place", "video", "people", None]
