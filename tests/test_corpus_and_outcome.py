"""Selection, lookups, place resolution and regional lift on literal rows."""

import pytest
from pyspark.sql import functions as F

from newsreach.operators import corpus as C
from newsreach.operators import outcome as O
from newsreach.operators import rollup as R
from newsreach.operators.place import name_leaks, resolve_place

KEY = ["k"]


def test_primary_location_prefers_a_city_and_sorts_nulls_last(spark):
    rows = [(1, 5, None), (1, 9, 2), (1, 7, 3), (2, None, None), (2, 4, None), (3, None, 8), (3, 3, 8)]
    got = {r.k: (r.prefecture_id, r.city_id) for r in
           C.primary_location(spark.createDataFrame(rows, "k int, prefecture_id int, city_id int"), KEY).collect()}
    assert got == {1: (7, 3), 2: (4, None), 3: (3, 8)}


def test_null_strata_are_kept_and_ties_go_by_key(spark):
    rows = [(i, None, 1, 10) for i in range(4)] + [(10 + i, 1, None, i) for i in range(3)]
    top = C.stratified_top(spark.createDataFrame(rows, "k int, cat int, place int, reach int"), ["cat", "place"], "reach", KEY, 2)
    assert sorted(r.k for r in top.collect()) == [0, 1, 11, 12]


def test_rollup_ignores_own_and_null_outlets_and_repeats(spark):
    log = spark.createDataFrame([(1, "own", 1), (1, "a", 2), (1, "a", 3), (1, None, 9), (2, "own", 5)], "k int, outlet string, at int")
    got = {r.k: (r.clip_rows, r.outlets, r.reach, r.first_clip, r.last_clip) for r in
           R.clip_rollup(log, KEY, "outlet", "own", "at").collect()}
    assert got == {1: (4, 2, 1, 1, 9), 2: (1, 1, 0, 5, 5)}
    assert [(r.k, r.outlet) for r in R.outlet_set(log, KEY, "outlet", "own").collect()] == [(1, "a")]


def test_candidates(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2023-01-01', 3, 't'), (2, TIMESTAMP_NTZ'2022-12-31', 3, 't'),
        (3, TIMESTAMP_NTZ'2024-01-01', 0, 't'), (4, TIMESTAMP_NTZ'2024-01-01', 1, ''), (5, TIMESTAMP_NTZ'2024-01-01', 1, NULL)
        AS t(k, created_at, reach, title)""")
    assert [r.k for r in C.candidates(df).collect()] == [1]


PLACES = [("prefecture", "東京都", 13), ("prefecture", "京都府", 26), ("prefecture", "大阪府", 27), ("prefecture", "北海道", 1),
          ("prefecture", "熊本県", 43), ("city", "熊本市", 43), ("city", "文京区", 13), ("city", "中央区", 13), ("city", "中央区", 27),
          ("city", "堺市", 27), ("city", "府中市", 13), ("city", "府中市", 34)]


@pytest.mark.parametrize(
    ("text", "want"),
    [("東京都文京区", 13), ("文京区", 13), ("大阪で開催", 27), ("北海道", 1), ("北海", None), ("熊本市中央区", 43), ("堺市と中央区", 27),
     ("中央区", None), ("府中市", None), ("オンライン", None), ("", None), (None, None), ("京都府と東京都", 13), ("京都タワー", 26)],
)
def test_place_resolution(spark, text, want):
    places = spark.createDataFrame(PLACES, "kind string, name string, prefecture_id int")
    df = spark.createDataFrame([(1, text)], "id int, place string")
    assert resolve_place(df, "place", places).first().prefecture_id == want


def test_name_leaks_drop_the_legal_form_and_one_character_names(spark):
    cases = spark.createDataFrame([(1, "株式会社GF"), (1, "有限会社A"), (2, None)], "q int, company string")
    proposals = spark.createDataFrame([(1, 1, "GFと組む"), (1, 2, "Aを足す"), (2, 3, "GFと組む"), (1, 4, "GFとGF")], "q int, p int, text string")
    got = {r.q: (r.proposals, r.leaks) for r in name_leaks(proposals, cases, ["q"], ["p"], "text", "company").collect()}
    assert got == {1: (3, 2), 2: (1, 0)}


@pytest.fixture(scope="module")
def small(spark):
    base = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, None)], "k int, place int")
    media = spark.createDataFrame([(1, "local"), (2, "local"), (1, "all"), (2, "all"), (3, "all"), (4, "all"), (5, "all"), (6, "local")], "k int, outlet string")
    return base, media


def test_lift_and_regional_reach(small):
    base, media = small
    got = {(r.place, r.outlet): r.lift for r in O.lift(base, media, KEY, "place", "outlet").collect()}
    assert got[(1, "local")] == pytest.approx((2 / 2) / (2 / 5))
    assert got[(1, "all")] == pytest.approx(1.0)
    reach = {r.k: r.regional_reach for r in O.regional_reach(base, media, KEY, "place", "outlet", 2).collect()}
    assert reach == {1: 1, 2: 1}


def test_lift_weighted_by_place_is_one(small):
    base, media = small
    shares = {1: 2 / 5, 2: 3 / 5}
    total = {}
    for r in O.lift(base, media, KEY, "place", "outlet").collect():
        total[r.outlet] = total.get(r.outlet, 0) + shares[r.place] * r.lift
    assert all(v == pytest.approx(1.0) for v in total.values())


def test_enrich_keeps_every_base_row(spark, small):
    base, media = small
    dated = base.withColumn("created_at", F.expr("TIMESTAMP_NTZ'2024-01-01'"))
    text = spark.createDataFrame([(1, "s", "b")], "k int, subtitle string, body_head string")
    stat = spark.createDataFrame([(1, 10), (2, 5)], "k int, page_view int")
    rows = {r.k: r for r in O.enrich(dated, text, stat, media, KEY, "place", "outlet", lift_min=2).collect()}
    assert len(rows) == 6
    assert (rows[1].body_head, rows[2].body_head, rows[3].page_view) == ("b", "", 0)
    assert rows[1].pv_score == 1.0 and rows[6].regional_score == 0.5
    weights = {r.place: r.regional_weight for r in O.place_weight(spark.createDataFrame([(1, 2), (1, 0), (None, 3)], "place int, g int"), "place", "g").collect()}
    assert weights == {1: 0.5}


def test_checks_raise(spark):
    twice = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError, match="not unique"):
        R.assert_unique(twice, KEY)
    once = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(ValueError, match="differ"):
        R.assert_same_count(twice, once, KEY)
    assert R.assert_same_count(once, once, KEY) is once


def test_names_are_found_by_their_rarest_pair(spark):
    """All contained names against Python's ``in``; one-character names, long texts, line breaks, NULL and empty texts."""
    import random

    from newsreach.operators.place import names_in_text

    rng = random.Random(4)
    letters = "abcd東京\n\U0001f600"
    names = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(60)})
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(80)] + [None, "", "a", texts_of(rng, letters)]
    found = names_in_text(
        spark.createDataFrame([(t,) for t in texts], "t string"), "t",
        spark.createDataFrame([(n, i) for i, n in enumerate([*names, "", None])], "n string, i int"), "n",
    )
    want = {(t, n) for t in texts if t for n in names if n in t}
    assert sorted((r.t, r.n) for r in found.collect()) == sorted(want) and len(want) > 100


def texts_of(rng, letters):
    return "".join(rng.choice("xyz") for _ in range(100_000)) + "".join(rng.choice(letters) for _ in range(50))


def test_a_long_text_costs_its_pairs(spark):
    from newsreach.operators.place import _grams

    text = "".join(chr(97 + i % 26) for i in range(100_000))
    row = spark.createDataFrame([(text,)], "t string").select(F.size(_grams(F.col("t"), False)).alias("n")).first()
    assert row.n == 26


def test_names_that_are_alike_meet_only_their_texts(spark):
    """Numbered names share all their character pairs; each text still meets few of them."""
    from newsreach.operators.place import _meetings, names_in_text

    names = spark.range(3000).select(F.format_string("Customer#%09d", "id").alias("n"), F.lit(1).alias("c"))
    texts = names.select(F.concat(F.lit("Follow "), "n", F.lit(" up")).alias("t"), "c")
    met = _meetings(texts.withColumn("__key", F.xxhash64("c", "t")), "t", names, "n", ["c"])
    assert 3000 <= met.count() <= 4 * 3000
    found = names_in_text(texts, "t", names, "n", ["c"])
    assert found.count() == 3000 and found.where("t <> concat('Follow ', n, ' up')").isEmpty()
