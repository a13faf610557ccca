"""Event views, upsert rules, re-scoring and the stream form."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from newsreach.operators import events as E
from newsreach.sources.workspace import materialize
from newsreach.streaming.calendar_sync import apply_batch, create_state, read_state, rescore_state, sync_stream

SCHEMA = ("id string, user_id string, external_id string, title string, description string, location string, "
          "starts_at timestamp_ntz, ends_at timestamp_ntz, all_day boolean, created_at timestamp_ntz, score double, draft string, scored_text string")
BATCH = ("id string, user_id string, external_id string, title string, description string, location string, "
         "starts_at timestamp_ntz, ends_at timestamp_ntz, all_day boolean, created_at timestamp_ntz, seq long")
T0, T1 = datetime(2026, 8, 1), datetime(2026, 8, 2)


def stored(spark, *rows):
    return spark.createDataFrame([(i, "u", x, t, "", loc, T0, T1, False, T0, s, "d", None) for i, x, t, loc, s in rows], SCHEMA)


def batch(spark, *rows):
    return spark.createDataFrame([(i, "u", x, t, "", loc, T1, T1, True, T1, n) for n, (i, x, t, loc) in enumerate(rows)], BATCH)


def by_key(df):
    return {(r.external_id, r.id): r for r in df.collect()}


def test_upsert_rules(spark):
    target = stored(spark, ("1", "a", "old", "hall", 0.5), ("2", "b", "old", "", None), ("3", None, "own", "home", 0.1))
    rows = by_key(E.upsert_events(target, batch(spark, ("9", "a", "new", ""), ("8", "c", "in", ""), ("7", "b", "n", "x"), ("6", None, "loose", ""))))
    assert len(rows) == 5
    a = rows["a", "1"]
    assert (a.title, a.location, a.score, a.draft, a.created_at, a.starts_at, a.all_day) == ("new", "hall", 0.5, "d", T0, T1, True)
    assert rows["b", "2"].location == "x"
    assert rows["c", "8"].score is None and rows["c", "8"].location == ""
    assert (None, "3") in rows and (None, "6") in rows


def test_two_rows_of_one_key_count_as_applied_one_by_one(spark):
    rows = by_key(E.upsert_events(stored(spark, ("1", "a", "old", "", 0.5)), batch(spark, ("5", "a", "first", "stage"), ("6", "a", "last", ""))))
    assert (rows["a", "1"].title, rows["a", "1"].location) == ("last", "stage")
    fresh = by_key(E.upsert_events(stored(spark), batch(spark, ("5", "n", "first", "stage"), ("6", "n", "last", ""))))
    assert (fresh["n", "5"].title, fresh["n", "5"].location) == ("last", "stage")


def test_upsert_twice_is_upsert_once(spark):
    target, new = stored(spark, ("1", "a", "old", "h", 0.5)), batch(spark, ("9", "a", "new", ""), ("8", "c", "in", "y"))
    once = E.upsert_events(target, new)
    twice = E.upsert_events(once, new)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_interval_is_closed_and_sorted(spark):
    rows = spark.createDataFrame([(1, "u", datetime(2026, 8, 3), datetime(2026, 8, 4)), (2, "u", datetime(2026, 8, 1), datetime(2026, 8, 2)),
                                  (3, "v", datetime(2026, 8, 2), datetime(2026, 8, 9)), (4, "u", datetime(2026, 8, 5), datetime(2026, 8, 6))],
                                 "id int, user_id string, starts_at timestamp_ntz, ends_at timestamp_ntz")
    assert [r.id for r in E.events_between(rows, datetime(2026, 8, 2), datetime(2026, 8, 3)).collect()] == [2, 3, 1]
    assert [r.id for r in E.events_between(rows, user="v").collect()] == [3]


def test_ranked_month_puts_unscored_last(spark):
    rows = [(1, datetime(2026, 8, 9), None), (2, datetime(2026, 8, 8), 0.5), (3, datetime(2026, 8, 7), 0.5), (4, datetime(2026, 8, 6), 0.9),
            (5, datetime(2026, 9, 1), 1.0), (6, datetime(2026, 8, 1), None)]
    df = spark.createDataFrame(rows, "id int, starts_at timestamp_ntz, score double")
    assert [r.id for r in E.ranked_month(df, "2026-08").collect()] == [4, 3, 2, 6, 1]
    assert E.in_month(df, "2026-12").count() == 0


def test_grid_starts_on_sunday(spark):
    months = spark.createDataFrame([(date(2026, 8, 1),), (date(2026, 2, 1),)], "m date")
    days = {}
    for r in E.calendar_grid(months, "m").orderBy("m", "day").collect():
        days.setdefault(r.m, []).append(r)
    assert days[date(2026, 8, 1)][0].day == date(2026, 7, 26)
    assert days[date(2026, 2, 1)][0].day == date(2026, 2, 1)
    assert all(len(d) == 42 for d in days.values())
    assert sum(r.in_month for r in days[date(2026, 2, 1)]) == 28


def test_clean_and_typed_rows(spark):
    raw = spark.createDataFrame(
        [("a", None, None, None, None, "2026-08-14", None, "2026-08-15"), ("b", "t" * 300, "d", "l", "2026-08-14T10:00:00+00:00", None, "2026-08-14T11:00:00+00:00", None),
         (None, "x", "", "", "2026-08-14", None, "2026-08-14", None), ("c", "x", "", "", None, None, None, "2026-08-14")],
        "id string, summary string, description string, location string, start_datetime string, start_date string, end_datetime string, end_date string")
    rows = {r.external_id: r for r in E.event_rows(E.clean_events(raw)).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"].title == "(タイトルなし)" and rows["a"].all_day and rows["a"].location == ""
    assert len(rows["b"].title) == 255 and not rows["b"].all_day


def test_drafted_place_fills_only_an_empty_location(spark):
    target = stored(spark, ("1", "a", "t", "", None), ("2", "b", "t", "hall", None), ("3", "c", "t", "", None))
    drafts = spark.createDataFrame([("1", "{}", "x" * 300), ("2", "{}", "new")], "id string, draft string, draft_place string")
    rows = {r.id: r for r in E.attach_draft(target, drafts).collect()}
    assert (len(rows["1"].location), rows["2"].location, rows["3"].location) == (255, "hall", "")
    assert (rows["1"].draft, rows["3"].draft) == ("{}", "d")


def test_versions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    assert {r.k: r.change for r in E.diff_versions(old, new, ["k"]).collect()} == {1: "gone", 2: "changed", 4: "new"}


def test_only_ranges_that_differ_are_joined(spark):
    old = spark.range(5000).selectExpr("id as k", "id % 7 as v")
    new = old.withColumn("v", F.when(F.col("k") == 1234, 99).otherwise(F.col("v")))
    keyed = [df.select(F.xxhash64("k").alias("__key"), F.xxhash64("v").alias("__digest")) for df in (old, new)]
    assert E.differing_ranges(*keyed, 4096).count() == 1 and E.differing_ranges(keyed[0], keyed[0], 4096).count() == 0
    assert [tuple(r) for r in E.diff_versions(old, new, ["k"]).collect()] == [(1234, "changed")]
    assert E.diff_versions(old, old, ["k"]).count() == 0 and E.diff_versions(old.limit(0), new, ["k"], 3).count() == 5000
    twice = old.union(old.where("k = 3"))
    assert E.diff_versions(old, twice, ["k"]).count() == 0


def test_listing_goes_by_the_shown_text(spark):
    rows = [(1, datetime(2026, 8, 1, 9), False), (2, datetime(2026, 8, 1, 0), True), (3, datetime(2026, 8, 1, 1), False), (4, datetime(2026, 7, 31, 16), True)]
    df = spark.createDataFrame(rows, "id int, starts_at timestamp, all_day boolean")
    got = {r.id: (r.start_text, r.position) for r in E.listing_order(df).collect()}
    assert got[2] == ("2026-08-01", 1) and got[4] == ("2026-08-01", 2) and got[3][1] == 3 and got[1] == ("2026-08-01T09:00:00+00:00", 4)


CORPUS = "k long, embedding array<float>, category int, place int, pv_score double"


def test_only_stale_events_are_scored_and_failures_stay_stale(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], 1, 1, 0.2), (2, [0.0, 1.0], 1, 1, 0.8)], CORPUS)
    events = stored(spark, ("1", "a", "left", "", 0.5), ("2", "b", "right", "", 0.5), ("3", "c", "kept", "", 0.7), ("4", "d", "fails", "", 0.9))
    events = events.withColumn("scored_text", F.when(F.col("title") == "kept", "kept"))

    def embed(changed):
        assert "new_text" in changed.columns
        vector = F.when(F.col("new_text") == "left", F.array(F.lit(1.0), F.lit(0.0))).when(F.col("new_text") == "right", F.array(F.lit(0.0), F.lit(1.0)))
        return changed.withColumn("embedding", vector.cast("array<float>"))

    rows = {r.id: r for r in E.rescore_stale(events, corpus, ["k"], embed, k=1).collect()}
    assert {i: r.score for i, r in rows.items()} == {"1": 0.2, "2": 0.8, "3": 0.7, "4": 0.9}
    assert rows["4"].scored_text is None and rows["1"].scored_text == "left"


def test_the_place_of_an_event_counts(spark):
    corpus = spark.createDataFrame([(1, [1.0], 1, 13, 0.2), (2, [1.0], 1, 27, 0.8)], CORPUS)
    places = spark.createDataFrame([("prefecture", "大阪府", 27)], "kind string, name string, prefecture_id int")
    events = stored(spark, ("1", "a", "t", "大阪", None))
    rows = E.rescore_stale(events, corpus, ["k"], lambda d: d.withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>")), places, k=1)
    assert rows.first().score == 0.8


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    target = stored(spark, *[(str(i), f"x{i}", "old", "", 0.5) for i in range(30)])
    new = batch(spark, *[(str(100 + i), f"x{i}", "new", "y" if i % 2 else "") for i in range(20, 45)])
    want = sorted(map(str, E.upsert_events(target, new).collect()))
    state, inbox = str(tmp_path / "state"), str(tmp_path / "inbox")
    create_state(target, state, buckets=8)
    new.write.parquet(inbox)
    stream = spark.readStream.schema(new.schema).parquet(inbox)
    sync_stream(stream, state, str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(str, read_state(spark, state).select(*target.columns).collect())) == want
    apply_batch(state, new)
    assert sorted(map(str, read_state(spark, state).select(*target.columns).collect())) == want


def test_stream_inserts_rows_without_external_id_once(spark, tmp_path):
    target = stored(spark, ("1", "a", "old", "", 0.5), ("2", None, "own", "", 0.1))
    new = batch(spark, ("7", "a", "new", ""), ("8", None, "loose", ""), ("9", None, "loose", ""))
    want = sorted(map(str, E.upsert_events(target, new).collect()))
    state = str(tmp_path / "state")
    create_state(target, state, buckets=4)
    for _ in range(2):
        apply_batch(state, new)
        assert sorted(map(str, read_state(spark, state).select(*target.columns).collect())) == want


def test_rescored_state(spark, tmp_path):
    state = str(tmp_path / "state")
    create_state(stored(spark, ("1", "a", "t", "", None), ("2", "b", "t", "", None)), state, buckets=4)
    corpus = spark.createDataFrame([(1, [1.0], 1, 1, 0.25)], CORPUS)
    rescore_state(spark, state, corpus, ["k"], lambda d: d.withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>")))
    assert sorted((r.id, r.score, r.scored_text) for r in read_state(spark, state).collect()) == [("1", 0.25, "t"), ("2", 0.25, "t")]


def files_below(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_log_equals_batch_upserts_and_rewrites_no_file(spark, tmp_path):
    """Random batches with repeated, missing and loose keys, folded from the log, against the upsert applied batch by batch."""
    import random

    rng = random.Random(3)
    target = stored(spark, *[(str(i), f"x{i}", "old", rng.choice(["", "hall"]), 0.5) for i in range(2000)], ("a", None, "own", "", 0.1))
    state = str(tmp_path / "state")
    create_state(target, state, buckets=4)
    want = target
    for number in range(4):
        new = batch(spark, *[(f"{number}-{i}", rng.choice([None, f"x{rng.randrange(2200)}"]), f"t{number}", rng.choice(["", f"l{number}"])) for i in range(30)])
        want = materialize(E.upsert_events(want, new), "wanted")
        before = files_below(tmp_path)
        assert apply_batch(state, new, source="s", batch_id=number)
        assert not apply_batch(state, new, source="s", batch_id=number) and not apply_batch(state, new, source="s", batch_id=0)
        after = files_below(tmp_path)
        assert all(after.get(name) == at for name, at in before.items())
        assert sorted(map(str, read_state(spark, state).select(*target.columns).collect())) == sorted(map(str, want.collect()))


def test_merged_log_reads_the_same_and_keeps_scores(spark, tmp_path, monkeypatch):
    from newsreach.streaming import calendar_sync as C

    state = str(tmp_path / "state")
    create_state(stored(spark, *[(str(i), f"x{i}", "t", "", None) for i in range(400)]), state, buckets=2)
    corpus = spark.createDataFrame([(1, [1.0], 1, 1, 0.25)], CORPUS)
    embed = lambda d: d.withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>"))
    assert rescore_state(spark, state, corpus, ["k"], embed) == 400 and rescore_state(spark, state, corpus, ["k"], embed) == 0
    for i in range(3):
        apply_batch(state, batch(spark, ("n", f"x{i}", f"new{i}", ""), (f"m{i}", f"y{i}", "t", "z"), (None, None, "loose", "")), merge=False)
    assert rescore_state(spark, state, corpus, ["k"], embed) == 6
    rows = sorted(map(str, read_state(spark, state).collect()))
    assert len(rows) == 406
    version = C.commits.versions(spark, f"{state}/manifest")[-1]
    monkeypatch.setattr(C, "BASE_PART", 10.0)
    C.merge_segments(spark, state)
    assert sorted(map(str, read_state(spark, state).collect())) == rows
    assert len(C.commits.load(spark, f"{state}/manifest")[1]["segments"]) < 6
    monkeypatch.setattr(C, "BASE_PART", 0.0)
    C.merge_segments(spark, state)
    assert sorted(map(str, read_state(spark, state).collect())) == rows == sorted(map(str, read_state(spark, state, version).collect()))
    assert C.vacuum(spark, state) >= 5 and sorted(map(str, read_state(spark, state).collect())) == rows
    assert not apply_batch(state, batch(spark, ("n", "x0", "new0", ""), ("m0", "y0", "t", "z"), (None, None, "loose", "")))


def test_a_commit_number_is_taken_once(spark, tmp_path):
    from newsreach.sources import commits

    folder = str(tmp_path / "c")
    assert commits.load(spark, folder) == (0, {})
    assert commits.commit(spark, folder, 1, {"a": "ä"}) and not commits.commit(spark, folder, 1, {"a": 2})
    assert commits.commit(spark, folder, 2, {"a": 3}) and commits.load(spark, folder) == (2, {"a": 3})
    assert commits.load(spark, folder, 1) == (1, {"a": "ä"}) and commits.versions(spark, folder) == [1, 2]


def test_days_show_the_first_and_count_the_rest(spark):
    rows = [(i, datetime(2026, 8, 1, i)) for i in range(5)] + [(9, datetime(2026, 8, 2))]
    got = E.events_by_day(spark.createDataFrame(rows, "id int, starts_at timestamp_ntz"), 3).orderBy("id").collect()
    assert [(r.id, r.position, r.overflow) for r in got] == [(0, 1, 2), (1, 2, 2), (2, 3, 2), (9, 1, 0)]


def test_scalar_inputs_are_checked(spark):
    with pytest.raises(ValueError):
        E.in_month(spark.range(1).withColumn("starts_at", F.current_timestamp()), "August")


def test_events_of_one_vector_are_one_question(spark, monkeypatch):
    """Stale events that share vector and classes are searched once; several rows of one id keep their joint answer."""
    asked, plain = [], E.plan_score
    monkeypatch.setattr(E, "plan_score", lambda queries, *rest, **more: asked.append(queries.count()) or plain(queries, *rest, **more))
    rows = [(i, "t", "", f"d{i}", None, None) for i in range(50)]
    schema = "id int, title string, location string, description string, score double, scored_text string"
    corpus = spark.createDataFrame([(1, [1.0], None, None, 0.25)], "k int, embedding array<float>, category int, place int, pv_score double")

    def embed(changed):
        return changed.withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>"))

    found = E.rescore_stale(spark.createDataFrame(rows, schema), corpus, ["k"], embed, k=1).collect()
    assert asked == [1] and len(found) == 50 and {r.score for r in found} == {0.25}
