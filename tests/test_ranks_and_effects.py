"""Rank primitive, quantiles and paired cells against brute force, with ordinary and hot groups."""

import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsreach.operators import effects as E
from newsreach.operators import evaluate as V
from newsreach.operators import ranks as R


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows and many ties, NULL groups, small groups."""
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"g": ["big"] * 600 + ["a"] * 5 + ["b"] + [None] * 30})
    frame["v"] = np.round(np.where(rng.random(len(frame)) < 0.3, 0.0, rng.normal(0, 50, len(frame))), 1)
    frame["id"] = range(len(frame))
    return spark.createDataFrame(frame, "g string, v double, id long"), frame


@pytest.mark.parametrize("hot_rows", [0, 100, 10**6])
def test_midrank_equals_brute_force(skewed, hot_rows):
    df, frame = skewed
    got = {r.id: r.s for r in R.midrank(df, ["g"], "v", "s", hot_rows).collect()}
    assert len(got) == len(frame)
    for _, part in frame.groupby("g", dropna=False):
        n = len(part)
        for row in part.itertuples():
            low = (part.v < row.v).sum()
            cnt = (part.v == row.v).sum()
            want = ((low / (n - 1) if n > 1 else 0.0) + (low + cnt) / n) / 2
            assert got[row.id] == pytest.approx(want, abs=1e-12)


def test_midrank_rules(spark):
    df = spark.createDataFrame([("one", 3), ("tied", 1), ("tied", 1), ("mix", 1), ("mix", 1), ("mix", 2)], "g string, v int")
    got = R.midrank(df, ["g"], "v", "s").groupBy("g").agg(F.sort_array(F.collect_list("s")).alias("s")).collect()
    by_group = {r.g: r.s for r in got}
    assert by_group["one"] == [0.5]
    assert by_group["tied"] == [0.5, 0.5]
    assert by_group["mix"] == pytest.approx([1 / 3, 1 / 3, 1.0])


@pytest.mark.parametrize("hot_rows", [0, 100, 10**6])
def test_quantiles_equal_numpy(skewed, hot_rows):
    df, frame = skewed
    got = {r.g: r for r in R.quantiles(df, ["g"], "v", {"q1": 0.1, "q5": 0.5, "q9": 0.9}, hot_rows=hot_rows).collect()}
    for group, part in frame.groupby("g", dropna=False):
        row = got[None if pd.isna(group) else group]
        assert row.n == len(part)
        assert [row.q1, row.q5, row.q9] == pytest.approx(list(np.quantile(part.v, [0.1, 0.5, 0.9])), abs=1e-9)


@pytest.mark.parametrize("hot_rows", [0, 10**6])
def test_global_quantiles_with_weights(spark, hot_rows):
    df = spark.createDataFrame([(1.0, 3), (5.0, 1), (9.0, 2)], "v double, w int")
    row = R.quantiles(df, [], "v", {"m": 0.5}, "w", hot_rows=hot_rows).first()
    assert (row.n, row.m) == (6, statistics.median([1, 1, 1, 5, 9, 9]))


def test_average_rank_of_ties(spark):
    df = spark.createDataFrame([(10,), (20,), (20,), (30,), (None,)], "v int")
    got = {r.v: r.r for r in R.avg_rank(df, "v", "r").collect()}
    assert got == {10: 1.0, 20: 2.5, 30: 4.0, None: None}


def test_both_paths_give_the_same_rows_with_missing_values(spark):
    rows = [("a", 1.0), ("a", None), ("a", 1.0), ("a", 3.0), (None, 2.0), (None, None), ("b", None), ("c", float("nan")), ("c", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    one, other = (sorted(map(repr, R.midrank(df, ["g"], "v", "s", hot).collect())) for hot in (10**6, 0))
    assert one == other and len(one) == len(rows)
    assert sorted(map(repr, R.avg_rank(df, "v", "s", hot_rows=0).collect())) == sorted(map(repr, R.avg_rank(df, "v", "s").collect()))


def test_input_of_a_rank_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(500).selectExpr("id % 7 as g", "id * 37 % 101 as v").mapInPandas(count, "g long, v long")
    assert R.midrank(df, ["g"], "v", "s").count() == 500 and seen.value == 500


@pytest.mark.parametrize("kind", ["prefix", "octave", "moment"])
def test_bands_are_even_whatever_the_values(spark, kind):
    """Texts with one prefix, doubles of one octave and rows of one moment are split like any others."""
    value = {
        "prefix": F.concat(F.lit("the same long prefix of all "), F.lpad("id", 8, "0")),
        "octave": F.lit(1.0) + F.col("id") / F.lit(10**9),
        "moment": F.struct(F.lit("2024-01-01").cast("date").alias("at"), F.col("id").alias("tie")),
    }[kind]
    df = spark.range(40000).select(F.lit("one").alias("g"), value.alias("v"), "id").repartition(6)
    sizes = [r["count"] for r in R.banded(df, ["g"], "v", 40000).groupBy("__band").count().collect()]
    assert len(sizes) == R.LEAST_BANDS and max(sizes) <= 2 * 40000 / R.LEAST_BANDS
    table = R.rank_table(df, ["g"], "v", hot_rows=0)
    assert table.where("n <> 40000 or cnt <> 1").count() == 0
    assert df.join(table, "v").where("before <> id").count() == 0


def test_ordinals_of_one_day_are_split(spark):
    rows = spark.range(3000).select(F.lit("e").alias("e"), F.lit("2024-01-01").alias("at"), (F.col("id") * 7 % 3000).alias("tie"), F.col("id").cast("double").alias("y"))
    got = E.by_ordinal(rows, ["e"], "at", ["tie"], ["y"], hot_rows=0)
    want = E.by_ordinal(rows, ["e"], "at", ["tie"], ["y"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 3000


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"c": rng.integers(0, 12, 400), "f": rng.random(400) < 0.4})
    frame.loc[frame.c == 11, "f"] = True
    frame["y"] = np.round(rng.normal(10, 4, 400) + 2 * frame.f, 1)
    return spark.createDataFrame(frame, "c long, f boolean, y double"), frame


@pytest.mark.parametrize("hot_rows", [0, 40, 10**6])
def test_paired_effect_equals_brute_force(cells, hot_rows):
    df, frame = cells
    pairs = []
    for _, part in frame.groupby("c"):
        a, b = part[part.f].y, part[~part.f].y
        if len(a) >= 3 and len(b) >= 3:
            pairs.append((a.median(), b.median()))
    diff = [a - b for a, b in pairs]
    row = E.paired_effect(df, ["c"], "f", "y", hot_rows=hot_rows).first()
    assert row.cells == len(pairs)
    assert row.mean_difference == pytest.approx(np.mean(diff))
    assert row.median_difference == pytest.approx(np.median(diff))
    assert row.win_rate == pytest.approx(np.mean([d > 0 for d in diff]))
    assert row.median_ratio == pytest.approx(np.median([a / b for a, b in pairs if b]))


def test_ties_are_no_wins_and_zero_denominators_are_left_out(spark):
    rows = [("tie", f, 5.0) for f in (True, False) for _ in range(3)] + [("zero", True, 2.0)] * 3 + [("zero", False, 0.0)] * 3
    rows += [("small", True, 1.0), ("small", False, 1.0)]
    row = E.paired_effect(spark.createDataFrame(rows, "c string, f boolean, y double"), ["c"], "f", "y").first()
    assert (row.cells, row.win_rate, row.median_ratio) == (2, 0.5, 1.0)


def test_no_cell_gives_an_empty_summary(spark):
    row = E.paired_effect(spark.createDataFrame([("a", True, 1.0)], "c string, f boolean, y double"), ["c"], "f", "y").collect()
    assert not row or row[0].cells == 0


def test_one_vs_rest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"c": rng.integers(0, 6, 300), "p": rng.integers(0, 4, 300), "y": rng.integers(0, 20, 300).astype(float)})
    got = {r.p: r for r in E.one_vs_rest(spark.createDataFrame(frame), ["c"], "p", "y").collect()}
    for place in range(4):
        pairs = []
        for _, part in frame.groupby("c"):
            a, b = part[part.p == place].y, part[part.p != place].y
            if len(a) >= 3 and len(b) >= 3:
                pairs.append((a.median(), b.median()))
        assert got[place].cells == len(pairs)
        assert got[place].win_rate == pytest.approx(np.mean([a > b for a, b in pairs]))


def test_term_position(spark):
    df = spark.createDataFrame([("new year", 10.0), ("x", 5.0), ("new year", 1.0), (None, 0.0)], "t string, m double")
    row = E.term_position(df, "t", "new year", ["m"]).first()
    assert (row.rows, row.mean_position) == (2, pytest.approx((0 + 2 / 3) / 2))


@pytest.mark.parametrize("hot_rows", [0, 10**6])
def test_spearman_equals_pandas(spark, hot_rows):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"p": rng.integers(0, 9, 200).astype(float), "a": rng.normal(size=200)})
    want = frame.p.rank().corr(frame.a.rank())
    frame["g"] = "x"
    df = spark.createDataFrame(frame)
    assert V.spearman(df, "p", "a", hot_rows=hot_rows).first().spearman == pytest.approx(want)
    assert V.spearman(df, "p", "a", ["g"], hot_rows=hot_rows).first().spearman == pytest.approx(want)
    constant = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "p double, a double")
    assert V.spearman(constant, "p", "a").first().spearman is None


def test_ndcg_rules(spark):
    rows = [("perfect", 3.0, 3.0, 1), ("perfect", 2.0, 2.0, 2), ("zero", 1.0, 0.0, 1), ("zero", 2.0, 0.0, 2),
            ("tie", 1.0, 0.0, 1), ("tie", 1.0, 1.0, 2)]
    got = {r.g: r.ndcg for r in V.ndcg_per_group(spark.createDataFrame(rows, "g string, p double, a double, k int"), ["g"], "p", "a", ["k"]).collect()}
    assert got["perfect"] == pytest.approx(1.0)
    assert got["zero"] == 0.0
    assert got["tie"] == pytest.approx(1 / np.log2(3))
    none = V.grouped_ndcg(spark.createDataFrame([], "g string, p double, a double, k int"), ["g"], "p", "a", ["k"]).first()
    assert (none.groups, none.ndcg) == (0, 0.0)


def test_bootstrap_is_repeatable_and_brackets_the_gap(spark):
    rng = np.random.default_rng(4)
    actual = rng.normal(size=150)
    frame = pd.DataFrame({"k": range(150), "good": actual + rng.normal(0, 0.3, 150), "bad": rng.normal(size=150), "actual": actual})
    df = spark.createDataFrame(frame)
    first = V.bootstrap_gap(df, "good", "bad", "actual", ["k"], rounds=40).first()
    second = V.bootstrap_gap(df.repartition(3), "good", "bad", "actual", ["k"], rounds=40).first()
    point = frame.good.rank().corr(frame.actual.rank()) - frame.bad.rank().corr(frame.actual.rank())
    assert (first.low, first.high) == pytest.approx((second.low, second.high))
    assert first.rounds == 40
    assert 0 < first.low < point < first.high


def test_bootstrap_by_blocks_equals_ranking_every_round(spark):
    """Ties, missing and repeated rows; the block form against rows expanded by round."""
    rng = np.random.default_rng(6)
    rows = [(int(i), *[None if rng.random() < 0.1 else float(rng.integers(0, 6)) for _ in range(3)]) for i in range(120)]
    rows += rows[:10] + [(None, 1.0, 2.0, 3.0), (900, float("nan"), 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k long, good double, bad double, actual double")
    one = V.bootstrap_gap(df, "good", "bad", "actual", ["k"], rounds=230).first()
    other = V.bootstrap_gap(df, "good", "bad", "actual", ["k"], rounds=230, hot_rows=0).first()
    assert tuple(one) == pytest.approx(tuple(other), abs=1e-12) and one.rounds == 230
    flat = df.withColumn("good", F.lit(1.0))
    assert tuple(V.bootstrap_gap(flat, "good", "bad", "actual", ["k"], rounds=5).first()) == (0, None, None)
    assert V.bootstrap_gap(df.limit(0), "good", "bad", "actual", ["k"], rounds=5).count() in (0, 1)


@pytest.mark.parametrize("hot_rows", [0, 10**6])
def test_complement_medians_equal_brute_force(spark, hot_rows):
    """NULL cells, a group that is most of its cell, few distinct outcomes, groups too small to count."""
    rng = np.random.default_rng(8)
    rows = []
    for c in ("a", "b", None, "d"):
        for _ in range(150):
            g = "big" if rng.random() < 0.7 else rng.choice(["x", "y", "z"])
            rows.append((c, str(g), float(rng.integers(0, 4 if c == "b" else 60))))
    rows += [("e", "x", 1.0)] * 9 + [("f", "x", 1.0)] * 3 + [("f", "y", 5.0)] * 3
    frame = pd.DataFrame(rows, columns=["c", "p", "y"])
    df = spark.createDataFrame(rows, "c string, p string, y double")
    got = {r.p: r for r in E.one_vs_rest(df, ["c"], "p", "y", hot_rows=hot_rows).collect()}
    for place in ("big", "x", "y", "z"):
        pairs = []
        for _, part in frame.groupby("c", dropna=False):
            a, b = part[part.p == place].y, part[part.p != place].y
            if len(a) >= 3 and len(b) >= 3:
                pairs.append((a.median(), b.median()))
        r = got[place]
        assert r.cells == len(pairs) and r.mean_difference == pytest.approx(np.mean([a - b for a, b in pairs]))
        assert r.median_ratio == pytest.approx(np.median([a / b for a, b in pairs if b]))


def test_complement_medians_build_no_rows_of_groups_times_outcomes(spark):
    """40 groups of one cell with 400 outcomes each: what is ranked stays in the order of the rows."""
    df = spark.range(16000).selectExpr("'one' as c", "id % 40 as g", "cast((id * 7919) % 16001 as double) as y")
    cells = df.groupBy("c", "g", F.col("y").alias("__value")).agg(F.count("*").alias("__c"))
    found = E.against_rest(cells, cells, ["c"], "g")
    assert found.count() == 40
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("hot_rows", [0, 1_000_000])
def test_null_values_have_no_rank_and_no_ordinal_at_any_size(spark, hot_rows):
    from newsreach.operators import effects as E

    df = spark.createDataFrame([(1, 1.0), (1, None), (1, 3.0), (1, 2.0)], "g int, v double")
    got = {r.v: r.s for r in R.midrank(df, ["g"], "v", "s", hot_rows).collect()}
    assert got[None] is None and round(got[1.0], 6) == round(1 / 6, 6) and got[3.0] == 1.0 and len(got) == 4
    rows = spark.createDataFrame([(1, None, 1, 5.0), (1, 10, 2, 7.0), (1, 20, 3, 9.0)], "e int, at int, k int, o double")
    found = {r.ordinal: r["median"] for r in E.by_ordinal(rows, ["e"], "at", ["k"], ["o"], hot_rows).collect()}
    assert found == {1: 7.0, 2: 9.0}


def test_small_wrong_answers_stay_right(spark):
    from newsreach.functions import fields, scoring, text
    from newsreach.operators import effects as E
    from newsreach.operators import events

    old = spark.createDataFrame([(1, None, "a"), (None, "x", "y")], "k int, p string, q string")
    new = spark.createDataFrame([(1, "a", None), (None, "x", "y")], "k int, p string, q string")
    assert [(r.k, r.change) for r in events.diff_versions(old, new, ["k"]).collect()] == [(1, "changed")]
    assert [(r.k, r.change) for r in events.diff_versions(old, old.withColumn("z", F.lit(1)), ["k"]).where("k = 1").collect()] == [(1, "changed")]
    one = spark.range(1)
    nothing, nan, high = one.select(scoring.clip01(F.lit(None).cast("double")), scoring.clip01(F.lit(float("nan"))), scoring.clip01(F.lit(2.0))).first()
    assert nothing is None and nan is None and high == 1.0
    assert one.select(text.bare_name(F.lit("X(株)Y"), ["(株)"])).first()[0] == "XY"
    drafts = spark.createDataFrame([('{"title":"x","partner":"nolist"}',), ('{"title":"x"}',)], "d string").select(fields.parse_draft("d").alias("p")).collect()
    assert drafts[0].p is None and drafts[1].p.title == "x"
    modes = {r.v: r.is_mode for r in E.value_histogram(spark.createDataFrame([(None,), (None,), (1,)], "v int"), "v").collect()}
    assert modes == {None: True, 1: False}


def test_positions_of_a_long_table_equal_ranks_and_travel_once(spark, monkeypatch):
    from newsreach.operators import ranks

    rows = [(i, (i * 7919) % 500 if i % 10 else 3) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, v long").withColumn("v", F.unhex(F.md5(F.col("v").cast("string"))))
    want = {r["id"]: (r["before"], r["n"]) for r in ranks.with_ranks(df, [], "v").collect()}
    stored = []
    monkeypatch.setattr(ranks, "materialize", lambda df, name, keep=ranks.materialize: stored.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    found = ranks.positions(df, "v", "at", hot_rows=0).collect()
    assert {r["id"]: (r["at"], r["n"]) for r in found} == want and len(found) == 600
    assert stored[0].count("Exchange") == 1


def test_ndcg_of_models_equals_grouped_ndcg_and_shuffles_once(spark):
    from newsreach.operators import evaluate

    rows = [(i, i // 20 if i < 195 else None, float(i * 37 % 101) if i % 9 else None, float(i * 53 % 7), float(i * 11 % 13) if i >= 20 else 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g long, p double, q double, actual double")
    found = evaluate.ndcg_of_models(df, ["g"], ["p", "q"], "actual", ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(g") == 1
    got = {r["model"]: r["ndcg"] for r in found.collect()}
    for model in ("p", "q"):
        assert got[model] == pytest.approx(evaluate.grouped_ndcg(df, ["g"], model, "actual", ["id"]).first()["ndcg"], abs=1e-12)
    assert [r["ndcg"] for r in evaluate.ndcg_of_models(df.limit(0), ["g"], ["p", "q"], "actual", ["id"]).collect()] == [0.0, 0.0]
