"""Splits without leaks, samples, learned models, files."""

import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from newsreach.operators import evaluate as V
from newsreach.operators import models as M
from newsreach.operators import splits as S
from newsreach.sources import database as D
from newsreach.sources import files as X
from newsreach.sources import workspace as W


def test_temporal_split_rules(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, f"c{i}", start + timedelta(days=i)) for i in range(40)] + [(100, "c0", start + timedelta(days=39)), (101, "c1", start + timedelta(days=30))]
    df = spark.createDataFrame(rows, "k int, c string, t timestamp_ntz")
    got = {r.k: r.split for r in S.temporal_split(df, ["c"], "t").collect()}
    days = np.array([(r[2] - start).days for r in rows], dtype=float)
    cut = np.quantile(days, 0.8)
    inner = np.quantile(days[days < cut], 0.875)
    past, inner_past = {r[1] for r, d in zip(rows, days) if d < cut}, {r[1] for r, d in zip(rows, days) if d < inner}
    for (key, company, _), d in zip(rows, days):
        want = ("train" if d < inner else ("dropped" if company in inner_past else "valid") if d < cut else "dropped" if company in past else "test")
        assert got[key] == want
    assert got[100] == "dropped"


def test_entity_split_shares_no_entity(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 101).alias("c"))
    rows = S.entity_split(df, ["c"], seed=3).collect()
    sides = {}
    for r in rows:
        sides.setdefault(r.c, set()).add(r.split)
    assert len(rows) == 1000 and all(len(s) == 1 for s in sides.values())
    names = [next(iter(s)) for s in sides.values()]
    assert (names.count("test"), names.count("valid")) == (int(101 * 0.2), int(101 * (0.2 + 0.1)) - int(101 * 0.2))
    again = S.entity_split(df.repartition(7), ["c"], seed=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    assert {r.split for r in S.deploy_split(df, ["c"]).collect()} == {"train", "valid"}


def test_groups_are_full_and_the_rest_is_dropped(spark):
    sizes = S.fixed_groups(spark.range(47).withColumnRenamed("id", "k"), ["k"], 10).groupBy("group_id").count().collect()
    assert sorted(r["count"] for r in sizes) == [10, 10, 10, 10]
    rows = spark.createDataFrame([("a",)] * 10 + [("b",)] * 9, "c string")
    assert {r.c for r in S.entity_groups(rows, ["c"]).collect()} == {"a"}


def test_sample_is_seeded(spark):
    df = spark.range(200).select(F.col("id").alias("k"), F.repeat(F.lit("x"), F.col("id").cast("int") % 20).alias("title"))
    first, second = (sorted(r.k for r in S.sample_rows(part, ["k"], 10, 1).collect()) for part in (df, df.repartition(5)))
    assert first == second and len(first) == 10
    assert first != sorted(r.k for r in S.sample_rows(df, ["k"], 10, 2).collect())
    assert all(len(r.title) >= 12 for r in S.sample_rows(df, ["k"], 500, 1).collect())


@pytest.fixture(scope="module")
def learning(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 6))
    y = np.clip(0.5 + 0.15 * x[:, 0] - 0.1 * x[:, 1] + rng.normal(0, 0.02, 240), 0, 1)
    rows = [(i, [float(v) for v in x[i]], int(i % 4) if i % 7 else None, int(i % 3), "新店舗" if i % 2 else "t", float(y[i]),
             "train" if i < 160 else "valid" if i < 200 else "test") for i in range(240)]
    df = spark.createDataFrame(rows, "k int, embedding array<float>, category int, place int, title string, pv_score double, split string")
    return W.materialize(df, "learning"), x, y


def error(df, model, split="test"):
    return V.rmse(df.where(F.col("split") == split), model, "pv_score").first().rmse


def test_encoder_sends_unknown_ids_to_the_last_class(spark, learning):
    df, _, _ = learning
    encoder = M.fit_encoder(df.where("split = 'train'"))
    assert encoder.widths == {"category": 4, "place": 3}
    odd = df.limit(1).withColumns({"category": F.lit(99), "place": F.lit(2)})
    dense = M.encode(odd, encoder).first().dense.toArray()
    assert len(dense) == 6 + 4 + 3 + 1
    assert list(dense[6:13]) == [0, 0, 0, 1, 0, 0, 1]


def test_models_beat_the_mean_and_survive_storage(spark, learning, tmp_path):
    df, x, y = learning
    rows = M.features(df)
    assert len(rows.first().features) == 9
    mean = float(np.sqrt(np.mean((y[200:] - y[:160].mean()) ** 2)))
    forest = M.predict(M.fit_forest(rows, trees=20, depth=6), rows, "forest")
    model = M.fit_gbt(rows, rounds=40, depth=3, patience=8)
    boosted = M.predict(model, rows, "gbt")
    errors = model.evaluateEachIteration(rows.where("split = 'valid'"), "squared")
    assert len(errors) <= 40 and min(errors) == errors[-1]
    assert M.best_round([3.0, 2.0, 2.5, 2.4, 1.0], 2) == (2, True) and M.best_round([3.0, 2.0, 2.5], 2) == (2, False)
    assert error(forest, "forest") < mean and error(boosted, "gbt") < mean
    encoded = M.encode(df, M.fit_encoder(df.where("split = 'train'")))
    ridge, alpha = M.fit_ridge(encoded)
    scored = M.predict(ridge, encoded, "ridge")
    assert error(scored, "ridge") < mean / 2
    stored = M.save_run({"ridge": ridge}, scored, str(tmp_path / "run"), {"alpha": alpha}, encoder=M.fit_encoder(df.where("split = 'train'")))
    table = {r.name: r.value for r in stored.collect()}
    assert float(table["valid_spearman_ridge"]) > 0.8 and table["rows_train"] == "160" and float(table["alpha"]) == alpha
    afresh = M.encode(df, M.load_encoder(spark, str(tmp_path / "run")))
    again = M.predict(M.load_model(spark, str(tmp_path / "run" / "ridge")), afresh, "ridge")
    assert error(again, "ridge") == pytest.approx(error(scored, "ridge"))


def test_a_large_forest_is_grown_stored_and_used_in_parts(spark, learning, tmp_path, monkeypatch):
    df, x, y = learning
    rows = W.materialize(M.features(df.unionAll(df.limit(3))), "forest-input")
    grown = []

    def regressor(**given):
        grown.append(given["numTrees"])
        return RandomForestRegressor(**given)

    monkeypatch.setattr(M, "FOREST_NODES", 50, raising=False)
    monkeypatch.setattr(M, "RandomForestRegressor", regressor)
    model = M.fit_forest(rows, trees=7, depth=6)
    assert grown == [3, 2, 2]
    forest = M.predict(model, rows, "forest").collect()
    path = str(tmp_path / "run" / "forest")
    M.save_run({"forest": model}, M.predict(model, rows, "forest"), str(tmp_path / "run"), {})
    model.write().overwrite().save(path)
    M.load_model(spark, path).write().overwrite().save(path)
    again = M.predict(M.load_model(spark, path), rows, "forest").collect()
    trees = [tree for path in model.paths for tree in RandomForestRegressionModel.load(path).trees]
    assert len(trees) == 7 and len({tree.toDebugString for tree in trees}) == 7
    assert len(forest) == len(again) == 243
    for row in forest:
        assert row.forest == pytest.approx(np.clip(np.mean([tree.predict(row.features) for tree in trees]), 0, 1))
    assert sorted((r.k, r.forest) for r in forest) == sorted((r.k, r.forest) for r in again)
    mean = np.mean((y[200:] - y[:160].mean()) ** 2)
    assert np.mean([(r.forest - r.pv_score) ** 2 for r in forest if r.split == "test"]) < mean


def test_parts_of_a_forest_bound_its_nodes():
    assert M.forest_parts(1400, 200, 30) == [200] and M.forest_parts(0, 20, 6) == [20]
    for size in (100_000, 420_000, 10_000_000):
        parts = M.forest_parts(size, 200, 30)
        assert sum(parts) == 200 and (max(parts) == 1 or max(parts) * 2 * (size // 20) <= M.FOREST_NODES)


def test_ridge_is_the_closed_form(spark, learning):
    df, x, y = learning
    encoded = M.encode(df, M.fit_encoder(df.where("split = 'train'")))
    model, _ = M.fit_ridge(encoded, alphas=(10.0,))
    dense = np.array([r.dense.toArray() for r in encoded.orderBy("k").select("dense").collect()])[:160]
    centered, target = dense - dense.mean(0), y[:160] - y[:160].mean()
    want = np.linalg.solve(centered.T @ centered + 10.0 * np.eye(dense.shape[1]), centered.T @ target)
    assert np.abs(model.coefficients.toArray() - want).max() < 1e-3


def test_acceptance_ranks(spark):
    df = spark.createDataFrame([("a", 0.9, 0.1), ("b", 0.5, 0.3), ("c", 0.5, 0.2)], "plan string, knn double, ridge double")
    got = {r.plan: (r.knn_rank, r.ridge_rank) for r in V.acceptance_table(df, "plan", ["knn", "ridge"]).collect()}
    assert got == {"a": (1, 3), "b": (2, 1), "c": (2, 2)}


def test_lift_report_and_pairs(spark):
    rows = [(i, arm, 0.5, 0.5 + d, 3, 2, 0) for i, (p, q) in enumerate([(0.1, 0.0), (0.2, 0.3), (-0.1, -0.2)]) for arm, d in (("new", p), ("old", q))]
    df = spark.createDataFrame(rows, "case int, arm string, before double, after double, suggestions int, covered int, leaks int")
    got = {r.arm: r for r in V.lift_report(df, ["case"]).collect()}
    assert got["new"].win_rate == pytest.approx(2 / 3) and got["new"].lift_median == pytest.approx(0.1)
    pair = V.arm_difference(df, ["case"], "new", "old").first()
    assert (pair.cases, pair.win_rate, pair.median_gap) == (3, pytest.approx(2 / 3), pytest.approx(0.1))


def test_csv_parts_are_matched_by_name(spark, tmp_path):
    (tmp_path / "p1.csv").write_text('a,b\n1,"x ""q"" y"\n2,"two\nlines"\n', encoding="utf-8")
    (tmp_path / "p2.csv").write_text('b,c,a\n,7,3\n"",8,4\n', encoding="utf-8")
    rows = {r.a: (r.b, r.c) for r in X.read_csv_glob(spark, str(tmp_path / "p*.csv"), {"a": "int", "c": "int"}).collect()}
    assert rows[1] == ('x "q" y', None) and rows[2] == ("two\nlines", None)
    assert rows[3] == (None, 7) and rows[4] == ("", 8)
    inferred = X.read_csv_glob(spark, str(tmp_path / "p*.csv"))
    assert dict(inferred.dtypes)["a"] == "int"
    with pytest.raises(Exception):
        X.read_csv_glob(spark, str(tmp_path / "none*.csv"))


def test_many_csv_files_take_a_constant_number_of_jobs(spark, tmp_path):
    import gzip

    def jobs(count):
        folder = tmp_path / f"n{count}"
        folder.mkdir()
        for i in range(count):
            names = ("a,b", "b,a")[i % 2]
            body = (f'{names}\n' + ("1,x\n" if i % 2 == 0 else '"y ""z""\nw",2\n')).encode()
            path = folder / f"p{i:04d}.csv{'.gz' if i % 3 == 0 else ''}"
            path.write_bytes(gzip.compress(body) if i % 3 == 0 else body)
        (folder / "empty.csv").write_bytes(b"")
        spark.sparkContext.setJobGroup(f"csv{count}", "")
        table = X.read_csv_glob(spark, f"{folder}/*", {"a": "int"})
        rows = table.groupBy("a", "b").count().collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert {(r.a, r.b): r["count"] for r in rows} == {(1, "x"): -(-count // 2), (2, 'y "z"\nw'): count // 2}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"csv{count}"))

    # above 32 paths Spark lists them in a job
    assert jobs(100) == jobs(300) <= 8


def test_a_scope_deletes_its_own_tables_only(spark, monkeypatch):
    monkeypatch.setattr(W, "_stored", [])
    path = lambda df: df.inputFiles()[0].removeprefix("file:").removeprefix("//")
    outer = path(W.materialize(spark.range(2), "outer"))
    with W.scope(spark):
        first = path(W.materialize(spark.range(2), "first"))
        with W.scope(spark):
            second = path(W.materialize(spark.range(2), "second"))
        assert os.path.exists(first) and not os.path.exists(second)
    assert os.path.exists(outer) and not os.path.exists(first)
    assert W.drop_materialized(spark) == 1 and not os.path.exists(outer)


def counted(spark, df):
    """The table with an accumulator of how many of its rows have been computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(count, df.schema), seen


def test_inputs_are_computed_once(spark):
    from newsreach.operators import evaluate as V
    from newsreach.operators import rollup as R

    base = spark.range(300).selectExpr("id as k", "id % 20 as g", "id % 7 as p", "cast(id * 37 % 101 as double) as x", "cast(id % 11 as double) as y")
    for run in (
        lambda df: R.reach_score(df, "x"),
        lambda df: R.with_share(df, F.col("x")),
        lambda df: R.corpus_report(df, "g", "x", "p"),
        lambda df: V.ndcg_per_group(df, ["g"], "x", "y", ["k"]),
        lambda df: V.metric_report(df, ["x", "y"], "y", ["g"], ["k"]),
        lambda df: V.rank_average(df, ["x", "y"]),
        lambda df: V.bootstrap_gap(df, "x", "y", "y", ["k"], rounds=3),
        lambda df: R.fill_report(base.withColumn("t", F.lit("a")), df, "t", "x", "y", "p"),
    ):
        df, seen = counted(spark, base)
        run(df).collect()
        assert seen.value == 300


def test_resumed_job_does_only_what_is_missing(spark, tmp_path):
    path, seen = str(tmp_path / "out"), []

    def work(part):
        seen.append(part.count())
        return part.withColumn("v", F.col("k") * 2)

    df = spark.range(10).withColumnRenamed("id", "k")
    X.run_missing(df.where("k < 4"), path, ["k"], work)
    rows = X.run_missing(df, path, ["k"], work).collect()
    assert seen == [4, 6] and len(rows) == 10


def test_sinks(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "k")
    assert X.write_csv_gz(df, str(tmp_path / "c")) == 5
    assert X.publish({"one": df, "two": df.limit(2)}, str(tmp_path / "s")) == {"one": 5, "two": 2}
    X.write_if_absent(df.limit(1), str(tmp_path / "w"))
    assert X.write_if_absent(df, str(tmp_path / "w")).count() == 1
    assert X.write_metrics(df, str(tmp_path / "m")).count() == 5


def test_key_slices(spark):
    assert D.slice_count(0, 190_000, 2000) == 95 and D.slice_count(5, 5, 10) == 1
    got = {r.slice: (r.rows, r["keys"]) for r in D.key_slices(spark.createDataFrame([(1,), (1,), (9,), (12,)], "k int"), "k", 0, 10).collect()}
    assert got == {0: (3, 2), 1: (1, 1)}


def test_database_ranges_cover_the_keys(spark, monkeypatch):
    from pyspark.sql import DataFrameReader

    asked = {}
    monkeypatch.setattr(DataFrameReader, "jdbc", lambda self, **options: asked.update(options))
    D.read_partitioned(spark, "jdbc:x", "(SELECT 1) t", "company_id", 0, 190_000, 2000, {"fetchsize": "10000"})
    assert asked["column"] == "company_id" and asked["numPartitions"] == 95
    assert (asked["lowerBound"], asked["upperBound"]) == (0, 190_000)


def test_stored_tables_can_be_dropped(spark, monkeypatch):
    monkeypatch.setattr(W, "_stored", [])
    path = W.materialize(spark.range(2), "gone").inputFiles()[0].removeprefix("file:").removeprefix("//")
    assert os.path.exists(path)
    assert W.drop_materialized(spark) == 1 and not os.path.exists(path)


def test_intermediate_tables_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    stored = W.materialize(spark.range(3), "t")
    assert stored.count() == 3 and all(os.path.realpath(folder) in os.path.realpath(p.removeprefix("file:")) for p in stored.inputFiles())


def test_a_failing_chunk_does_not_stop_the_others(spark, tmp_path):
    from newsreach.sources.ledger import ledger, read_chunks, run_chunks

    path, seen = str(tmp_path / "job"), []
    df = spark.createDataFrame([(i, None if i % 4 == 3 else f"c{i % 4}") for i in range(20)], "k long, c string")
    assert read_chunks(spark, path) is None and ledger(spark, path).count() == 0

    def work(part):
        name = part.first().c
        seen.append(name)
        if name == "c1" and seen.count("c1") == 1:
            raise RuntimeError("no connection")
        bad = F.when(F.col("c") == "c2", F.raise_error(F.lit("bad row"))) if seen.count("c2") == 1 and name == "c2" else F.lit("x")
        return part.withColumn("v", bad)

    first = run_chunks(df, "c", path, work)
    assert sorted(first["done"]) == ["None", "c0"] and sorted(first["failed"]) == ["c1", "c2"]
    assert sorted(r.k for r in read_chunks(spark, path).collect()) == [i for i in range(20) if i % 4 in (0, 3)]
    notes = {r.chunk: r for r in ledger(spark, path).where("state = 'failed'").collect()}
    assert "no connection" in notes["c1"].error and "bad row" in notes["c2"].error and notes["c1"].attempt == 1
    second = run_chunks(df, "c", path, work)
    assert sorted(second["done"]) == ["c1", "c2"] and not second["failed"]
    assert sorted(r.k for r in read_chunks(spark, path).collect()) == list(range(20))
    assert ledger(spark, path).where("chunk = 'c1' and state = 'done' and attempt = 2 and rows = 5").count() == 1
    assert run_chunks(df, "c", path, work) == {"done": [], "failed": []}


def test_a_version_is_published_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "serving")
    one, two = spark.range(5).withColumnRenamed("id", "k"), spark.range(3).withColumnRenamed("id", "k")
    X.publish({"one": one, "two": two}, folder, unique={"one": ["k"]})
    before = sorted(os.listdir(tmp_path / "serving" / "data"))
    broken = two.select(F.when(F.col("k") == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("k")).alias("k"))
    for tables, unique, error in (
        ({"one": one.limit(1), "two": broken}, None, Exception),
        ({"one": one.union(one), "two": two}, {"one": ["k"]}, ValueError),
        ({"one": one}, None, ValueError),
        ({}, None, ValueError),
    ):
        with pytest.raises(error):
            X.publish(tables, folder, unique)
        assert X.published(spark, folder, "one").count() == 5 and X.published(spark, folder, "two").count() == 3
        assert sorted(os.listdir(tmp_path / "serving" / "data")) == before
    X.publish({"one": one.limit(1), "two": two.limit(2), "three": two}, folder)
    assert [X.published(spark, folder, t).count() for t in ("one", "two", "three")] == [1, 2, 3]
    assert [X.published(spark, folder, t, version=1).count() for t in ("one", "two")] == [5, 3]
    with pytest.raises(FileNotFoundError):
        X.published(spark, folder, "three", version=1)
