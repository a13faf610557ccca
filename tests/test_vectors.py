"""Search kernel against brute force in both forms; outlets; re-ranking."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsreach.operators import vectors as V


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(11)

    def frame(n, name):
        x = rng.normal(size=(n, 8))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        f = pd.DataFrame({name: np.arange(n), "embedding": [v.astype("float32").tolist() for v in x]})
        f["category"] = [None if i % 5 == 0 else int(i % 3) for i in range(n)]
        f["place"] = [None if i % 4 == 0 else int(i % 2) for i in range(n)]
        f["reach_score"], f["pv_score"] = rng.random(n), rng.random(n)
        return f

    q, c = frame(30, "q"), frame(200, "k")
    for i in range(60, 160):  # many copies of one row
        c.at[i, "embedding"], c.at[i, "reach_score"], c.at[i, "category"], c.at[i, "place"] = c.at[60, "embedding"], 0.5, 1, 1
    schema = "{} long, embedding array<float>, category int, place int, reach_score double, pv_score double"

    def table(f, name):
        rows = [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in row) for row in f.itertuples(index=False)]
        return spark.createDataFrame([(int(r[0]), r[1], None if r[2] is None else int(r[2]), None if r[3] is None else int(r[3]), *r[4:]) for r in rows], schema.format(name))

    return table(q, "q"), table(c, "k"), q, c


def brute(q, c, k, reach, null_matches_null=False):
    out = {}
    for a in q.itertuples():
        scores = []
        for b in c.itertuples():
            s = float(np.dot(np.array(a.embedding, dtype=float), np.array(b.embedding, dtype=float))) + reach * b.reach_score
            for x, y in ((a.category, b.category), (a.place, b.place)):
                nx, ny = x is None or x != x, y is None or y != y
                s += 0.04 * ((nx and ny and null_matches_null) or (not nx and not ny and x == y))
            scores.append((-round(s, 9), b.k))
        out[a.q] = [key for _, key in sorted(scores)[:k]]
    return out


def listed(df):
    got = {}
    for r in df.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.k)
    return got


@pytest.mark.parametrize("cells", [10**6, 0])
@pytest.mark.parametrize("k", [1, 8, 300])
def test_search_equals_brute_force(space, cells, k):
    queries, corpus, q, c = space
    found = V.nearest(queries, corpus.repartition(5), "q", ["k"], k, V.SEARCH_BONUS, broadcast_cells=cells, block_rows=17)
    assert listed(found) == brute(q, c, k, 0.05)


def test_null_convention_of_the_baseline(space):
    queries, corpus, q, c = space
    found = V.nearest(queries, corpus, "q", ["k"], 5, V.Bonus(null_matches_null=True))
    assert listed(found) == brute(q, c, 5, 0.0, null_matches_null=True)


def test_plan_score_is_the_median_and_null_without_neighbours(space):
    queries, corpus, q, c = space
    got = {r.q: r.plan_score for r in V.plan_score(queries, corpus, "q", ["k"], k=6).collect()}
    for key, neighbours in brute(q, c, 6, 0.0).items():
        assert got[key] == pytest.approx(np.median(c.pv_score[neighbours]))
    empty = V.plan_score(queries, corpus.limit(0), "q", ["k"]).collect()
    assert len(empty) == 30 and all(r.plan_score is None for r in empty)


def test_zero_vector_is_never_ahead(spark):
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "k long, embedding array<float>")
    query = spark.createDataFrame([(9, [1.0, 0.0])], "q long, embedding array<float>")
    rows = V.nearest(query, corpus, "q", ["k"], 2, V.Bonus(matches={})).orderBy("rank").collect()
    assert [(r.k, r.score) for r in rows] == [(2, 1.0), (1, 0.0)]


def test_composite_and_text_keys(spark):
    corpus = spark.createDataFrame([("b", 1, [1.0]), ("a", 2, [1.0]), ("a", 1, [1.0])], "c string, k long, embedding array<float>")
    query = spark.createDataFrame([("x", [1.0])], "q string, embedding array<float>")
    rows = V.nearest(query, corpus, "q", ["c", "k"], 2, V.Bonus(matches={})).orderBy("rank").collect()
    assert [(r.c, r.k) for r in rows] == [("a", 1), ("a", 2)]


def test_hashed_vectors_are_unit_and_repeatable(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, ""), (3, None), (4, "b a b")], "k int, t string")
    got = {r.k: r.embedding for r in V.hashed_embedding(df, "t", 16).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1.0, abs=1e-6)
    assert got[1] == got[4]
    assert sum(map(abs, got[2])) == 0 and sum(map(abs, got[3])) == 0


def test_embed_keeps_rows_with_their_vectors(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(450)], "k int, t string").repartition(2)
    sizes = []

    def lengths(texts):
        sizes.append(len(texts))
        assert len(texts) <= 200
        return np.array([[len(t), 0.0] if t else [0.0, 0.0] for t in texts])

    got = {r.k: r.embedding for r in V.embed(df, "t", lengths).collect()}
    assert len(got) == 450 and got[0] == [0.0, 0.0] and got[449] == [1.0, 0.0]


def outlets(spark, cases, media, frequency, total):
    return V.distinctive(
        spark.createDataFrame(cases, "q int, k int"), spark.createDataFrame(media, "k int, outlet string"),
        spark.createDataFrame(frequency, "outlet string, case_count long"), spark.createDataFrame([(total,)], "case_count long"),
        "q", ["k"], "outlet",
    )


def test_distinctive_outlets(spark):
    cases = [(1, k) for k in range(4)]
    media = [(k, "everywhere") for k in range(4)] + [(0, "rare"), (1, "rare"), (0, "unknown"), (2, "common")]
    by_case, by_set = outlets(spark, cases, media, [("everywhere", 90), ("rare", 2), ("common", 50)], 100)
    rows = by_set.orderBy("rank").collect()
    assert [r.outlet for r in rows] == ["rare", "unknown", "common"]
    assert rows[0].score == pytest.approx(2 * math.log(50)) and rows[1].score == pytest.approx(math.log(100))
    assert [r.outlet for r in by_case.where("k = 0").orderBy("rank").collect()] == ["rare", "unknown"]


def test_a_single_case_keeps_its_outlets(spark):
    _, by_set = outlets(spark, [(1, 0)], [(0, "a"), (0, "b")], [("a", 1), ("b", 2)], 10)
    assert [r.outlet for r in by_set.orderBy("rank").collect()] == ["a", "b"]


def test_rerank_lifts_matches_and_is_stable(spark):
    rows = [(1, 10, 0.50, 1, "x", "a"), (1, 11, 0.50, 2, "x", "b"), (1, 12, 0.45, 3, "y", "a"), (1, 13, 0.10, 4, None, None)]
    df = spark.createDataFrame(rows, "q int, k int, score double, rank int, c string, p string").withColumns(
        {"qc": F.lit("y"), "qp": F.lit("a"), "open_count": F.lit(3)})
    got = V.rerank(df, "q", {"c": ("qc", "c"), "p": ("qp", "p")}, "open_count", k=3).orderBy("new_rank").collect()
    assert [r.k for r in got] == [12, 10, 11]
    none = V.rerank(df.withColumn("open_count", F.lit(0)), "q", {"c": ("qc", "c"), "p": ("qp", "p")}, "open_count").orderBy("new_rank")
    assert [r.k for r in none.collect()] == [10, 11, 12, 13]


def test_bad_vectors_and_text_classes_do_not_hide_neighbours():
    import numpy as np
    import pandas as pd

    from newsreach.operators import vectors as V

    same = V._same_class(pd.DataFrame({"c": ["a", None, "b"]}), pd.DataFrame({"c": ["b", None, "a"]}), "c", False)
    assert same.tolist() == [[False, False, True], [False, False, False], [True, False, False]]
    numbers = V._same_class(pd.DataFrame({"c": [-1.0, None]}), pd.DataFrame({"c": [None, -1.0]}), "c", False)
    assert numbers.tolist() == [[False, True], [False, False]]
    corpus = pd.DataFrame({"id": range(5), "v": [[1.0, 0.0], [np.nan, 0.0], [0.9, 0.0], [np.nan, 1.0], [0.5, 0.0]]})
    queries = pd.DataFrame({"q": [1]})
    got = V._best_of_block(queries, np.array([[1.0, 0.0]]), corpus, "v", ["id"], [], V.Bonus(matches={}, reach=0.0), 3)
    assert got["id"].tolist() == [0, 2, 4]


def clustered(spark, rows, clusters, seed=5, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    x = centres[rng.integers(0, clusters, rows)] + rng.normal(0, 0.05, (rows, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    data = [(i, v.tolist(), int(i % 5), int(i % 3), float(i % 7) / 7) for i, v in enumerate(x)]
    return spark.createDataFrame(data, "k long, embedding array<double>, category int, place int, reach_score double"), x


def test_pivots_leave_out_most_pairs_of_clustered_vectors(spark, monkeypatch):
    """Same rows as the scan, with less than a tenth of the pairs scored."""
    from newsreach.operators import pivots

    corpus, x = clustered(spark, 4000, 60)
    queries = corpus.where("k % 4 = 0").select(F.col("k").alias("q"), "embedding", "category", "place")
    found = V.nearest(queries, corpus, "q", ["k"], 8, broadcast_cells=0, block_rows=40)
    assert listed(found) == listed(V.nearest(queries, corpus, "q", ["k"], 8))
    index = pivots.build_index(corpus, ["k"], "embedding", 40, 0.08, 0.05, "reach_score")
    rows = dict(zip(index.leaves["leaf"], index.leaves["rows"]))
    assert sum(rows.values()) == 4000 and max(rows.values()) <= 160
    kth = V.nearest(queries, corpus, "q", ["k"], 8).where("rank = 8").select("q", F.col("score").alias("least"))
    first = index.probes(queries, "embedding", 8).select("__leaf").collect()
    second = index.probes(queries.join(kth, "q"), "embedding", 8, "least").select("__leaf").collect()
    assert sum(rows[r["__leaf"]] for r in [*first, *second]) < 0.1 * 1000 * 4000


def test_bounds_hold_for_vectors_of_any_length(spark):
    from newsreach.operators import pivots

    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6)) * rng.exponential(3, (500, 1))
    x[:20] = 0
    x[20:40] = x[40]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, embedding array<double>")
    index = pivots.build_index(corpus, ["k"], "embedding", 10, 0.0)
    leaf = {r.k: r["__leaf"] for r in index.members.collect()}
    queries = np.concatenate((rng.normal(size=(30, 6)), -x[40:45], np.zeros((1, 6))))
    bounds = pd.DataFrame(index.bounds(queries), columns=index.leaves["leaf"])
    for i, q in enumerate(queries):
        for k in range(500):
            assert q @ x[k] <= bounds[leaf[k]][i]


def test_pivot_search_with_missing_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [0.0, 0.0]), (5, [-1.0, 0.0]), (6, [1.0]), (7, [0.6, 0.8]), (8, [0.6, 0.8]), (9, [inf, 1.0])]
    corpus = spark.createDataFrame([(k, v, None, 1) for k, v in vectors], "k long, embedding array<double>, category int, place int")
    asked = [(k, v, None, None) for k, v in ((1, [1.0, 0.0]), (2, [nan, 0.0]), (3, None), (None, [0.0, 1.0]), (5, [0.0, 0.0]))]
    queries = spark.createDataFrame(asked, "q long, embedding array<double>, category int, place int")
    for cells in (10**6, 0):
        found = V.nearest(queries, corpus, "q", ["k"], 3, V.SCORE_BONUS, broadcast_cells=cells, block_rows=2)
        assert listed(found) == {1: [1, 7, 8], None: [7, 8, 1], 5: [1, 4, 5]}, cells
        assert V.nearest(queries, corpus.limit(0), "q", ["k"], 3, V.SCORE_BONUS, broadcast_cells=cells).count() == 0
        assert V.nearest(queries.limit(0), corpus, "q", ["k"], 3, V.SCORE_BONUS, broadcast_cells=cells).count() == 0


def flaky():
    """A function that fails twice for each batch, then works; it always fails on a text that says so."""
    tries = [0]

    def call(texts):
        tries[0] += 1
        if "never" in texts:
            raise ConnectionError("refused")
        if tries[0] % 3:
            raise TimeoutError("later")
        return np.array([[len(t), 1.0] for t in texts])

    return call


def test_batch_calls_are_tried_again(spark, monkeypatch):
    waits = []
    monkeypatch.setattr(V.time, "sleep", waits.append)
    assert V.called(flaky(), ["ab"], 3, 1.0).tolist() == [[2.0, 1.0]] and waits == [1.0, 2.0]
    with pytest.raises(ConnectionError):
        V.called(flaky(), ["never"], 8, 1.0)
    assert waits[2:] == [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 60.0, 60.0]
    with pytest.raises(ValueError):
        V.called(lambda texts: np.zeros((1, 2)), ["a", "b"], 0, 0)
    df = spark.createDataFrame([(i, "x" * i) for i in range(450)], "k int, t string").repartition(2)
    assert V.embed(df, "t", flaky(), retries=3, wait=0.0).where("embedding is null").count() == 0
    with pytest.raises(Exception, match="refused"):
        V.embed(spark.createDataFrame([(1, "never")], "k int, t string"), "t", flaky(), retries=1, wait=0.0).collect()


def test_failed_calls_are_noted_and_taken_up_by_the_next_run(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = [(i, "never" if i == 250 else "x" * (i % 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, t string").repartitionByRange(1, "k").sortWithinPartitions("k")
    assert V.embedded(spark, path) is None
    good, bad = V.embed_missing(df, ["k"], "t", flaky(), path, retries=2, wait=0.0)
    assert (good, bad) == (400, 200)
    notes = V.embedding_failures(spark, path).collect()
    assert len(notes) == 200 and all("refused" in r.error for r in notes) and 250 in {r.k for r in notes}
    calm = spark.createDataFrame([(i, "x" * (i % 9)) for i in range(600)], "k int, t string")
    assert V.embed_missing(calm, ["k"], "t", flaky(), path, retries=2, wait=0.0) == (200, 0)
    assert V.embedded(spark, path).select("k").distinct().count() == V.embedded(spark, path).count() == 600
    assert V.embed_missing(calm, ["k"], "t", flaky(), path, retries=0, wait=0.0) == (0, 0)


def test_a_corpus_sent_to_the_tasks_gives_the_same_rows_and_shuffles_k_a_query(spark, monkeypatch):
    """Many queries against a corpus that fits: no candidates but the k of each query, and none lost to single precision."""
    corpus, x = clustered(spark, 1500, 4)
    queries = corpus.select(F.col("k").alias("q"), "embedding", "category", "place")
    scanned = V.nearest(queries.where("k < 800"), corpus, "q", ["k"], 8)
    found = V.nearest(queries, corpus, "q", ["k"], 8)
    assert {q: k for q, k in listed(found).items() if q < 800} == listed(scanned)
    given = []
    monkeypatch.setattr(V, "top_k", lambda df, *rest: given.append(df.count()) or df)
    V.nearest(queries, corpus, "q", ["k"], 8)
    assert given == [8 * 1500]


def test_an_index_sends_a_query_once_to_a_shard(spark):
    """Vectors without clusters reach nearly all leaves, but a query and its vector travel once for all leaves of a shard."""
    from newsreach.operators import pivots

    rng = np.random.default_rng(3)
    data = [(i, v.tolist(), 1, 1, 0.5) for i, v in enumerate(rng.normal(size=(2000, 12)))]
    corpus = spark.createDataFrame(data, "k long, embedding array<double>, category int, place int, reach_score double")
    queries = corpus.where("k < 300").select(F.col("k").alias("q"), "embedding", "category", "place")
    index = pivots.build_index(corpus, ["k"], "embedding", 20, 0.08, 0.05, "reach_score")
    every = queries.withColumn("least", F.lit(float("-inf")))
    assert len(index.leaves) > 90 and index.visits(every, "embedding", 8, "least").count() == 300
    assert listed(V.nearest(queries, corpus, "q", ["k"], 8, broadcast_cells=0, block_rows=20)) == listed(V.nearest(queries, corpus, "q", ["k"], 8))


def test_single_precision_hides_no_tie_and_no_large_number():
    """The best of a block against scores in double precision: near ties, equal rows, numbers beyond single precision."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 8))
    x = np.concatenate((base, base + 1e-8, base, rng.normal(size=(80, 8))))
    for scale in (1.0, 1e-6, 1e200):
        corpus = pd.DataFrame({"id": range(len(x)), "v": list(x * scale), "c": rng.integers(0, 3, len(x)).astype(float), "reach_score": rng.random(len(x))})
        corpus.loc[::7, "c"] = None
        queries = corpus.rename(columns={"id": "q"})
        for bonus in (V.Bonus({"c": 0.04}, 0.05), V.Bonus({"c": 0.04}, null_matches_null=True), V.Bonus({})):
            found = V._best_of_block(queries, x, corpus, "v", ["id"], [], bonus, 6)
            full = V._scores(queries, corpus, x, x * scale, bonus)
            for i in range(len(x)):
                want = sorted(range(len(x)), key=lambda j: (-full[i, j], j))[:6]
                assert found.loc[found["__q"] == i, "id"].tolist() == want, (scale, bonus, i)


def test_a_score_known_to_be_reached_leaves_out_what_is_below():
    """The second round of the index gives no row below the k-th score of the first, and all that reach it."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 8))
    corpus = pd.DataFrame({"id": range(200), "v": list(x), "reach_score": rng.random(200)})
    for scale in (1.0, 1e200):
        bonus = V.Bonus({}, 0.05)
        full = V._best_of_block(corpus, x, corpus, x * scale, ["id"], [], bonus, 6)
        reached = full.groupby("__q")["score"].nth(2).to_numpy()
        some = V._best_of_block(corpus, x, corpus, x * scale, ["id"], [], bonus, 6, np.where(np.arange(200) % 2, reached, np.nan))
        for q, found in some.groupby("__q"):
            assert found["id"].tolist() == full.loc[full["__q"] == q, "id"].tolist()[: 3 if q % 2 else 6]


def test_steps_with_the_same_leaves_are_scored_as_one():
    from newsreach.operators import pivots

    rows = np.array([10, 10, 10, 1])
    every, one, other = np.ones(4, bool), np.array([True, False, False, False]), np.array([False, True, False, False])
    runs = list(pivots.alike([every, every & (rows > 1), one, one, other], rows))
    assert [(first, last) for first, last, _ in runs] == [(0, 2), (2, 4), (4, 5)]
    assert runs[0][2].all() and (runs[1][2] == one).all()
    assert list(pivots.alike([], rows)) == []


def test_rows_of_keys_are_found_without_a_shuffle_of_the_table(spark, monkeypatch):
    from newsreach.sources import files

    table = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (3, "d")], "k long, x string")
    keys = spark.createDataFrame([(1,), (1,), (3,), (None,), (9,)], "id long")
    found = files.rows_of(table, ["k"], keys)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    want = [(1, "a"), (1, "a"), (3, "d")]
    assert sorted(map(tuple, found.collect())) == want
    monkeypatch.setattr(files, "KEY_ROWS", 0)
    assert sorted(map(tuple, files.rows_of(table, ["k"], keys).collect())) == want
    assert "hashpartitioning" not in found.select("x")._jdf.queryExecution().executedPlan().toString()


def test_the_corpus_with_vectors_is_stored_once(spark, tables):
    from newsreach.plans.stand_ins import Roles

    roles = Roles(spark, tables)
    plan = roles.queries()._jdf.queryExecution().executedPlan().toString()
    assert roles.vectors() is roles.vectors() and "Join" not in plan
    orders = roles.table("orders").select(F.col("o_orderkey").alias("vec_id"))
    assert roles.vectors().count() == roles.table("embeddings").join(orders, "vec_id").count() > 0


def test_cases_per_outlet_of_a_table_that_is_distinct_already(spark):
    from newsreach.operators.rollup import outlet_frequency

    media = spark.createDataFrame([(1, "a"), (2, "a"), (None, "a"), (2, "b")], "k long, outlet string")
    known, counted = outlet_frequency(media, ["k"], "outlet", unique=True), outlet_frequency(media, ["k"], "outlet")
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, counted.collect())) == [("a", 3), ("b", 1)]
    assert known._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") < counted._jdf.queryExecution().executedPlan().toString().count("hashpartitioning")
