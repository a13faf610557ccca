"""Samples, splits, rank metrics, reports and learned models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsreach import constants as K
from newsreach.operators import evaluate as V
from newsreach.operators import models as M
from newsreach.operators import splits as S
from newsreach.operators.ranks import avg_rank
from newsreach.operators.vectors import SCORE_DECIMALS
from newsreach.plans.registry import query, rounded
from newsreach.plans.search_queries import top_sql
from newsreach.plans.stand_ins import KEY, Roles
from newsreach.sources.workspace import fresh_path, materialize

RANKED = "(rank() OVER ({w} ORDER BY {c}) + (count(*) OVER (PARTITION BY {p}{c}) - 1) / 2.0)::DOUBLE"


def rank_sql(column: str, group: str = "") -> str:
    """Average rank of a column in SQL."""
    within = f"PARTITION BY {group}" if group else ""
    return RANKED.format(w=within, c=column, p=f"{group}, " if group else "")


def hash_sql(seed: int, key: str) -> str:
    return f"md5('{seed}:' || {key})"


@query("F7_titled_rows", "SELECT p_partkey, p_name FROM part WHERE p_name IS NOT NULL AND length(p_name) >= 12")
def f7(r: Roles) -> DataFrame:
    return S.titled(r.table("part", "p_partkey", "p_name"), "p_name")


@query("F7_sample_rows", f"""
    SELECT p_partkey, p_name FROM part WHERE length(p_name) >= 12
    ORDER BY {hash_sql(42, 'p_partkey')}, p_partkey LIMIT 30""")
def f7_sample(r: Roles) -> DataFrame:
    return S.sample_rows(r.table("part", "p_partkey", "p_name"), ["p_partkey"], 30, 42, "p_name")


@query("W8_average_rank", f"SELECT o_orderkey, o_custkey, {rank_sql('o_custkey')} AS rank FROM orders")
def w8(r: Roles) -> DataFrame:
    return avg_rank(r.table("orders", "o_orderkey", "o_custkey"), "o_custkey", "rank")


@query("W8_rank_of_names_split", "SELECT c_custkey, (rank() OVER (ORDER BY c_name) + (count(*) OVER (PARTITION BY c_name) - 1) / 2)::DOUBLE AS rank FROM customer")
def w8_names(r: Roles) -> DataFrame:
    """Texts that begin alike, ranked in bands."""
    return avg_rank(r.table("customer", "c_custkey", "c_name"), "c_name", "rank", hot_rows=0).select("c_custkey", F.col("rank").cast("double").alias("rank"))


@query("W8_rank_in_an_octave_split", """
    SELECT o_orderkey, (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2)::DOUBLE AS rank
    FROM (SELECT o_orderkey, 1 + o_totalprice / 1000000000.0 AS x FROM orders)""")
def w8_octave(r: Roles) -> DataFrame:
    """Doubles between 1 and 2, ranked in bands."""
    rows = r.table("orders", "o_orderkey", "o_totalprice").select("o_orderkey", (1 + F.col("o_totalprice") / 1000000000.0).alias("x"))
    return avg_rank(rows, "x", "rank", hot_rows=0).select("o_orderkey", F.col("rank").cast("double").alias("rank"))


GROUPS_SQL = f"""
    groups AS (SELECT *, (row_number() OVER (ORDER BY {hash_sql(0, 'o_orderkey')}) - 1) // 20 AS group_id FROM predictions
               QUALIFY group_id < (SELECT count(*) // 20 FROM predictions))"""


@query("W9_fixed_groups", f"WITH {GROUPS_SQL} SELECT o_orderkey, group_id FROM groups", "predictions")
def w9(r: Roles) -> DataFrame:
    return S.fixed_groups(r.predictions(), ["o_orderkey"]).select("o_orderkey", "group_id")


@query("M3_spearman", f"""
    SELECT count(*) AS rows, round(corr(p, a), 9) AS spearman
    FROM (SELECT {rank_sql('pred_sum')} AS p, {rank_sql('actual')} AS a FROM predictions)""", "predictions")
def m3(r: Roles) -> DataFrame:
    return rounded(V.spearman(r.predictions(), "pred_sum", "actual"), "spearman", digits=9)


@query("M4_rmse", "SELECT round(sqrt(avg((pred_sum - actual) ** 2)), 4) AS rmse FROM predictions", "predictions")
def m4(r: Roles) -> DataFrame:
    return rounded(V.rmse(r.predictions(), "pred_sum", "actual"), "rmse", digits=4)


def ndcg_sql(group: str, source: str, pred: str) -> str:
    return f"""
        SELECT {group}, CASE WHEN i > 0 THEN g / i ELSE 0 END AS ndcg FROM (
            SELECT {group}, sum(actual / log2(rp + 1)) FILTER (WHERE rp <= 10) AS g, sum(actual / log2(ra + 1)) FILTER (WHERE ra <= 10) AS i
            FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {pred} DESC, o_orderkey) AS rp,
                         row_number() OVER (PARTITION BY {group} ORDER BY actual DESC, o_orderkey) AS ra FROM {source})
            GROUP BY ALL)"""


@query("M5_ndcg_per_group", f"WITH {GROUPS_SQL} SELECT group_id, round(ndcg, 9) AS ndcg FROM ({ndcg_sql('group_id', 'groups', 'pred_sum')})",
       "predictions")
def m5(r: Roles) -> DataFrame:
    groups = S.fixed_groups(r.predictions(), ["o_orderkey"])
    return rounded(V.ndcg_per_group(groups, ["group_id"], "pred_sum", "actual", ["o_orderkey"]), "ndcg", digits=9)


@query("M5_grouped_ndcg", f"""
    WITH {GROUPS_SQL} SELECT count(*) AS groups, round(avg(ndcg), 9) AS ndcg FROM ({ndcg_sql('group_id', 'groups', 'pred_sum')})""",
    "predictions")
def m5_mean(r: Roles) -> DataFrame:
    groups = S.fixed_groups(r.predictions(), ["o_orderkey"])
    return rounded(V.grouped_ndcg(groups, ["group_id"], "pred_sum", "actual", ["o_orderkey"]), "ndcg", digits=9)


@query("M6_entity_groups", """
    SELECT o_orderkey, o_custkey FROM predictions QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 10""", "predictions")
def m6(r: Roles) -> DataFrame:
    return S.entity_groups(r.predictions(), ["o_custkey"]).select("o_orderkey", "o_custkey")


POISSON_SQL = " + ".join(f"(u >= {limit!r})::INT" for limit in V.POISSON_ONE)


def weighted_rank_sql(column: str) -> str:
    return f"""(sum(w) OVER (PARTITION BY round ORDER BY {column}) - sum(w) OVER (PARTITION BY round, {column})
        + (sum(w) OVER (PARTITION BY round, {column}) + 1) / 2.0)"""


@query("M7_bootstrap_gap", f"""
    WITH drawn AS (SELECT * FROM (SELECT round, actual, pred_chars, pred_letters, {POISSON_SQL} AS w FROM (
        SELECT j.*, round, ('0x' || substr(md5('0:' || round || ':' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS u
        FROM judged j, (SELECT unnest(range(1000)) AS round))) WHERE w > 0),
    ranked AS (SELECT round, w, {weighted_rank_sql('actual')} AS a, {weighted_rank_sql('pred_chars')} AS x,
                      {weighted_rank_sql('pred_letters')} AS y, (sum(w) OVER (PARTITION BY round) + 1) / 2.0 AS m FROM drawn),
    gaps AS (SELECT round, sum(w * (x - m) * (a - m)) / sqrt(sum(w * (x - m) ** 2) * sum(w * (a - m) ** 2))
                         - sum(w * (y - m) * (a - m)) / sqrt(sum(w * (y - m) ** 2) * sum(w * (a - m) ** 2)) AS gap
             FROM ranked GROUP BY 1)
    SELECT count(gap) AS rounds, round(quantile_cont(gap, 0.025), 9) AS low, round(quantile_cont(gap, 0.975), 9) AS high FROM gaps""",
    "judged")
def m7(r: Roles) -> DataFrame:
    return rounded(V.bootstrap_gap(r.judged(), "pred_chars", "pred_letters", "actual", ["doc_id"]), "low", "high", digits=9)


@query("M8_metric_report", f"""
    WITH {GROUPS_SQL},
    large AS (SELECT * FROM predictions QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 10)
    """ + " UNION ALL ".join(f"""
    SELECT '{model}' AS model, (SELECT count(*) FROM predictions) AS rows,
           (SELECT round(corr(p, a), 9) FROM (SELECT {rank_sql(model)} AS p, {rank_sql('actual')} AS a FROM predictions)) AS spearman,
           (SELECT round(sqrt(avg(({model} - actual) ** 2)), 4) FROM predictions) AS rmse,
           (SELECT round(avg(ndcg), 9) FROM ({ndcg_sql('group_id', 'groups', model)})) AS ndcg_random,
           (SELECT round(avg(ndcg), 9) FROM ({ndcg_sql('o_custkey', 'large', model)})) AS ndcg_entity,
           (SELECT count(DISTINCT o_custkey) FROM large) AS entity_groups""" for model in ("pred_sum", "pred_lines")),
    "predictions")
def m8(r: Roles) -> DataFrame:
    report = V.metric_report(r.predictions(), ["pred_sum", "pred_lines"], "actual", ["o_custkey"], ["o_orderkey"])
    return rounded(rounded(report, "spearman", "ndcg_random", "ndcg_entity", digits=9), "rmse", digits=4)


TEMPORAL_SQL = """
    timed AS (SELECT o_orderkey, o_custkey, o_orderpriority, epoch_us(o_orderdate) AS us FROM orders),
    outer_cut AS (SELECT quantile_cont(us::DOUBLE, 0.8) AS c FROM timed),
    inner_cut AS (SELECT quantile_cont(us::DOUBLE, 0.875) AS c FROM timed WHERE us < (SELECT c FROM outer_cut)),
    past AS (SELECT DISTINCT o_custkey, o_orderpriority FROM timed WHERE us < (SELECT c FROM outer_cut)),
    inner_past AS (SELECT DISTINCT o_custkey, o_orderpriority FROM timed WHERE us < (SELECT c FROM inner_cut)),
    sides AS (SELECT o_orderkey, CASE WHEN us < (SELECT c FROM inner_cut) THEN 'train'
        WHEN us < (SELECT c FROM outer_cut) THEN CASE WHEN (o_custkey, o_orderpriority) IN (SELECT o_custkey, o_orderpriority FROM inner_past) THEN 'dropped' ELSE 'valid' END
        WHEN (o_custkey, o_orderpriority) IN (SELECT o_custkey, o_orderpriority FROM past) THEN 'dropped' ELSE 'test' END AS split FROM timed)"""


def temporal(r: Roles) -> DataFrame:
    orders = r.table("orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return S.temporal_split(orders, ["o_custkey", "o_orderpriority"], "o_orderdate")


@query("M9_temporal_split", f"WITH {TEMPORAL_SQL} SELECT o_orderkey, split FROM sides")
def m9(r: Roles) -> DataFrame:
    return temporal(r).select("o_orderkey", "split")


@query("M10_entity_split", f"""
    WITH ordered AS (SELECT o_custkey, row_number() OVER (ORDER BY {hash_sql(K.SEED, 'o_custkey')}) - 1 AS p, count(*) OVER () AS n
                     FROM (SELECT DISTINCT o_custkey FROM orders))
    SELECT o_orderkey, CASE WHEN p < floor(0.2::DOUBLE * n) THEN 'test' WHEN p < floor((0.2::DOUBLE + 0.1::DOUBLE) * n) THEN 'valid' ELSE 'train' END AS split
    FROM orders JOIN ordered USING (o_custkey)""")
def m10(r: Roles) -> DataFrame:
    return S.entity_split(r.table("orders", "o_orderkey", "o_custkey"), ["o_custkey"]).select("o_orderkey", "split")


@query("M10_deploy_split", f"""
    WITH ordered AS (SELECT o_custkey, row_number() OVER (ORDER BY {hash_sql(K.SEED, 'o_custkey')}) - 1 AS p, count(*) OVER () AS n
                     FROM (SELECT DISTINCT o_custkey FROM orders))
    SELECT o_orderkey, CASE WHEN p < floor(0.1::DOUBLE * n) THEN 'valid' ELSE 'train' END AS split
    FROM orders JOIN ordered USING (o_custkey)""")
def m10_deploy(r: Roles) -> DataFrame:
    return S.deploy_split(r.table("orders", "o_orderkey", "o_custkey"), ["o_custkey"]).select("o_orderkey", "split")


@query("M11_split_sizes", f"WITH {TEMPORAL_SQL} SELECT split, count(*) AS rows FROM sides GROUP BY 1")
def m11(r: Roles) -> DataFrame:
    return S.split_sizes(temporal(r))


@query("M15_rank_average", f"""
    SELECT o_orderkey, round(({rank_sql('pred_sum')} + {rank_sql('pred_lines')}) / (2 * (SELECT count(*) FROM predictions)), 9) AS ensemble
    FROM predictions""", "predictions")
def m15(r: Roles) -> DataFrame:
    return rounded(V.rank_average(r.predictions(), ["pred_sum", "pred_lines"]).select("o_orderkey", "ensemble"), "ensemble", digits=9)


def split_vectors(r: Roles) -> DataFrame:
    """Vectors with the random split by company."""
    return materialize(S.entity_split(r.vectors(), ["company_id"]), "split-vectors")


@query("M17_knn_baseline", f"""
    WITH ordered AS (SELECT company_id, row_number() OVER (ORDER BY {hash_sql(K.SEED, 'company_id')}) - 1 AS p, count(*) OVER () AS n
                     FROM (SELECT DISTINCT company_id FROM vectors)),
    sided AS (SELECT v.*, CASE WHEN p < floor(0.2::DOUBLE * n) THEN 'test' WHEN p < floor((0.2::DOUBLE + 0.1::DOUBLE) * n) THEN 'valid' ELSE 'train' END AS split
              FROM vectors v JOIN ordered USING (company_id)),
    scored AS (SELECT q.release_id AS query_id, c.release_id, c.pv_score,
                      round(list_dot_product(q.embedding, c.embedding) + 0.04 * (q.category IS NOT DISTINCT FROM c.category)::INT
                            + 0.04 * (q.place IS NOT DISTINCT FROM c.place)::INT, {SCORE_DECIMALS}) AS score
               FROM sided q, sided c WHERE q.split = 'test' AND c.split = 'train'),
    {top_sql(20)}
    SELECT query_id, round(median(pv_score), 9) AS plan_score FROM top GROUP BY 1""", "vectors")
def m17(r: Roles) -> DataFrame:
    rows = split_vectors(r)
    test = rows.where("split = 'test'").withColumnRenamed("release_id", "query_id")
    scored = V.knn_baseline(test, rows.where("split = 'train'"), "query_id", KEY)
    return rounded(scored, "plan_score", digits=9)


LIFT_SQL = """results AS (
    SELECT l_orderkey AS case_id, l_returnflag AS arm, any_value(o_totalprice) / 10000 AS before, sum(l_extendedprice) / 10000 AS after,
           count(*) AS suggestions, count(DISTINCT l_suppkey) AS covered, count(*) FILTER (WHERE l_discount = 0) AS leaks
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def lift_results(r: Roles) -> DataFrame:
    lines = r.table("lineitem", "l_orderkey", "l_returnflag", "l_extendedprice", "l_suppkey", "l_discount")
    orders = r.table("orders", "o_orderkey", "o_totalprice")
    return (
        lines.groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("arm"))
        .agg(
            (F.sum("l_extendedprice") / 10000).alias("after"),
            F.count(F.lit(1)).alias("suggestions"),
            F.count_distinct("l_suppkey").alias("covered"),
            F.count_if(F.col("l_discount") == 0).alias("leaks"),
        )
        .join(orders, F.col("case_id") == F.col("o_orderkey"))
        .withColumn("before", F.col("o_totalprice") / 10000)
    )


@query("A29_lift_report", f"""
    WITH {LIFT_SQL}
    SELECT arm, count(*) AS n, round(avg((after > before)::INT), 6) AS win_rate, round(avg(suggestions), 6) AS suggestions_per_case,
           round(avg(covered), 6) AS covered_per_case, sum(leaks)::BIGINT AS leaks, round(median(before), 6) AS before_median,
           round(median(after), 6) AS after_median, round(median(after - before), 6) AS lift_median
    FROM results GROUP BY 1""")
def a29(r: Roles) -> DataFrame:
    report = V.lift_report(lift_results(r), ["case_id"])
    return rounded(report, "win_rate", "suggestions_per_case", "covered_per_case", "before_median", "after_median", "lift_median")


@query("A29_arm_difference", f"""
    WITH {LIFT_SQL}, gaps AS (SELECT (a.after - a.before) - (b.after - b.before) AS gap FROM results a JOIN results b USING (case_id)
                              WHERE a.arm = 'R' AND b.arm = 'N')
    SELECT count(*) AS cases, round(avg((gap > 0)::INT), 6) AS win_rate, round(median(gap), 6) AS median_gap FROM gaps""")
def a29_pair(r: Roles) -> DataFrame:
    return rounded(V.arm_difference(lift_results(r), ["case_id"], "R", "N"), "win_rate", "median_gap")


@query("A29_coverage_count", """
    SELECT draft_id, count(DISTINCT code) AS covered FROM (
        SELECT draft_id, CASE WHEN list_contains(fill_unavailable, code) THEN code END AS code
        FROM (SELECT draft_id, fill_unavailable, unnest(['place', 'people', 'place', 'novelty']) AS code FROM drafts)) GROUP BY 1""",
    "drafts")
def a29_coverage(r: Roles) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in ("place", "people", "place", "novelty")])
    suggestions = r.drafts().select("draft_id", "fill_unavailable", F.explode(codes).alias("code"))
    return V.coverage_count(suggestions, ["draft_id"], "code", "fill_unavailable")


@query("M1_features", """
    SELECT release_id, (len(embedding) + 3)::INTEGER AS width, category::DOUBLE AS category, coalesce(place, 0)::DOUBLE AS place,
           regexp_matches(title, '誕生|オープン|グランド|リニューアル|開設|店舗|ショップ|拠点')::INT::DOUBLE AS presence
    FROM vectors""", "vectors")
def m1(r: Roles) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    built = M.features(r.vectors()).select("release_id", vector_to_array("features").alias("f"))
    return built.select(
        "release_id", F.size("f").alias("width"), F.col("f")[64].alias("category"), F.col("f")[65].alias("place"), F.col("f")[66].alias("presence")
    )


@query("M2_encoded_width", """
    SELECT release_id, (64 + (SELECT max(category) + 1 FROM vectors) + (SELECT max(coalesce(place, 0)) + 1 FROM vectors) + 1)::INTEGER AS width,
           3.0::DOUBLE + 0 AS ones
    FROM vectors WHERE false UNION ALL
    SELECT release_id, (64 + (SELECT max(category) + 1 FROM vectors) + (SELECT max(coalesce(place, 0)) + 1 FROM vectors) + 1)::INTEGER,
           2.0::DOUBLE FROM vectors""", "vectors")
def m2(r: Roles) -> DataFrame:
    """Width of the encoded rows, and the sum of their one-hot part (one class each)."""
    from pyspark.ml.functions import vector_to_array

    rows = r.vectors()
    encoded = M.encode(rows, M.fit_encoder(rows)).select("release_id", vector_to_array("dense").alias("d"))
    hot = F.slice("d", 65, F.size("d") - 65)
    return encoded.select(
        "release_id", F.size("d").alias("width"), F.aggregate(hot, F.lit(0.0), lambda a, x: a + x).alias("ones")
    )


def learning_rows(r: Roles) -> DataFrame:
    """Feature rows with their split, stored once because every fit passes over them many times."""
    return materialize(M.features(split_vectors(r)).select(
        "release_id", "company_id", "pv_score", "split", "features", "embedding", "category", "place", "title"
    ), "features")


def metrics_of(scored: DataFrame, model: str) -> DataFrame:
    """Error per split of a fitted model beside the error of the mean of the training rows."""
    mean = scored.where("split = 'train'").agg(F.avg("pv_score")).scalar()
    return V.rmse(V.melt_models(scored.withColumn("mean", mean), [model, "mean"], ["split", "pv_score"]), "pred", "pv_score", ["split", "model"])


SPLIT_ROWS = f"""
    ordered AS (SELECT company_id, row_number() OVER (ORDER BY {hash_sql(K.SEED, 'company_id')}) - 1 AS p, count(*) OVER () AS n
                FROM (SELECT DISTINCT company_id FROM vectors)),
    sides AS (SELECT CASE WHEN p < floor(0.2::DOUBLE * n) THEN 'test' WHEN p < floor((0.2::DOUBLE + 0.1::DOUBLE) * n) THEN 'valid' ELSE 'train' END AS split
              FROM vectors JOIN ordered USING (company_id))"""
FACTS_SQL = f"WITH {SPLIT_ROWS} SELECT split, count(*) AS rows, true AS within, CASE split WHEN 'train' THEN true END AS better FROM sides GROUP BY split"


def facts_of(scored: DataFrame, model: str) -> DataFrame:
    """What holds of any good model: a prediction between 0 and 1 for every row, and on its training rows less error than their mean."""
    scored = materialize(scored.select("split", "pv_score", model), "scored")
    mean = scored.where("split = 'train'").agg(F.avg("pv_score")).scalar()
    error, plain = F.col(model) - F.col("pv_score"), F.col("mean") - F.col("pv_score")
    return scored.withColumn("mean", mean).groupBy("split").agg(
        F.count(model).alias("rows"),
        F.bool_and(F.col(model).between(0, 1)).alias("within"),
        F.when(F.col("split") == "train", F.sum(error * error) < F.sum(plain * plain)).alias("better"),
    )


@query("M12_boosted_trees", FACTS_SQL, "vectors")
def m12(r: Roles) -> DataFrame:
    """Boosting with all its rounds and patience."""
    rows = learning_rows(r)
    return facts_of(M.predict(M.fit_gbt(rows), rows, "gbt"), "gbt")


@query("M13_random_forest", FACTS_SQL, "vectors")
def m13(r: Roles) -> DataFrame:
    rows = learning_rows(r)
    return facts_of(M.predict(M.fit_forest(rows), rows, "forest"), "forest")


@query("M14_ridge")
def m14(r: Roles) -> DataFrame:
    rows = learning_rows(r)
    encoded = M.encode(rows, M.fit_encoder(rows.where("split = 'train'")))
    model, _ = M.fit_ridge(encoded)
    return metrics_of(M.predict(model, encoded, "ridge"), "ridge")


@query("M14_two_features", f"""
    WITH ordered AS (SELECT company_id, row_number() OVER (ORDER BY {hash_sql(K.SEED, 'company_id')}) - 1 AS p, count(*) OVER () AS n
                     FROM (SELECT DISTINCT company_id FROM vectors)),
    train AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, pv_score AS y FROM vectors JOIN ordered USING (company_id)
              WHERE p >= floor((0.2::DOUBLE + 0.1::DOUBLE) * n)),
    sums AS (SELECT count(*) * var_pop(a) + 10 AS aa, count(*) * var_pop(b) + 10 AS bb, count(*) * covar_pop(a, b) AS ab,
                    count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS by_ FROM train)
    SELECT round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 9) AS first, round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 9) AS second
    FROM sums""", "vectors")
def m14_two(r: Roles) -> DataFrame:
    """Ridge coefficients of two features beside the solution of the normal equations."""
    pair = array_to_vector(F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 2))
    model, _ = M.fit_ridge(split_vectors(r).withColumn("dense", pair), alphas=(10.0,))
    found = [tuple(float(x) for x in model.coefficients)]
    return rounded(r.spark.createDataFrame(found, "first double, second double"), "first", "second", digits=9)


@query("M16_predictions")
def m16(r: Roles) -> DataFrame:
    rows = learning_rows(r)
    encoded = M.encode(rows, M.fit_encoder(rows.where("split = 'train'")))
    model, _ = M.fit_ridge(encoded)
    return M.predict(model, encoded, "ridge").select("release_id", "split", F.round("ridge", 6).alias("ridge"))


@query("M16_prediction_facts", FACTS_SQL, "vectors")
def m16_facts(r: Roles) -> DataFrame:
    rows = learning_rows(r)
    encoded = M.encode(rows, M.fit_encoder(rows.where("split = 'train'")))
    model, _ = M.fit_ridge(encoded)
    return facts_of(M.predict(model, encoded, "ridge"), "ridge")


@query("M18_acceptance_table")
def m18(r: Roles) -> DataFrame:
    return acceptance(r)


@query("M18_rank_facts", f"""
    WITH {SPLIT_ROWS} SELECT scorer, count(*) AS rows, true AS same FROM sides, (SELECT unnest(['knn', 'ridge']) AS scorer)
    WHERE split = 'test' GROUP BY scorer""", "vectors")
def m18_facts(r: Roles) -> DataFrame:
    """The stored table's ranks beside those counted anew from its scores: higher ones, and half of the equal ones."""
    table = materialize(acceptance(r), "acceptance")
    found = None
    for scorer in ("knn", "ridge"):
        values = table.groupBy(scorer).agg(F.count(F.lit(1)).alias("equal"))
        above = F.sum("equal").over(Window.orderBy(F.desc(scorer)).rowsBetween(Window.unboundedPreceding, -1))
        counted = table.join(values.withColumn("above", F.coalesce(above, F.lit(0))), scorer)
        rank = F.floor(F.col("above") + (F.col("equal") + 1) / 2)
        part = counted.agg(F.lit(scorer).alias("scorer"), F.count(F.lit(1)).alias("rows"), F.bool_and(F.col(f"{scorer}_rank") == rank).alias("same"))
        found = part if found is None else found.unionByName(part)
    return found


def acceptance(r: Roles) -> DataFrame:
    """Test rows scored by the neighbours and by ridge, ranks side by side."""
    rows = learning_rows(r)
    test = rows.where("split = 'test'")
    encoder = M.fit_encoder(rows.where("split = 'train'"))
    model, _ = M.fit_ridge(M.encode(rows, encoder))
    ridge = M.predict(model, M.encode(test, encoder), "ridge").select(F.col("release_id").alias("query_id"), "ridge")
    knn = V.knn_baseline(test.withColumnRenamed("release_id", "query_id"), rows.where("split = 'train'"), "query_id", KEY)
    return V.acceptance_table(knn.withColumnRenamed("plan_score", "knn").join(ridge, "query_id"), "query_id", ["knn", "ridge"])


@query("M19_saved_run")
def m19(r: Roles) -> DataFrame:
    """A stored and reloaded model with its run data."""
    rows = learning_rows(r)
    encoded = M.encode(rows, M.fit_encoder(rows.where("split = 'train'")))
    (model, alpha), seconds = M.timed(M.fit_ridge, encoded)
    path = fresh_path(r.spark, "run")
    return M.save_run({"ridge": model}, M.predict(model, encoded, "ridge"), path, {"alpha": alpha, "timed": seconds > 0})


@query("M19_reloaded_run", "SELECT release_id, true AS same FROM vectors", "vectors")
def m19_reloaded(r: Roles) -> DataFrame:
    """Every row predicted by the fitted model and by the stored and reloaded encoder and model."""
    rows = learning_rows(r)
    encoder = M.fit_encoder(rows.where("split = 'train'"))
    encoded = M.encode(rows, encoder)
    model, alpha = M.fit_ridge(encoded)
    fitted = M.predict(model, encoded, "ridge")
    path = fresh_path(r.spark, "run")
    M.save_run({"ridge": model}, fitted, path, {"alpha": alpha}, encoder=encoder)
    again = M.predict(M.load_model(r.spark, f"{path}/ridge"), M.encode(rows, M.load_encoder(r.spark, path)), "ridge")
    pairs = fitted.select("release_id", "ridge").join(again.select("release_id", F.col("ridge").alias("again")), "release_id")
    return pairs.select("release_id", F.col("ridge").eqNullSafe(F.col("again")).alias("same"))
