"""Rank metrics, bootstrap intervals and reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsreach import constants as K
from newsreach.operators.effects import melt
from newsreach.operators.ranks import HOT_ROWS, average_rank, avg_rank, hot_keys, join_groups, quantiles, rank_table
from newsreach.operators.splits import entity_groups, fixed_groups
from newsreach.operators.vectors import Bonus, plan_score
from newsreach.sources.workspace import materialize

# Cumulative probabilities of the Poisson distribution with mean 1, up to 12 events.
POISSON_ONE = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
    0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217,
    0.9999999899522336, 0.9999999991683892, 0.9999999999364022,
)


def melt_models(df: DataFrame, models: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per input row and model: ``model``, ``pred`` and the kept columns."""
    return melt(df, models, keep, "model").withColumnRenamed("value", "pred")


def spearman(
    df: DataFrame, pred: str, actual: str, group: Sequence[str] = (), weight: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rank correlation with averaged ties, per group or over all rows (M3).

    Equal (prediction, actual) pairs are merged and stored first, so the rows are read once. Groups of
    bounded size then take windows over the pairs, others the two rank tables of the pairs. The mean rank
    is known in advance, hence one pass of sums gives the coefficient. NULL when a side is constant.
    """
    rows = df.where(F.col(pred).isNotNull() & F.col(actual).isNotNull())
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    pairs = materialize(rows.groupBy(*group, pred, actual).agg(amount.alias("__c")), "pairs")
    if hot_keys(pairs, group, hot_rows) is None:

        def rank(column: str) -> Column:
            upto = F.sum("__c").over(Window.partitionBy(*group).orderBy(column))
            same = F.sum("__c").over(Window.partitionBy(*group, column))
            return upto - same + (same + 1) / 2

        size = F.sum("__c").over(Window.partitionBy(*group))
        ranked = pairs.withColumns({"__p": rank(pred), "n": size}).withColumn("__a", rank(actual))
    else:
        left = rank_table(pairs, group, pred, "__c", hot_rows=hot_rows).select(
            *group, pred, average_rank().alias("__p"), "n"
        )
        right = rank_table(pairs, group, actual, "__c", hot_rows=hot_rows).select(
            *group, actual, average_rank().alias("__a")
        )
        ranked = join_groups(join_groups(pairs, left, [*group, pred]), right, [*group, actual])
    middle = (F.col("n") + 1) / 2
    p, a, c = F.col("__p") - middle, F.col("__a") - middle, F.col("__c")
    sums = ranked.groupBy(*group).agg(
        F.sum(c).alias("rows"),
        F.sum(c * p * a).alias("__pa"),
        F.sum(c * p * p).alias("__pp"),
        F.sum(c * a * a).alias("__aa"),
    )
    spread = F.sqrt(F.col("__pp") * F.col("__aa"))
    return sums.select(*group, "rows", F.try_divide("__pa", spread).alias("spearman"))


def rmse(df: DataFrame, pred: str, actual: str, group: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error (M4)."""
    error = F.col(pred) - F.col(actual)
    return df.groupBy(*group).agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def ndcg_per_group(
    df: DataFrame, group: Sequence[str], pred: str, actual: str, keys: Sequence[str], k: int = K.NDCG_K
) -> DataFrame:
    """NDCG@k of every group with linear gain; 0 where the ideal is 0; equal predictions by key (M5).

    Only the k best rows by prediction and by outcome of a group are needed. Both cuts are ranks with a
    limit, which Spark applies before the shuffle. The narrow rows are stored, as both read them.
    """
    df = materialize(df.select(*dict.fromkeys([*group, *keys, pred, actual])), "judged")
    discount = F.log2(F.col("__r") + 1)

    def dcg(order: list, name: str) -> DataFrame:
        window = Window.partitionBy(*group).orderBy(*order)
        best = df.select(*group, *keys, pred, actual).withColumn("__r", F.row_number().over(window))
        return best.where(F.col("__r") <= k).groupBy(*group).agg(F.sum(F.col(actual) / discount).alias(name))

    by_key = [F.col(key).asc() for key in keys]
    got = dcg([F.col(pred).desc(), *by_key], "__got")
    ideal = dcg([F.col(actual).desc(), *by_key], "__ideal")
    value = F.when(F.col("__ideal") > 0, F.col("__got") / F.col("__ideal")).otherwise(F.lit(0.0))
    return join_groups(got, ideal, group).select(*group, value.alias("ndcg"))


def grouped_ndcg(
    df: DataFrame, group: Sequence[str], pred: str, actual: str, keys: Sequence[str], k: int = K.NDCG_K,
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean NDCG@k over groups, 0 without any group (M5)."""
    per_group = ndcg_per_group(df, [*by, *group], pred, actual, keys, k)
    return per_group.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg")
    )


def ndcg_of_models(
    df: DataFrame, group: Sequence[str], models: Sequence[str], actual: str, keys: Sequence[str], k: int = K.NDCG_K
) -> DataFrame:
    """Mean NDCG@k over groups of bounded size for several models (M8): ``model``, ``ndcg``. The figures of ``grouped_ndcg``.

    A group travels once, for all models and the ideal; each task ranks its groups in every order.
    """
    by_key = [F.col(key).asc() for key in keys]
    columns = [actual, *models]
    ranks = {
        f"__r{i}": F.row_number().over(Window.partitionBy(*group).orderBy(F.col(c).cast("double").desc() if i else F.col(c).desc(), *by_key))
        for i, c in enumerate(columns)
    }

    def dcg(i: int) -> Column:
        return F.sum(F.when(F.col(f"__r{i}") <= k, F.col(actual) / F.log2(F.col(f"__r{i}") + 1)))

    gains = df.select(*dict.fromkeys([*group, *keys, *columns])).withColumns(ranks).groupBy(*group).agg(*[dcg(i).alias(f"__g{i}") for i in range(len(columns))])
    shares = [F.when(F.col("__g0") > 0, F.col(f"__g{i}") / F.col("__g0")).otherwise(F.lit(0.0)).alias(model) for i, model in enumerate(models, 1)]
    means = gains.select(*shares).agg(*[F.coalesce(F.avg(model), F.lit(0.0)).alias(model) for model in models])
    return melt(means, models, name="model").withColumnRenamed("value", "ndcg")


def bootstrap_draws(seed: int, keys: Sequence[str], rounds: int) -> Column:
    """Array of (round, w) with a Poisson(1) weight per round, from a hash of seed, round and key."""

    def weigh(number: Column) -> Column:
        text = F.concat_ws(":", F.lit(str(seed)), number.cast("string"), *[F.col(k).cast("string") for k in keys])
        uniform = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)

        def count(u: Column) -> Column:
            weight = F.lit(0)
            for limit in POISSON_ONE:
                weight = weight + (u >= limit).cast("int")
            return F.struct(number.alias("round"), weight.alias("w"))

        # the hash is bound to a variable, so that it is computed once and not once per limit
        return F.transform(F.array(uniform), count)[0]

    return F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), weigh)


# Weights (rows x rounds) that one task holds at once, and rounds of a block at most
BOOTSTRAP_CELLS = 2_000_000
BLOCK_ROUNDS = 100


def bootstrap_gap(
    df: DataFrame, first: str, second: str, actual: str, keys: Sequence[str], rounds: int = K.BOOTSTRAP_ROUNDS,
    seed: int = 0, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """95 % interval of the difference of two rank correlations under paired resampling (M7).

    In every round each row counts Poisson(1) times (13 times at most, beyond which lies one draw in 10^10), the
    distributed form of drawing n rows with replacement. Both models see the same draw. A draw depends on seed, round and key only,
    so a lost task repeats it exactly.

    A row carries the weights of a block of rounds as one array of bytes; rows with equal predictions and outcome are added up
    before the shuffle. A block of rounds is one group, whose ranks are running sums of the arrays along the
    values. Beyond ``hot_rows`` rows, a row is expanded once per round and each round ranked by itself.
    """
    narrow = materialize(df.where(F.col(actual).isNotNull()).select(*dict.fromkeys([*keys, first, second, actual])), "resampled")
    rows = narrow.count()
    scores = _scores_by_block if rows <= hot_rows else _scores_by_round
    gaps = scores(narrow, first, second, actual, keys, rounds, seed, rows)
    return quantiles(gaps, [], "gap", {"low": 0.025, "high": 0.975}).withColumnRenamed("n", "rounds")


def _scores_by_round(
    df: DataFrame, first: str, second: str, actual: str, keys: Sequence[str], rounds: int, seed: int, rows: int
) -> DataFrame:
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = (
        df.repartition(spread, *keys)  # every row becomes `rounds` rows, so even a short table is worth spreading
        .select(first, second, actual, F.inline(bootstrap_draws(seed, keys, rounds)))
        .where(F.col("w") > 0)
    )
    long = melt_models(drawn, [first, second], ["round", actual, "w"])
    scores = spearman(long, "pred", actual, ["round", "model"], "w")
    return scores.groupBy("round").agg(
        (
            F.max(F.when(F.col("model") == first, F.col("spearman")))
            - F.max(F.when(F.col("model") == second, F.col("spearman")))
        ).alias("gap")
    )


def _scores_by_block(
    df: DataFrame, first: str, second: str, actual: str, keys: Sequence[str], rounds: int, seed: int, rows: int
) -> DataFrame:
    width = int(min(BLOCK_ROUNDS, max(1, BOOTSTRAP_CELLS // max(rows, 1)), rounds))
    key = F.concat_ws(":", F.lit(""), *[F.col(k).cast("string") for k in keys])
    names = ["x", "y", "a"]
    values = [F.col(c).cast("double") for c in (first, second, actual)]
    # NULL and NaN are one in numpy, so what is missing is said apart.
    plain = df.select(
        key.alias("key"), *[F.coalesce(v, F.lit(0.0)).alias(n) for v, n in zip(values, names)],
        *[F.col(c).isNull().alias(f"no_{n}") for c, n in ((first, "x"), (second, "y"))],
    )
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limits, kinds = np.array(POISSON_ONE), [*names, "no_x", "no_y"]
        for batch in batches:
            for start in range(0, len(batch), 2000):
                part = batch.iloc[start : start + 2000]
                same = part.groupby(kinds, sort=False, dropna=False).ngroup().to_numpy()
                once = part[kinds].iloc[np.unique(same, return_index=True)[1]]
                tails = [x.encode() for x in part["key"]]
                for low in range(0, rounds, width):
                    heads = [f"{seed}:{i}".encode() for i in range(low, min(low + width, rounds))]
                    digests = b"".join([md5(head + tail).digest()[:4] for tail in tails for head in heads])
                    uniform = np.frombuffer(digests, ">u4").astype(np.float64) / 2.0**32
                    weights = np.searchsorted(limits, uniform, "right").reshape(len(part), len(heads))
                    total = np.zeros((len(once), len(heads)), "<u2")
                    np.add.at(total, same, weights.astype("<u2"))
                    yield once.assign(block=low, weights=[x.tobytes() for x in total])

    def ranks(order: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Mean ranks of all rows in every round: weights of smaller values and the middle of the equal ones."""
        same = np.add.reduceat(weights[order], starts, axis=0)
        found = np.cumsum(same, axis=0) - same + (same + 1) / 2
        out = np.empty(weights.shape)
        out[order] = np.repeat(found, np.diff(np.r_[starts, len(order)]), axis=0)
        return out

    def score(block: pd.DataFrame) -> pd.DataFrame:
        weights = np.frombuffer(b"".join(block["weights"]), "<u2").reshape(len(block), -1).astype(np.float64)
        number = np.arange(weights.shape[1])
        out = []
        for name in ("x", "y"):
            kept = ~block[f"no_{name}"].to_numpy(bool)
            w = weights[kept]
            middle = (w.sum(axis=0) + 1) / 2
            centred = []
            for column in (name, "a"):
                v = block[column].to_numpy(np.float64)[kept]
                order = np.argsort(v, kind="stable")
                ordered = v[order]
                new = (ordered[1:] != ordered[:-1]) & ~(np.isnan(ordered[1:]) & np.isnan(ordered[:-1]))
                centred.append(ranks(order, np.flatnonzero(np.r_[True, new]), w) - middle if len(v) else w)
            p, a = centred
            spread_of = np.sqrt((w * p * p).sum(axis=0) * (w * a * a).sum(axis=0))
            with np.errstate(invalid="ignore", divide="ignore"):
                out.append(np.where(spread_of > 0, (w * p * a).sum(axis=0) / spread_of, np.nan))
        return pd.DataFrame({"round": number + block["block"].iloc[0], "gap": out[0] - out[1]})

    drawn = plain.repartition(spread, "key").mapInPandas(
        draw, "x double, y double, a double, no_x boolean, no_y boolean, block long, weights binary"
    )
    scored = drawn.groupBy("block").applyInPandas(score, "round long, gap double")
    return scored.withColumn("gap", F.when(~F.isnan("gap"), F.col("gap")))


def metric_report(
    df: DataFrame, models: Sequence[str], actual: str, entity: Sequence[str], keys: Sequence[str], k: int = K.NDCG_K,
    size: int = K.GROUP_SIZE, min_rows: int = K.ENTITY_MIN_ROWS, seed: int = 0,
) -> DataFrame:
    """All metrics of several models on the same rows, one row per model (M8). The narrow rows are computed once."""
    keep = [*dict.fromkeys([*keys, *entity]), actual]
    df = materialize(df.select(*dict.fromkeys([*keep, *models])), "reported")
    rows = melt_models(df, models, keep)
    large = melt_models(entity_groups(df, entity, min_rows), models, keep)
    by_random = ndcg_of_models(fixed_groups(df, keys, size, seed), ["group_id"], models, actual, keys, k).withColumnRenamed("ndcg", "ndcg_random")
    by_entity = grouped_ndcg(large, entity, "pred", actual, keys, k, ["model"]).select(
        "model", F.col("ndcg").alias("ndcg_entity"), F.col("groups").alias("entity_groups")
    )
    return (
        spearman(rows, "pred", actual, ["model"])
        .join(rmse(rows, "pred", actual, ["model"]), "model")
        .join(by_random, "model", "left")
        .join(by_entity, "model", "left")
        .withColumns(
            {
                "ndcg_random": F.coalesce("ndcg_random", F.lit(0.0)),
                "ndcg_entity": F.coalesce("ndcg_entity", F.lit(0.0)),
                "entity_groups": F.coalesce("entity_groups", F.lit(0)),
            }
        )
    )


def rank_average(df: DataFrame, columns: Sequence[str], out: str = "ensemble") -> DataFrame:
    """Mean of the ranks of several predictions, scaled to 0..1."""
    df = ranked = materialize(df, "averaged")
    for position, column in enumerate(columns):
        ranked = avg_rank(ranked, column, f"__r{position}")
    total = sum((F.col(f"__r{i}") for i in range(1, len(columns))), F.col("__r0"))
    size = df.agg(F.count(F.lit(1))).scalar()
    names = [f"__r{i}" for i in range(len(columns))]
    return ranked.withColumn(out, total / (len(columns) * size)).drop(*names)


def knn_baseline(
    test: DataFrame, train: DataFrame, query_id: str, keys: Sequence[str], score: str = "pv_score", k: int = K.NEIGHBORS
) -> DataFrame:
    """Neighbour score of test rows from train rows only; missing classes agree with each other."""
    return plan_score(test, train, query_id, keys, score, k, Bonus(null_matches_null=True))


def acceptance_table(scores: DataFrame, label: str, scorers: Sequence[str]) -> DataFrame:
    """Scores of several scorers side by side with their ranks, best = 1, ties share the mean rank."""
    table = scores
    for scorer in scorers:
        ranked = avg_rank(table.withColumn("__neg", -F.col(scorer)), "__neg", f"{scorer}_rank").drop("__neg")
        table = ranked.withColumn(f"{scorer}_rank", F.floor(f"{scorer}_rank").cast("int"))
    return table.select(label, *scorers, *[f"{s}_rank" for s in scorers])


def lift_report(results: DataFrame, case: Sequence[str]) -> DataFrame:
    """Before/after report per arm.

    ``results`` has one row per case and arm: ``arm, before, after, suggestions, covered, leaks``; the
    control arm (neutral text) is simply one more arm. Win = after is strictly higher.
    """
    lifted = results.withColumn("lift", F.col("after") - F.col("before"))
    sums = lifted.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("lift") > 0).cast("int")).alias("win_rate"),
        F.avg("suggestions").alias("suggestions_per_case"),
        F.avg("covered").alias("covered_per_case"),
        F.sum("leaks").alias("leaks"),
    )
    long = melt(lifted, ["before", "after", "lift"], ["arm"])
    medians = quantiles(long, ["arm", "metric"], "value", {"median": 0.5})
    wide = medians.groupBy("arm").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("median"))).alias(f"{m}_median") for m in ("before", "after", "lift")]
    )
    return sums.join(wide, "arm")


def arm_difference(results: DataFrame, case: Sequence[str], head: str, tail: str) -> DataFrame:
    """Paired comparison of two arms on the same cases: median difference and share of wins."""
    lift = F.col("after") - F.col("before")
    paired = results.groupBy(*case).agg(
        F.max(F.when(F.col("arm") == head, lift)).alias("a"), F.max(F.when(F.col("arm") == tail, lift)).alias("b")
    )
    gaps = paired.where("a IS NOT NULL AND b IS NOT NULL").withColumn("gap", F.col("a") - F.col("b"))
    middle = quantiles(gaps, [], "gap", {"median": 0.5}).select("median")
    return gaps.agg(
        F.count(F.lit(1)).alias("cases"), F.avg((F.col("gap") > 0).cast("int")).alias("win_rate")
    ).withColumn("median_gap", middle.scalar())


def coverage_count(suggestions: DataFrame, case: Sequence[str], code: str, open_codes: str) -> DataFrame:
    """Distinct open fields that the suggestions of a case address."""
    hit = F.array_contains(open_codes, F.col(code))
    pairs = suggestions.select(*case, F.when(hit, F.col(code)).alias("__code")).distinct()
    return pairs.groupBy(*case).agg(F.count("__code").alias("covered"))
