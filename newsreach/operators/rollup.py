"""Roll-ups, counts and checks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsreach.functions.moments import wall_literal
from newsreach.functions.scoring import log_score
from newsreach.functions.text import text_flags
from newsreach.operators.ranks import quantiles
from newsreach.sources.workspace import materialize


def project_release(
    df: DataFrame,
    start: datetime,
    end: datetime,
    keep: Sequence[str],
    lengths: Sequence[str],
    flags: Sequence[str],
    at: str = "created_at",
) -> DataFrame:
    """One time slice with lengths and presence flags instead of long texts."""
    dtype = df.schema[at].dataType
    part = df.where((F.col(at) >= wall_literal(start, dtype)) & (F.col(at) < wall_literal(end, dtype)))
    derived = [f"{name}_len" for name in lengths] + [f"has_{name}" for name in flags]
    return text_flags(part, lengths, flags).select(*keep, *derived)


def main_rows(df: DataFrame, columns: Sequence[str], flag: str = "main_flg") -> DataFrame:
    """Pruned copy of a table, limited to rows whose main flag is 1 (S3)."""
    return df.where(F.col(flag) == 1).select(*columns)


def exclude_self(df: DataFrame, outlet: str, own: object) -> DataFrame:
    """Drop the publisher's own outlet; a NULL outlet is dropped as well (F2)."""
    return df.where(F.col(outlet) != F.lit(own))


def clip_rollup(log: DataFrame, keys: Sequence[str], outlet: str, own: object, at: str) -> DataFrame:
    """Rows, distinct outlets with and without the own one, first and last date per key (A1).

    Two steps with map-side combine each: per (key, outlet), then per key. A key that holds a large
    share of the log is spread over its outlets first, and no row is multiplied as it would be by
    several ``count(DISTINCT)``.
    """
    pairs = log.groupBy(*keys, outlet).agg(
        F.count(F.lit(1)).alias("__rows"), F.min(at).alias("__first"), F.max(at).alias("__last")
    )
    return pairs.groupBy(*keys).agg(
        F.sum("__rows").alias("clip_rows"),
        F.count(outlet).alias("outlets"),
        F.count_if(F.col(outlet) != F.lit(own)).alias("reach"),
        F.min("__first").alias("first_clip"),
        F.max("__last").alias("last_clip"),
    )


def outlet_set(log: DataFrame, keys: Sequence[str], outlet: str, own: object) -> DataFrame:
    """Distinct outlets per key without the own one."""
    return exclude_self(log, outlet, own).select(*keys, outlet).distinct()


def corpus_report(corpus: DataFrame, entity: str, reach: str, place: str) -> DataFrame:
    """One row: size, entities, reach median and range, rows with a place (A3). The corpus is computed once."""
    corpus = materialize(corpus.select(entity, reach, place), "reported")
    # distinct entities by way of a group-by, so that the row count needs no second pass
    per_entity = corpus.groupBy(entity).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(reach).alias("low"),
        F.max(reach).alias("high"),
        F.count(place).alias("placed"),
    )
    summary = per_entity.agg(
        F.sum("rows").alias("rows"),
        F.count(entity).alias("entities"),
        F.min("low").alias("reach_min"),
        F.max("high").alias("reach_max"),
        F.sum("placed").alias("with_place"),
    )
    middle = quantiles(corpus, [], reach, {"reach_median": 0.5}).select("reach_median")
    return summary.withColumn("reach_median", middle.scalar())


def category_counts(corpus: DataFrame, category: Sequence[str]) -> DataFrame:
    """Cases per category; rows without a category do not count (A4)."""
    return corpus.where(F.col(category[0]).isNotNull()).groupBy(*category).agg(F.count(F.lit(1)).alias("cases"))


def outlet_frequency(media: DataFrame, keys: Sequence[str], outlet: str, unique: bool = False) -> DataFrame:
    """Number of distinct cases per outlet (A9); ``unique`` says that ``media`` holds each pair once."""
    cases = media if unique else media.select(outlet, *keys).distinct()
    return cases.groupBy(outlet).agg(F.count(F.lit(1)).alias("case_count"))


def outlet_total(media: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row with the number of distinct cases, NULL keys included."""
    return media.select(*keys).distinct().agg(F.count(F.lit(1)).alias("case_count"))


def fill_report(corpus: DataFrame, media: DataFrame, body: str, views: str, regional: str, outlet: str) -> DataFrame:
    """One row of fill counts for the corpus and its outlets (A10)."""
    filled = corpus.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(body) != "").alias("bodies"),
        F.count_if(F.col(views) > 0).alias("with_views"),
        F.count_if(F.col(regional) > 0).alias("with_regional"),
    )
    per_outlet = media.groupBy(outlet).agg(F.count(F.lit(1)).alias("rows"))
    # both figures are one subquery, so the outlets are read once
    counted = per_outlet.agg(F.struct(F.sum("rows").alias("rows"), F.count(outlet).alias("outlets"))).scalar()
    both = filled.withColumn("__media", counted)
    return both.select(*filled.columns, F.col("__media.rows").alias("media_rows"), F.col("__media.outlets").alias("media_outlets"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise ``ValueError`` on a repeated key, else give the table back."""
    found = duplicate_keys(df, keys).limit(1).collect()
    if found:
        raise ValueError(f"({', '.join(keys)}) is not unique, for example {found[0].asDict()}")
    return df


def key_parity(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: row counts of two tables and the keys that only one of them has."""
    sides = left.select(*keys, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(
        right.select(*keys, F.lit(0).alias("__l"), F.lit(1).alias("__r"))
    )
    per_key = sides.groupBy(*keys).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
    return per_key.agg(
        F.coalesce(F.sum("__l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("__r"), F.lit(0)).alias("right_rows"),
        F.count_if(F.col("__r") == 0).alias("only_left"),
        F.count_if(F.col("__l") == 0).alias("only_right"),
    )


def assert_same_count(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise ``ValueError`` unless both tables hold the same keys and row count."""
    parity = key_parity(left, right, keys).first().asDict()
    if parity["left_rows"] != parity["right_rows"] or parity["only_left"] or parity["only_right"]:
        raise ValueError(f"tables differ: {parity}")
    return left


def reach_score(df: DataFrame, reach: str, out: str = "reach_score") -> DataFrame:
    """Log-scaled reach relative to the largest reach of the table, which is stored for it."""
    df = materialize(df, "scaled")
    return df.withColumn(out, log_score(reach, df.agg(F.max(reach)).scalar()))


def score_drift(df: DataFrame, at: str, score: str) -> DataFrame:
    """Median of a normalised score per year; far from 0.5 means the normalisation failed."""
    return quantiles(df.withColumn("year", F.year(at)), ["year"], score, {"median_score": 0.5})


def with_share(df: DataFrame, count: Column, name: str = "share") -> DataFrame:
    """Append the share of ``count`` in its total over the whole table, which is stored for it."""
    df = materialize(df, "shared-out")
    return df.withColumn(name, count / df.agg(F.sum(count)).scalar())
