"""Leak-free splits and seeded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsreach import constants as K
from newsreach.operators.ranks import positions, quantiles


def shuffle_key(seed: int, keys: Sequence[str]) -> Column:
    """Seeded pseudo-random text of a row: the same on every run and every cluster."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(key).cast("string") for key in keys]))


def shuffled_position(df: DataFrame, keys: Sequence[str], seed: int, out: str = "position") -> DataFrame:
    """Number rows 0..n-1 in a seeded random order, and add the row count as ``n``.

    A long table is ranked in bands of the hash, so no task sorts it all. ``keys`` must be unique.
    """
    # the bytes of the text have its order in half the space
    return positions(df.withColumn("__hash", F.unhex(shuffle_key(seed, keys))), "__hash", out).drop("__hash")


def entity_split(
    df: DataFrame, entity: Sequence[str], seed: int = K.SEED, test: float = K.TEST_FRACTION, valid: float = K.VALID_FRACTION
) -> DataFrame:
    """Random split by entity: no entity is on two sides (M10). Boundaries truncate like ``int()``."""
    ordered = shuffled_position(df.select(*entity).distinct(), entity, seed)
    test_end = F.floor(F.lit(test) * F.col("n"))
    valid_end = F.floor(F.lit(test + valid) * F.col("n"))
    side = F.when(F.col("position") < test_end, "test").when(F.col("position") < valid_end, "valid").otherwise("train")
    return df.join(ordered.select(*entity, side.alias("split")), list(entity))


def deploy_split(df: DataFrame, entity: Sequence[str], seed: int = K.SEED, valid: float = K.VALID_FRACTION) -> DataFrame:
    """Split for the final model: validation entities only, no test side."""
    return entity_split(df, entity, seed, test=0.0, valid=valid)


def _cut(rows: DataFrame, keep: float) -> Column:
    """Interpolated quantile of the microseconds in ``__us``."""
    return quantiles(rows.select("__us"), [], "__us", {"cut": keep}).select("cut").scalar()


def temporal_split(
    df: DataFrame, entity: Sequence[str], at: str, test: float = K.TEST_FRACTION, valid: float = K.VALID_FRACTION
) -> DataFrame:
    """Train on the past, test on later rows of entities never seen before (M9).

    The cut is the time quantile; a row exactly at the cut is later. The same is repeated inside the
    earlier part for validation. Later rows of known entities are ``dropped``. An entity is known at a
    cut when its first row lies before it, so one minimum per entity decides all sides.
    """
    timed = df.withColumn("__us", F.unix_micros(F.col(at).cast("timestamp")))
    outer = _cut(timed, 1.0 - test)
    pool = timed.select("__us").withColumn("__outer", outer).where(F.col("__us") < F.col("__outer"))
    inner = _cut(pool, 1.0 - valid / (1.0 - test))
    first = timed.groupBy(*entity).agg(F.min("__us").alias("__first"))
    cuts = timed.join(first, list(entity)).withColumns({"__outer": outer, "__inner": inner})
    us, seen = F.col("__us"), F.col("__first")
    side = (
        F.when(us < F.col("__inner"), "train")
        .when((us < F.col("__outer")) & (seen >= F.col("__inner")), "valid")
        .when((us >= F.col("__outer")) & (seen >= F.col("__outer")), "test")
        .otherwise("dropped")
    )
    return cuts.withColumn("split", side).drop("__us", "__first", "__outer", "__inner")


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows per split, dropped ones included."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def fixed_groups(df: DataFrame, keys: Sequence[str], size: int = K.GROUP_SIZE, seed: int = 0) -> DataFrame:
    """Random groups of exactly ``size`` rows; the remainder is dropped."""
    placed = shuffled_position(df, keys, seed)
    group = F.floor(F.col("position") / size)
    return (
        placed.withColumn("group_id", group).where(group < F.floor(F.col("n") / size)).drop("position", "n")
    )


def entity_groups(df: DataFrame, entity: Sequence[str], min_rows: int = K.ENTITY_MIN_ROWS) -> DataFrame:
    """Rows of entities with enough rows to be ranked among themselves (M6)."""
    large = df.groupBy(*entity).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_rows)
    return df.join(large.select(*entity), list(entity), "left_semi")


def sample_rows(
    df: DataFrame, keys: Sequence[str], n: int, seed: int, title: str = "title", min_length: int = K.MIN_TITLE_LENGTH
) -> DataFrame:
    """``n`` random rows whose title is long enough to rebuild a plan from."""
    usable = titled(df, title, min_length)
    return usable.orderBy(shuffle_key(seed, keys), *keys).limit(n)


def titled(df: DataFrame, title: str = "title", min_length: int = K.MIN_TITLE_LENGTH) -> DataFrame:
    """Rows with a title of some length (F7, filter only)."""
    return df.where(F.length(title) >= min_length)

