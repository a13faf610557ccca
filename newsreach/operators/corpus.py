"""Corpus selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsreach import constants as K


def candidates(df: DataFrame, since: str = K.SINCE, at: str = "created_at", reach: str = "reach") -> DataFrame:
    """Rows recent enough, with positive reach and a title (F1)."""
    return df.where((F.col(at) >= F.lit(since).cast(df.schema[at].dataType)) & (F.col(reach) > 0) & (F.col("title") != ""))


def _first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    # rank <= 1 lets Spark cut every group map-side (WindowGroupLimit), so a hot key stays cheap
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= 1).drop("__rank")


def primary_location(
    df: DataFrame, keys: Sequence[str], place: str = "prefecture_id", city: str = "city_id"
) -> DataFrame:
    """One location per key: rows with a city first, then the lowest place and city id."""
    order = [F.col(city).isNull().asc(), F.col(place).asc_nulls_last(), F.col(city).asc_nulls_last()]
    return _first_per_key(df.select(*keys, place, city), keys, order)


def primary_category(df: DataFrame, keys: Sequence[str], category: str = "business_category_id") -> DataFrame:
    """Lowest category per key (W2). NULL loses against any id, so a minimum is all it takes."""
    return df.groupBy(*keys).agg(F.min(category).alias(category))


def stratified_top(
    df: DataFrame, strata: Sequence[str], reach: str, keys: Sequence[str], n: int = K.PER_STRATUM
) -> DataFrame:
    """The ``n`` rows of largest reach in every stratum; NULL is a stratum of its own.

    Key columns settle ties. The limit is pushed below the shuffle, so a stratum that holds much of the
    table sends ``n`` rows per task.
    """
    order = [F.col(reach).desc_nulls_last(), *[F.col(key).asc_nulls_last() for key in keys]]
    window = Window.partitionBy(*strata).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= n).drop("__rank")


def left_enrich(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of a table with at most one row per key."""
    return df.join(other, list(keys), "left")


def add_names(df: DataFrame, dimensions: Mapping[str, DataFrame]) -> DataFrame:
    """Star lookup: left join every dimension on its id column.

    Sizes are left to AQE: a small dimension becomes a broadcast once it has been measured.
    """
    for key, dimension in dimensions.items():
        df = df.join(dimension, key, "left")
    return df


def fetch_by_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in a key list."""
    return df.join(keys.select(*on), list(on), "left_semi")


def not_seen_before(later: DataFrame, earlier: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Later rows of entities that never occur earlier."""
    return later.join(earlier.select(*entity).distinct(), list(entity), "left_anti")


def assign_group(df: DataFrame, membership: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Give every row the group of its entity."""
    return df.join(membership, list(entity), "left")


def share_within(df: DataFrame, key: str, count: str, sizes: DataFrame, size: str, out: str = "share") -> DataFrame:
    """Divide a count by the size of its group (J6); the group sizes are aggregated once and joined."""
    return df.join(sizes.select(key, size), key, "left").withColumn(out, F.col(count) / F.col(size)).drop(size)


def lookup_name(df: DataFrame, dimension: DataFrame, name: str, code: str, out: str) -> DataFrame:
    """Translate ``name`` into the id ``code`` (or the other way round); NULL when unknown.

    ``dimension`` has the columns ``name`` and ``code``, one row per name.
    """
    renamed = dimension.select(F.col(name).alias(f"__{name}"), F.col(code).alias(out))
    return df.join(renamed, F.col(name) == F.col(f"__{name}"), "left").drop(f"__{name}")


def place_index(prefectures: DataFrame, cities: DataFrame) -> DataFrame:
    """All place names with their kind (O6); both inputs have ``name`` and ``prefecture_id``."""
    columns = ["kind", "name", "prefecture_id"]
    return prefectures.withColumn("kind", F.lit("prefecture")).select(*columns).unionByName(
        cities.withColumn("kind", F.lit("city")).select(*columns)
    )


def key_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Canonical order of the corpus (O1): a range-partitioned global sort."""
    return df.orderBy(*[F.col(key).asc_nulls_last() for key in keys])
