"""Outcomes on a fair scale: regional lift, regional reach, place weight, mid-ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsreach import constants as K
from newsreach.functions.moments import month_of
from newsreach.operators.ranks import HOT_ROWS, midrank
from newsreach.sources.workspace import materialize


def placed_media(base: DataFrame, media: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """Outlets of the cases that have a place."""
    placed = base.where(F.col(place).isNotNull()).select(*keys, place)
    return media.join(placed, list(keys))


def _lift_of(placed: DataFrame, base: DataFrame, place: str, outlet: str) -> DataFrame:
    """Lift from the outlets of the placed cases, read once; all else works on the counts of (place, outlet)."""
    hits = placed.groupBy(place, outlet).agg(F.count(F.lit(1)).alias("hits"))
    overall = F.sum("hits").over(Window.partitionBy(outlet))
    in_place = base.where(F.col(place).isNotNull()).groupBy(place).agg(F.count(F.lit(1)).alias("place_cases"))
    # one row per place, so one task holds them all
    sized = in_place.withColumn("cases", F.sum("place_cases").over(Window.partitionBy()))
    joined = hits.withColumn("outlet_hits", overall).join(sized, place)
    value = (F.col("hits").cast("double") / F.col("place_cases")) / (F.col("outlet_hits").cast("double") / F.col("cases"))
    return joined.select(place, outlet, "hits", value.alias("lift"))


def lift(base: DataFrame, media: DataFrame, keys: Sequence[str], place: str, outlet: str) -> DataFrame:
    """How much more often an outlet appears in a place than overall, per (place, outlet) (A5).

    All counts are map-side combined. Outlet totals come from the (place, outlet) counts, not from a
    second pass over the outlet rows.
    """
    return _lift_of(placed_media(base, media, keys, place), base, place, outlet)


def regional_reach(
    base: DataFrame,
    media: DataFrame,
    keys: Sequence[str],
    place: str,
    outlet: str,
    lift_min: float = K.LIFT_MIN,
) -> DataFrame:
    """Regional outlets per case: those whose lift in the case's place reaches ``lift_min``.

    The outlets of the placed cases are joined once and stored, and so is the list of regional (place, outlet) pairs,
    whose known size lets Spark broadcast it while it is small.
    """
    placed = materialize(placed_media(base, media, keys, place).select(*keys, place, outlet), "placed-media")
    regional = _lift_of(placed, base, place, outlet).where(F.col("lift") >= lift_min).select(place, outlet)
    return (
        placed.join(materialize(regional, "regional-outlets"), [place, outlet], "left_semi")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("regional_reach"))
    )


def regional_media(
    base: DataFrame, media: DataFrame, keys: Sequence[str], place: Sequence[str], outlet: str
) -> DataFrame:
    """Cases per (place, outlet) and their share in the cases of the place.

    The share is high for outlets that republish everything, so it measures the reverse of regionality.
    """
    placed = base.where(F.col(place[0]).isNotNull())
    sizes = placed.groupBy(place[0]).agg(F.count(F.lit(1)).alias("__size"))
    counts = (
        media.join(placed.select(*keys, *place), list(keys))
        .groupBy(*place, outlet)
        .agg(F.count(F.lit(1)).alias("cases"))
    )
    return counts.join(sizes, place[0]).withColumn("share", F.col("cases") / F.col("__size")).drop("__size")


def place_weight(corpus: DataFrame, place: str, regional: str) -> DataFrame:
    """Share of cases with any regional outlet, per place."""
    weight = F.avg((F.col(regional) > 0).cast("int")).alias("regional_weight")
    return corpus.where(F.col(place).isNotNull()).groupBy(place).agg(weight)


def with_place_weight(df: DataFrame, weights: DataFrame, place: str) -> DataFrame:
    """Add the weight of the row's place, or the overall default where it is unknown."""
    return df.join(weights, place, "left").withColumn(
        "regional_weight", F.coalesce("regional_weight", F.lit(K.DEFAULT_REGIONAL_WEIGHT))
    )


def month_midrank(df: DataFrame, at: str, views: str, out: str = "pv_score", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rank of the views among the cases of the same month."""
    return midrank(df.withColumn("__month", month_of(at)), ["__month"], views, out, hot_rows).drop("__month")


def place_midrank(
    df: DataFrame, place: str, regional: str, out: str = "regional_score", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rank of the regional reach among the cases of the same place."""
    return midrank(df, [place], regional, out, hot_rows)


def enrich(
    base: DataFrame,
    text: DataFrame,
    stat: DataFrame,
    media: DataFrame,
    keys: Sequence[str],
    place: str,
    outlet: str,
    at: str = "created_at",
    lift_min: float = K.LIFT_MIN,
) -> DataFrame:
    """Working corpus: base rows with text, views, regional reach and both normalised scores.

    ``text`` has ``subtitle`` and ``body_head``, ``stat`` has ``page_view``; both have one row per key.
    """
    reach = regional_reach(base, media, keys, place, outlet, lift_min)
    joined = materialize(
        base.join(text, list(keys), "left")
        .join(stat, list(keys), "left")
        .join(reach, list(keys), "left")
        .withColumns(
            {
                "subtitle": F.coalesce("subtitle", F.lit("")),
                "body_head": F.coalesce("body_head", F.lit("")),
                "page_view": F.coalesce("page_view", F.lit(0)),
                "regional_reach": F.coalesce("regional_reach", F.lit(0)),
            }
        ),
        "enriched",
    )
    # ranks are computed on narrow rows; the texts are not shuffled for them
    narrow = joined.select(*keys, at, place, "page_view", "regional_reach")
    ranks = place_midrank(month_midrank(narrow, at, "page_view"), place, "regional_reach").select(*keys, "pv_score", "regional_score")
    return joined.join(ranks, list(keys))
