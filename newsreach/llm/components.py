"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsreach.sources.workspace import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b: long); the root is the smallest node of the component.

    Alternates two steps until nothing changes: every node links its larger neighbours to its smallest neighbour,
    then every node links its smaller neighbours to the smallest of them. Rounds grow with the logarithm of the
    size. Each round is written to the shared folder. Minima are combined before the shuffle, so a hub costs no
    more than its edges; self-loops and repeated edges do no harm, and no edges give no rows.
    """
    links = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links"
    )
    state = None
    while True:
        both = links.union(links.select("b", "a"))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a")
        links = materialize(
            small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(lowest.select("a", F.col("low").alias("b"))).where("a <> b").distinct(),
            "links",
        )
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = seen
