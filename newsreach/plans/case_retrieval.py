"""Cases for a table of queries: search, re-rank, distinctive outlets (V6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsreach import constants as K
from newsreach.operators import vectors as V
from newsreach.sources.workspace import materialize


def case_bundle(
    queries: DataFrame,
    corpus: DataFrame,
    media: DataFrame,
    frequency: DataFrame,
    total: DataFrame,
    query_id: str,
    keys: Sequence[str],
    outlet: str,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per query: its cases with their outlets as an array of structs, and the outlets overall.

    ``queries`` carry ``open_count``, the number of open fields of their draft. Three times as many cases
    as wanted are fetched, so that the re-ranking has something to choose from.
    """
    columns = list(dict.fromkeys(["category", "place", *carry]))
    fetched = V.search(queries, corpus, query_id, keys, K.SEARCH_TOP_K * K.FETCH_MULTIPLIER, columns)
    wanted = queries.select(
        query_id, "open_count", F.col("category").alias("__q_category"), F.col("place").alias("__q_place")
    )
    matches = {"category": ("__q_category", "category"), "place": ("__q_place", "place")}
    kept = materialize(V.rerank(fetched.join(wanted, query_id), query_id, matches, "open_count"), "cases")
    by_case, by_set = V.distinctive(kept, media, frequency, total, query_id, keys, outlet)

    def names(found: DataFrame, group: Sequence[str], out: str) -> DataFrame:
        # at most OUTLETS_PER_CASE or OUTLETS_OVERALL entries per group
        listed = F.sort_array(F.collect_list(F.struct("rank", outlet)))
        return found.groupBy(*group).agg(F.transform(listed, lambda x: x[outlet]).alias(out))

    cases = kept.join(names(by_case, [query_id, *keys], "media"), [query_id, *keys], "left")
    # at most SEARCH_TOP_K entries per query
    bundle = cases.groupBy(query_id).agg(
        F.sort_array(F.collect_list(F.struct("new_rank", *keys, *carry, "lifted", "media"))).alias("cases")
    )
    return bundle.join(names(by_set, [query_id], "media"), query_id, "left")
