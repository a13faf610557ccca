"""Approximate nearest neighbours by inner product: robust-pruned directed graphs, one per shard.

Inner products become Euclidean distances by one more component that gives all vectors of a shard the same length.
The graph of a shard is built in growing batches: a greedy search from the entry point proposes neighbours, relaxed
distance pruning keeps diverse edges, edges go both ways and lists that grow too long are pruned again. Queries
visit every shard with a beam search; exact scores in double precision decide among what the beams found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsreach.sources.workspace import materialize

#: Vectors of one graph, about; bounds a task's memory.
SHARD_ROWS = 16384
DEGREE = 32
BEAM = 64
#: Distances are relaxed by this factor before an edge is dropped.
RELAX = 1.2
BATCH = 512
#: Random points a beam begins at besides the middle one, and rows on a search's way that may become neighbours.
ENTRIES = 16
WALKED = 48
FAR_EDGES = 6
#: Width of the beam of a query.
QUERY_BEAM = 128


class Graph:
    """Directed graph over the rows of ``vectors``."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = 3):
        self.original = vectors.astype(np.float64)
        squared = (self.original**2).sum(axis=1)
        self.top = float(squared.max())
        self.points = np.column_stack((self.original, np.sqrt(np.maximum(self.top - squared, 0)))).astype(np.float32)
        self.degree, self.beam = degree, beam
        self.edges = np.full((len(vectors), degree), -1, np.int32)
        order = np.random.default_rng(seed).permutation(len(vectors))
        entry = int(np.argmax(self.points @ self.points.mean(axis=0)))
        order = np.concatenate(([entry], order[order != entry]))
        # A beam begins at the point nearest to the mean and some random ones.
        self.entries, done = order[:ENTRIES].astype(np.int32), 1
        while done < len(order):
            rows = order[done : done + min(BATCH, max(16, done))]
            self.insert(rows)
            done += len(rows)
        # A crowd of close points fills a beam and has few edges out of it; some random edges lead on.
        far = np.random.default_rng(seed + 1).integers(0, len(vectors), (len(vectors), FAR_EDGES))
        self.edges = np.concatenate((self.edges, far.astype(np.int32)), axis=1)

    def distance(self, product: np.ndarray) -> np.ndarray:
        """Squared Euclidean distance of points of equal length from their inner product."""
        return np.maximum(2 * (self.top - product), 0)

    def insert(self, rows: np.ndarray) -> None:
        found, product, walked = self.search(self.points[rows], self.beam, True)
        # What the search passed on its way keeps groups of close points tied to the rest.
        way = np.where(walked >= 0, np.einsum("bd,bkd->bk", self.points[rows], self.points[walked]), -np.inf)
        found, product = np.concatenate((found, walked), axis=1), np.concatenate((product, way), axis=1)
        repeated = np.zeros(found.shape, bool)
        order = np.argsort(found, axis=1, kind="stable")
        ranked = np.take_along_axis(found, order, axis=1)
        np.put_along_axis(repeated, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], axis=1)
        found, product = np.where(repeated, -1, found), np.where(repeated, -np.inf, product)
        # Rows of one batch are not in the graph yet; they propose each other too.
        inner = self.points[rows] @ self.points[rows].T
        np.fill_diagonal(inner, -np.inf)
        near = np.argsort(-inner, axis=1)[:, : min(16, len(rows) - 1)]
        found = np.concatenate((found, rows[near].astype(found.dtype)), axis=1)
        product = np.concatenate((product, np.take_along_axis(inner, near, axis=1)), axis=1)
        self.edges[rows] = self.prune(found, product)
        source = np.repeat(rows, self.degree)
        target = self.edges[rows].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for size in sorted({int(2 ** np.ceil(np.log2(c))) for c in count}):
            mine = np.flatnonzero((count <= size) & (2 * count > size))
            for at in range(0, len(mine), 512):
                some = mine[at : at + 512]
                place = first[some, None] + np.arange(size)
                fresh = np.where(np.arange(size) < count[some, None], source[np.minimum(place, len(source) - 1)], -1)
                self.edges[nodes[some]] = self.joined(nodes[some], fresh)

    def joined(self, nodes: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Edge lists of ``nodes`` with ``fresh`` ones; only lists that are too long lose edges."""
        both = np.concatenate((self.edges[nodes], fresh), axis=1).astype(np.int32)
        # The same neighbour may come from either side.
        ranked = np.sort(both, axis=1)
        ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = -1
        ranked = -np.sort(-ranked, axis=1)
        out = ranked[:, : self.degree].copy()
        full = np.flatnonzero((ranked >= 0).sum(axis=1) > self.degree)
        if len(full):
            product = np.einsum("bd,bkd->bk", self.points[nodes[full]], self.points[ranked[full]])
            out[full] = self.prune(ranked[full], np.where(ranked[full] >= 0, product, -np.inf))
        return out

    def prune(self, found: np.ndarray, product: np.ndarray) -> np.ndarray:
        """Per row at most ``degree`` diverse neighbours, nearest first.

        A neighbour drops all candidates that, even with its distance to them relaxed, lie nearer to it than to the row.
        """
        out = np.full((len(found), self.degree), -1, np.int32)
        for at in range(0, len(found), 128):
            order = np.argsort(-product[at : at + 128], axis=1, kind="stable")
            ids = np.take_along_axis(found[at : at + 128], order, axis=1)
            own = self.distance(np.take_along_axis(product[at : at + 128], order, axis=1))
            points = self.points[ids]
            between = self.distance(points @ points.transpose(0, 2, 1)) * (RELAX * RELAX)
            alive = (ids >= 0) & np.isfinite(own)
            every = np.arange(len(ids))
            for place in range(self.degree):
                chosen = alive.argmax(axis=1)
                some = alive[every, chosen]
                if not some.any():
                    break
                out[at : at + 128][some, place] = ids[every, chosen][some]
                alive &= between[every, chosen] > own
                alive[every, chosen] = False
        return out

    def search(self, queries: np.ndarray, beam: int, inserting: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, inner products) of the beam of each (extended) query, best first, and the rows it came by first; -1 for none."""
        size = len(queries)
        every = np.arange(size)
        entries = self.entries[:1] if inserting and self.edges[self.entries[0], 0] < 0 else self.entries
        if inserting:
            entries = entries[(self.edges[entries, 0] >= 0) | (entries == self.entries[0])]
        ids = np.full((size, beam), -1, np.int32)
        product = np.full((size, beam), -np.inf, np.float32)
        open_ = np.zeros((size, beam), bool)
        first = queries @ self.points[entries].T
        order = np.argsort(-first, axis=1, kind="stable")
        ids[:, : len(entries)], product[:, : len(entries)] = entries[order], np.take_along_axis(first, order, axis=1)
        open_[:, : len(entries)] = True
        seen = np.zeros((size, len(self.points)), bool)
        seen[:, entries] = True
        walked = np.full((size, WALKED), -1, np.int32)
        walked[:, : len(entries)] = ids[:, : len(entries)]
        steps = len(entries)
        active = every
        while len(active):
            best = open_[active].argmax(axis=1)
            node = ids[active, best]
            open_[active, best] = False
            if steps < WALKED:
                walked[active, steps] = node
                steps += 1
            near = self.edges[node]
            # The random edges may repeat a neighbour: the first place counts.
            repeated = (near[:, :, None] == near[:, None, :]) & np.tri(near.shape[1], k=-1, dtype=bool)
            usable = (near >= 0) & ~repeated.any(axis=2) & ~seen[active[:, None], near]
            seen[active[:, None], np.where(near >= 0, near, node[:, None])] = True
            values = np.einsum("bd,bkd->bk", queries[active], self.points[near])
            all_ids = np.concatenate((ids[active], near), axis=1)
            all_values = np.concatenate((product[active], np.where(usable, values, -np.inf)), axis=1)
            all_open = np.concatenate((open_[active], usable), axis=1)
            order = np.argsort(-all_values, axis=1, kind="stable")[:, :beam]
            ids[active] = np.take_along_axis(all_ids, order, axis=1)
            product[active] = np.take_along_axis(all_values, order, axis=1)
            open_[active] = np.take_along_axis(all_open, order, axis=1)
            active = active[open_[active].any(axis=1)]
        ids[~np.isfinite(product)] = -1
        return ids, product, walked

    def nearest(self, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, exact inner product in double precision) of the ``k`` best in each beam, in blocks of queries."""
        for at in range(0, len(queries), 512):
            block = queries[at : at + 512].astype(np.float64)
            extended = np.column_stack((block, np.zeros(len(block)))).astype(np.float32)
            ids, _, _ = self.search(extended, max(QUERY_BEAM, 3 * k))
            exact = np.einsum("bd,bkd->bk", block, self.original[ids])
            exact[ids < 0] = -np.inf
            order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
            exact = np.take_along_axis(exact, order, axis=1)
            row, place = np.nonzero(np.isfinite(exact))
            yield at + row, np.take_along_axis(ids, order, axis=1)[row, place], exact[row, place]


def usable(vector: str) -> Column:
    """Vectors that take part: not NULL, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(table: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found of each row whose key is divisible by ``every``.

    Nearest first, ties to the smaller key; the row itself is no neighbour, and rows that repeat key and vector are
    one. Rows without key or usable vector take no part; vectors of different lengths are never compared. Equal
    vectors are one point of the graphs: of its rows only the k + 1 smallest keys can be among the k nearest, so a
    crowd of copies stays small. No rows give no rows; extra columns play no part.
    """
    rows = table.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).distinct()
    asked = F.col("id") % every == 0
    smallest = rows.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("place") <= k + 1)
    members = smallest.groupBy("vector").agg(F.min("id").alias("point"), F.array_sort(F.collect_set("id")).alias("ids"))
    points = materialize(members, "ann-points")
    queries = materialize(rows.where(asked).join(points.select("vector", "point"), "vector").select("id", "point"), "ann-queries")
    shards = max(1, -(-points.count() // shard_rows))
    # Vectors of one length share their shards.
    first = F.size("vector").cast("long") * shards
    index = points.select((first + F.pmod(F.xxhash64("point"), F.lit(shards))).alias("shard"), F.lit(False).alias("query"), "point", "vector")
    wanted = points.join(queries.select("point").distinct(), "point", "left_semi")
    visits = wanted.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: first + i)).alias("shard"), F.lit(True).alias("query"), "point", "vector")

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, graph, keys, vectors = None, None, [], []
        for batch in batches:
            for number, part in batch.groupby("shard", sort=False):
                if number != shard:
                    shard, graph, keys, vectors = number, None, [], []
                own = part[~part["query"]]
                keys += list(own["point"])
                vectors += list(own["vector"])
                asking = part[part["query"]]
                if len(asking) and keys:
                    if graph is None:
                        graph = Graph(np.array(vectors, np.float64))
                        vectors, names = [], np.array(keys, np.int64)
                    for query, row, score in graph.nearest(np.array(list(asking["vector"]), np.float64), k + 1):
                        yield pd.DataFrame({"query": asking["point"].to_numpy()[query], "point": names[row], "score": score})

    # A shard's points come before the queries that visit it, so a task holds one graph and passes queries in batches.
    # Shards are dealt by their number, one to a task; a hash would let some share a task while others idle.
    place = F.pmod("shard", F.lit(shards)).cast("int")
    dealt = index.union(visits).repartitionById(shards, place).sortWithinPartitions("shard", "query")
    found = dealt.mapInPandas(visit, "query long, point long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    named = top.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    # One row per distinct query vector meets its query rows; a crowded vector is left to the splitting of skewed joins.
    answers = queries.join(lists.withColumnRenamed("query", "point"), "point").select(F.col("id").alias("query_id"), F.filter("found", lambda x: x["vec_id"] != F.col("id")).alias("found"))
    ranked = answers.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
