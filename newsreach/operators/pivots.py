"""An index of pivot cells for exact search among vectors, when the queries are too many to travel to the tasks.

Pivots are chosen from a bounded sample of the corpus, far apart from each other. Every vector belongs to the cell of the pivot it has the smallest angle to,
and a cell is cut along that angle into leaves of bounded size; a crowd of equal vectors is cut by key. A leaf is known
by its pivot and the ranges of angle, norm and reach bonus of its members, so all leaves together are a small table.

By the triangle inequality of angles, a member at angle a to the pivot is at least |t - a| away from a query at angle t. That
bounds the inner product of a query with any member of a leaf, and with the largest bonus the score. A first round
scores the most promising leaves of each query; its k-th score then rules out every leaf whose bound is below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsreach.sources.workspace import materialize

# Pivots and leaves at most, whatever the corpus: what of the index travels to the tasks is bounded
MOST_PIVOTS = 4096
MOST_LEAVES = 500_000

# Vectors of the sample for each pivot that is chosen from it
SAMPLED = 4

# Leaves of a query's first round, besides those needed to hold k vectors
FIRST_LEAVES = 2

# Rows of a shard, about: an eighth of the corpus within these limits, as a query travels once to each shard
SHARD_ROWS = 32_768
MOST_SHARD_ROWS = 131_072
SHARDS = 8

# Queries of one shard that one task scores, at most, and at least if all cores are to have work
SHARD_QUERIES = 65_536
LEAST_QUERIES = 4_096

# Bounds (queries x leaves) computed at once
BOUND_CELLS = 4_000_000

# Queries are scored together with all leaves that some of them visit if that makes no more pairs than so many times those of their steps
MERGED = 1.25

# Angles and products are rounded; a bound this close counts as reached
SLACK = 1e-6


def unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one (a zero row stays) and their lengths."""
    norm = np.linalg.norm(matrix, axis=1)
    return matrix / np.where(norm == 0, 1, norm)[:, None], norm


@dataclass
class PivotIndex:
    """Members of the leaves (stored, with ``__leaf`` and ``__shard``), the table of leaves with the pivots they belong to, and the shard of each leaf."""

    members: DataFrame
    leaves: pd.DataFrame
    pivots: np.ndarray
    bonus: float
    shards: np.ndarray

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """Upper bound of the score of every leaf (column) for every query vector (row)."""
        towards, length = unit(vectors)
        angle = np.arccos(np.clip(towards @ self.pivots.T, -1, 1))[:, self.leaves["pivot"].to_numpy()]
        gap = np.maximum(0, np.maximum(angle - self.leaves["high"].to_numpy(), self.leaves["low"].to_numpy() - angle))
        cosine = np.cos(np.minimum(gap, np.pi))
        norm = np.where(cosine >= 0, self.leaves["most_norm"].to_numpy(), self.leaves["least_norm"].to_numpy())
        product = length[:, None] * norm
        return product * cosine + self.leaves["reach"].to_numpy() + self.bonus + SLACK * (1 + product)

    def first(self, bounds: np.ndarray, k: int) -> list[np.ndarray]:
        """Positions of the leaves of each query's first round: of highest bound, enough to hold ``k`` vectors."""
        rows = self.leaves["rows"].to_numpy()
        out = []
        for line in bounds:
            count = min(len(line), FIRST_LEAVES + k)
            best = np.argpartition(-line, count - 1)[:count]
            best = best[np.lexsort((best, -line[best]))]
            need = int(np.searchsorted(np.cumsum(rows[best]), k)) + 1
            out.append(best[: max(FIRST_LEAVES, need)])
        return out

    def wanted(self, vectors: np.ndarray, k: int, least: np.ndarray | None, again: bool) -> np.ndarray:
        """Whether each query (row) visits each leaf: those of the first round or, given ``least``, those whose bound reaches it
        (NaN: any), the ones of the first round only if they are wanted ``again``."""
        bounds = self.bounds(vectors)
        if least is not None and again:
            return ~(bounds < least[:, None])
        first = np.zeros(bounds.shape, bool)
        for i, seen in enumerate(self.first(bounds, k)):
            first[i, seen] = True
        return first if least is None else ~(bounds < least[:, None]) & ~first

    def _visiting(
        self, queries: DataFrame, vector: str, k: int, least: str | None, more: Sequence[T.StructField], give: Callable[[pd.DataFrame, np.ndarray], Iterator[pd.DataFrame]], again: bool = False
    ) -> DataFrame:
        columns = queries.columns
        schema = T.StructType([*[queries.schema[c] for c in columns], *more])
        index = PivotIndex(None, self.leaves, self.pivots, self.bonus, self.shards)

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = max(1, BOUND_CELLS // max(len(index.leaves), 1))
            for batch in batches:
                for start in range(0, len(batch), step):
                    part = batch.iloc[start : start + step]
                    reached = None if least is None else part[least].to_numpy(np.float64)
                    yield from give(part[columns], index.wanted(np.stack(part[vector].to_numpy()).astype(np.float64), k, reached, again))

        return queries.mapInPandas(visit, schema) if len(self.leaves) else queries.sparkSession.createDataFrame([], schema)

    def probes(self, queries: DataFrame, vector: str, k: int, least: str | None = None) -> DataFrame:
        """The queries once for each leaf they visit (``__leaf``): those of the first round or, given ``least``, all others
        whose bound reaches the score in that column (NULL or NaN: any)."""
        leaf = self.leaves["leaf"].to_numpy(np.int64)

        def give(part: pd.DataFrame, wanted: np.ndarray) -> Iterator[pd.DataFrame]:
            row, place = np.nonzero(wanted)
            for at in range(0, len(row), 20_000):
                rows = row[at : at + 20_000]
                yield part.take(rows).assign(__leaf=leaf[place[at : at + 20_000]])

        return self._visiting(queries, vector, k, least, [T.StructField("__leaf", T.LongType())], give)

    def visits(self, queries: DataFrame, vector: str, k: int, least: str | None = None) -> DataFrame:
        """The queries once for each shard (``__shard``) they visit, with a bit for each of its leaves (``__leaves``): those of the
        first round or, given ``least``, all whose bound reaches the score in that column (NULL or NaN: any)."""
        shards = self.shards
        numbers = np.unique(shards)

        def give(part: pd.DataFrame, wanted: np.ndarray) -> Iterator[pd.DataFrame]:
            for shard in numbers:
                here = wanted[:, shards == shard]
                rows = np.flatnonzero(here.any(axis=1))
                if len(rows):
                    bits = np.packbits(here[rows], axis=1)
                    yield part.take(rows).assign(__shard=int(shard), __leaves=[x.tobytes() for x in bits])

        return self._visiting(queries, vector, k, least, [T.StructField("__shard", T.LongType()), T.StructField("__leaves", T.BinaryType())], give, True)


def far_apart(points: np.ndarray, number: int) -> np.ndarray:
    """Up to ``number`` of the unit vectors, each the one of greatest angle to those before it; a zero vector if there is none."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    chosen = [0]
    nearest = points @ points[0]
    while len(chosen) < min(number, len(points)):
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-12:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, points @ points[far])
    return points[chosen]


def build_index(
    corpus: DataFrame, keys: Sequence[str], vector: str, leaf_rows: int, bonus: float, reach: float = 0.0, reach_column: str | None = None
) -> PivotIndex:
    """Index of the vectors (all of one length); those with a NaN or infinite number, or without a reach that counts, are left out."""
    rows = corpus.count()
    parts = int(min(MOST_LEAVES, max(1, -(-rows // leaf_rows))))
    # more cells than leaves would only make the leaves small
    number = int(min(MOST_PIVOTS, 4 * parts, max(1, np.ceil(np.sqrt(rows)))))
    sample = corpus.orderBy(F.xxhash64(*keys), *keys).select(vector).limit(SAMPLED * number).toPandas()
    drawn = np.stack(sample[vector].to_numpy()).astype(np.float64) if len(sample) else np.zeros((0, 1))
    towards, norm = unit(drawn[np.isfinite(drawn).all(axis=1)])
    pivots = far_apart(towards[norm > 0], number)

    @F.pandas_udf("cell long, angle double, norm double")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for start in range(0, len(batch), max(1, BOUND_CELLS // len(pivots))):
                matrix = np.stack(batch.iloc[start : start + max(1, BOUND_CELLS // len(pivots))].to_numpy()).astype(np.float64)
                good = np.isfinite(matrix).all(axis=1)
                towards, length = unit(np.where(good[:, None], matrix, 0))
                cosine = towards @ pivots.T
                cell = cosine.argmax(axis=1)
                angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1, 1))
                out.append(pd.DataFrame({"cell": cell, "angle": angle, "norm": np.where(good, length, np.nan)}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"cell": [], "angle": [], "norm": []})

    placed = corpus.withColumn("__at", place(vector)).where(~F.isnan("__at.norm"))
    gain = F.lit(0.0)
    if reach_column is not None and reach:
        gain = F.lit(reach) * F.col(reach_column)
        placed = placed.where(F.col(reach_column).isNotNull() & ~F.isnan(F.col(reach_column).cast("double")))
    ranged = placed.repartitionByRange(parts, F.col("__at.cell"), F.col("__at.angle"), *[F.col(c) for c in keys])
    members = materialize(ranged.withColumn("__leaf", F.col("__at.cell") * F.lit(2 * MOST_LEAVES) + F.spark_partition_id()), "pivot-members")
    # Neighbouring parts of the range make a shard.
    each = max(1, min(MOST_SHARD_ROWS, max(SHARD_ROWS, rows // SHARDS)) // leaf_rows)
    leaves = members.groupBy(F.col("__leaf").alias("leaf")).agg(
        F.first("__at.cell").alias("pivot"), F.min("__at.angle").alias("low"), F.max("__at.angle").alias("high"),
        F.min("__at.norm").alias("least_norm"), F.max("__at.norm").alias("most_norm"), F.max(gain.cast("double")).alias("reach"), F.count(F.lit(1)).alias("rows"),
    )
    # At most one leaf for each pivot and part, as ranges are contiguous: bounded whatever the corpus.
    table = leaves.orderBy("leaf").toPandas()
    shard = F.floor(F.col("__leaf") % F.lit(2 * MOST_LEAVES) / each)
    return PivotIndex(members.drop("__at").withColumn("__shard", shard), table, pivots, bonus, table["leaf"].to_numpy(np.int64) % (2 * MOST_LEAVES) // each)


def alike(visited: list[np.ndarray], rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs (first, behind the last) of steps that visit nearly the same leaves of ``rows`` members, and the leaves that a run visits."""
    first = 0
    while first < len(visited):
        wanted, apart, last = visited[first], int(rows[visited[first]].sum()), first + 1
        while last < len(visited):
            both, more = wanted | visited[last], apart + int(rows[visited[last]].sum())
            if rows[both].sum() * (last + 1 - first) > MERGED * more:
                break
            wanted, apart, last = both, more, last + 1
        yield first, last, wanted
        first = last


def met_in_leaves(
    index: PivotIndex, visits: DataFrame, query_id: str, score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: T.StructType, step: int
) -> DataFrame:
    """Queries and members of the leaves they visit scored together, those of the most alike visits at a time.

    A task has the members of one shard; a shard that very many queries visit, or one of fewer shards than cores, is dealt to
    several tasks. Queries are taken in steps of ``step``; steps that visit nearly the same leaves are scored as one, so that the
    members are made ready once.
    """
    stored = materialize(visits, "visits")
    number = F.count(F.lit(1))
    tasks = -(-3 * stored.sparkSession.sparkContext.defaultParallelism // max(1, len(np.unique(index.shards))))
    parts = F.greatest(F.ceil(number / SHARD_QUERIES), F.least(F.ceil(number / LEAST_QUERIES), F.lit(tasks)))
    counted = stored.groupBy("__shard").agg(parts.cast("int").alias("__parts"))
    left = stored.join(counted, "__shard").withColumn("__part", F.pmod(F.xxhash64(query_id), F.col("__parts")).cast("int")).drop("__parts")
    right = index.members.join(counted, "__shard").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    names = schema.fieldNames()
    of_shard = {int(x): index.leaves["leaf"].to_numpy(np.int64)[index.shards == x] for x in np.unique(index.shards)}

    def meet(asked: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame(columns=names)]
        if len(asked) and len(members):
            asked = asked.sort_values("__leaves", kind="stable")
            leaves = of_shard[int(members["__shard"].iloc[0])]
            place = np.searchsorted(leaves, members["__leaf"].to_numpy())
            rows = np.bincount(place, minlength=len(leaves))
            starts = list(range(0, len(asked), step))
            visited = [
                np.unpackbits(np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint8) for x in asked["__leaves"].iloc[at : at + step]]), axis=0))[: len(leaves)].astype(bool)
                for at in starts
            ]
            for first, last, wanted in alike(visited, rows):
                part = asked.iloc[starts[first] : starts[last - 1] + step]
                near = members if wanted[place].all() else members[wanted[place]]
                if len(near):
                    found.append(score(part, near))
        return pd.concat(found[1:] or found, ignore_index=True)

    return left.groupBy("__shard", "__part").cogroup(right.groupBy("__shard", "__part")).applyInPandas(meet, schema)
