"""Ranked lexical search: geometric blocks in every posting list, skipped by exact bounds.

Documents are cut into shards of bounded size, and each shard holds its own index. A document is a sparse vector of
the saturated frequencies of its terms. In the posting list of a term, documents are clustered by the similarity of
their vectors (of random projections of them) into blocks; a block's summary is the largest value of its documents at
each coordinate. The product of a query with a summary bounds the score of every document of the block. A query opens
its lists by their greatest contribution, visits blocks by descending bound and skips a block only if its bound is
below the score of its k-th document so far; the documents of visited blocks are scored in full, in integers. So results
are exact, ties included.

Queries are worked on in waves of bounded size. Only coordinates that some query of the wave asks for are stored.
A first pass over one shard in ``SEED_PART`` gives each query a score to beat before the others are searched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsreach.sources.workspace import materialize

#: Documents and postings of a shard, at most (a document of more postings is a shard alone).
SHARD_ROWS = 1 << 16
SHARD_POSTINGS = 1 << 21
#: Documents of a block in the mean, and cells of all summaries of a list, at most.
BLOCK = 128
SUMMARY_CELLS = 1 << 22
#: Dimensions of the projections that blocks are clustered by.
SKETCH = 16
#: One part in this many is searched first; its scores are the first to beat.
SEED_PART = 16
#: Characters of the queries of one wave, in expectation; they and their counts are all that reaches the driver.
WAVE_CHARS = 1 << 24
#: A term's frequency saturates by these: the score of one term is GRAIN * tf div (1000 * tf + 8 * length norm).
GRAIN = 1_000_000_000
LENGTH_SHARE = 75
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a whole text: runs of ASCII letters, digits and all characters beyond ASCII, with A to Z lower-cased."""
    return _TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 at the mean length, LENGTH_SHARE parts of it in proportion to the number of terms."""
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // max(total, 1)


def weight(documents: int, holding: int) -> int:
    """Weight of a term that so many of the documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc, known, n (all terms) and the numbers (int32) and frequencies (int32) of the vocabulary's terms in each text, as bytes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch["text"]:
                found = terms_of(text)
                held = [(vocabulary[x], c) for x, c in Counter(found).items() if x in vocabulary]
                pairs = np.array(sorted(held), np.int32).reshape(-1, 2)
                sizes.append(len(found))
                terms.append(pairs[:, 0].tobytes())
                counts.append(pairs[:, 1].tobytes())
            if sizes:
                yield pd.DataFrame({"doc": batch["doc"], "known": batch["known"], "n": sizes, "terms": terms, "counts": counts})

    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.col("doc_id").isNotNull().alias("known"), F.col("text").cast("string").alias("text"))
    return plain.mapInPandas(count, "doc long, known boolean, n long, terms binary, counts binary")


def holding(vectors: DataFrame, size: int) -> np.ndarray:
    """Number of documents that hold each of the ``size`` terms; partial counts of a task are added before the shuffle."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            found += np.bincount(np.frombuffer(b"".join(batch["terms"]), np.int32), minlength=size)
        held = np.flatnonzero(found)
        yield pd.DataFrame({"term": held, "documents": found[held]})

    out = np.zeros(size, np.int64)
    rows = vectors.select("terms").mapInPandas(partial, "term long, documents long").groupBy("term").agg(F.sum("documents")).toPandas()
    out[rows.iloc[:, 0].to_numpy(np.int64)] = rows.iloc[:, 1].to_numpy(np.int64)
    return out


def gathered(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places first, first + 1, ... of ``count`` each, one run after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - first, count)


@dataclass
class Blocks:
    """A posting list: its blocks' documents, and their summaries at the coordinates that queries of this list ask for."""

    rows: np.ndarray
    ends: np.ndarray
    summaries: np.ndarray


class Shard:
    """Index of some documents: values by document, and blocks by term, made when a query first opens the list."""

    def __init__(self, docs: np.ndarray, known: np.ndarray, owner: np.ndarray, term: np.ndarray, value: np.ndarray, asked: list[np.ndarray]):
        self.docs, self.known, self.term, self.value, self.asked = docs, known, term, value, asked
        self.count = np.bincount(owner, minlength=len(docs))
        self.first = np.cumsum(self.count) - self.count
        size = len(asked)
        order = np.argsort(term, kind="stable")
        self.holders = owner[order]
        self.held = np.searchsorted(term[order], np.arange(size + 1))
        self.top = np.zeros(size, np.int64)
        filled = np.flatnonzero(np.diff(self.held))
        if len(filled):
            self.top[filled] = np.maximum.reduceat(value[order], self.held[filled])
        self.sketches = np.zeros((len(docs), SKETCH), np.float32)
        signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (size, SKETCH))
        for start in range(0, len(docs), 4096):
            rows = np.flatnonzero(self.count[start : start + 4096]) + start
            if len(rows):
                span = slice(self.first[rows[0]], self.first[rows[-1]] + self.count[rows[-1]])
                self.sketches[rows] = np.add.reduceat(signs[term[span]] * value[span, None].astype(np.float32), self.first[rows] - span.start, axis=0)
        self.sketches /= np.maximum(np.linalg.norm(self.sketches, axis=1, keepdims=True), 1e-9)
        self.lists: dict[int, Blocks] = {}
        self.place = np.zeros(size, np.int64)

    def blocks(self, term: int) -> Blocks:
        if term not in self.lists:
            self.lists[term] = self._blocks(self.holders[self.held[term] : self.held[term + 1]], self.asked[term])
        return self.lists[term]

    def _blocks(self, rows: np.ndarray, asked: np.ndarray) -> Blocks:
        number = max(1, min(-(-len(rows) // BLOCK), SUMMARY_CELLS // max(len(asked), 1)))
        centres = self.sketches[rows[np.arange(number) * len(rows) // number]]
        nearest = np.zeros(len(rows), np.int64)
        step = max(1, (1 << 22) // number)
        for start in range(0, len(rows) if number > 1 else 0, step):
            nearest[start : start + step] = np.argmax(self.sketches[rows[start : start + step]] @ centres.T, axis=1)
        order = np.argsort(nearest, kind="stable")
        rows, nearest = rows[order], nearest[order]
        used, nearest = np.unique(nearest, return_inverse=True)
        summaries = np.zeros((len(used), len(asked)), np.int64)
        wanted = np.full(len(self.place), -1)
        wanted[asked] = np.arange(len(asked))
        for start in range(0, len(rows), 8192):
            part = rows[start : start + 8192]
            at = gathered(self.first[part], self.count[part])
            column = wanted[self.term[at]]
            kept = column >= 0
            cell = np.repeat(nearest[start : start + 8192], self.count[part])[kept] * len(asked) + column[kept]
            np.maximum.at(summaries.reshape(-1), cell, self.value[at[kept]])
        return Blocks(rows, np.searchsorted(nearest, np.arange(len(used)), "right"), summaries)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of the k best documents of a query with a score of ``least`` and above 0, ties to the smaller id."""
        best_rows, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = (self.held[terms + 1] > self.held[terms]) & (weights > 0)
        terms, weights = terms[held], weights[held]
        if not len(terms):
            return best_rows, best
        query = np.zeros(len(self.place), np.int64)
        query[terms] = weights
        share = weights * self.top[terms]
        order = np.argsort(-share, kind="stable")
        left = np.cumsum(share[order][::-1])[::-1]
        seen = np.zeros(len(self.docs), bool)
        least = max(least, 1)
        for position, term in enumerate(terms[order].tolist()):
            # A document not met yet holds none of the terms before, so the rest of the shares bounds it.
            if left[position] < least:
                break
            found = self.blocks(term)
            asked = self.asked[term]
            bounds = found.summaries @ query[asked]
            for block in np.argsort(-bounds, kind="stable").tolist():
                if bounds[block] < least:
                    break
                rows = found.rows[found.ends[block - 1] if block else 0 : found.ends[block]]
                rows = rows[~seen[rows]]
                if not len(rows):
                    continue
                seen[rows] = True
                count = self.count[rows]
                at = gathered(self.first[rows], count)
                scores = np.add.reduceat(self.value[at] * query[self.term[at]], np.cumsum(count) - count)
                good = scores >= least
                if good.any():
                    best_rows, best = np.concatenate((best_rows, rows[good])), np.concatenate((best, scores[good]))
                    kept = np.lexsort((self.docs[best_rows], ~self.known[best_rows], -best))[:k]
                    best_rows, best = best_rows[kept], best[kept]
                    if len(best) == k:
                        least = max(least, int(best[-1]))
        return best_rows, best


def searched(vectors: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], size: int, documents: int, total: int, k: int, least: np.ndarray) -> DataFrame:
    """query, doc, known, score: the k best documents of every query in each shard; shards are runs of rows of a partition."""
    asking: list[list[np.ndarray]] = [[] for _ in range(size)]
    for terms, _ in queries:
        for term in terms.tolist():
            asking[term].append(terms)
    asked = [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in asking]

    def answer(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True)
        term = np.frombuffer(b"".join(rows["terms"]), np.int32).astype(np.int64)
        tf = np.frombuffer(b"".join(rows["counts"]), np.int32).astype(np.int64)
        owner = np.repeat(np.arange(len(rows)), rows["terms"].map(len).to_numpy() // 4)
        norm = length_norm(rows["n"].to_numpy(np.int64), documents, total)
        value = (GRAIN * tf) // (1000 * tf + 8 * norm[owner])
        shard = Shard(rows["doc"].to_numpy(np.int64), rows["known"].to_numpy(bool), owner, term, value, asked)
        found = [(i, *shard.search(terms, weights, k, int(least[i]))) for i, (terms, weights) in enumerate(queries)]
        at = np.concatenate([x[1] for x in found])
        return pd.DataFrame({
            "query": np.repeat([x[0] for x in found], [len(x[1]) for x in found]),
            "doc": shard.docs[at], "known": shard.known[at], "score": np.concatenate([x[2] for x in found]),
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []
        rows = postings = 0
        for batch in batches:
            sizes = batch["terms"].map(len).to_numpy() // 4
            start = 0
            while start < len(batch):
                room = np.searchsorted(np.cumsum(sizes[start:]), SHARD_POSTINGS - postings, "right")
                step = int(min(room, SHARD_ROWS - rows, len(batch) - start))
                if step == 0 and not parts:
                    step = 1
                if step:
                    parts.append(batch.iloc[start : start + step])
                    rows, postings, start = rows + step, postings + int(sizes[start : start + step].sum()), start + step
                if start < len(batch):
                    yield answer(parts)
                    parts, rows, postings = [], 0, 0
        if parts:
            yield answer(parts)

    return vectors.mapInPandas(run, "query long, doc long, known boolean, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank from 1; a NULL doc_id comes last among equal scores."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("known"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched_wave(docs: DataFrame, wave: pd.DataFrame, k: int) -> DataFrame:
    """key, rank, doc_id, score of the k best documents of each text of ``wave`` (key, text), a bounded table."""
    counted = [Counter(terms_of(x)) for x in wave["text"]]
    vocabulary = {term: i for i, term in enumerate(sorted({x for c in counted for x in c}))}
    vectors = materialize(frequencies(docs, vocabulary), "term-frequencies")
    documents, total = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.array([weight(documents, int(x)) for x in holding(vectors, len(vocabulary))], np.int64)
    queries = []
    for c in counted:
        terms = np.array(sorted(vocabulary[x] for x in c), np.int64)
        repeats = np.zeros(len(vocabulary), np.int64)
        repeats[[vocabulary[x] for x in c]] = list(c.values())
        queries.append((terms, repeats[terms] * weights[terms]))
    part = F.pmod(F.xxhash64("doc", "n", "terms"), F.lit(SEED_PART))
    arguments = (queries, len(vocabulary), documents, total, k)
    seeds = materialize(searched(vectors.where(part == 0), *arguments, np.zeros(len(queries), np.int64)), "seed-results")
    least = np.zeros(len(queries), np.int64)
    for row in best_of(seeds, k).where(F.col("rank") == k).select("query", "score").toLocalIterator():
        least[row["query"]] = row["score"]
    found = seeds.union(searched(vectors.where(part != 0), *arguments, least))
    keys = docs.sparkSession.createDataFrame([(i, key) for i, key in enumerate(wave["key"])], "query long, key string")
    return materialize(
        best_of(found, k).join(keys, "query").select("key", "rank", F.when(F.col("known"), F.col("doc")).alias("doc_id"), "score"), "wave-results"
    )


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, wave_chars: int = WAVE_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` its ``k`` documents of highest score above 0.

    Equal scores go by ascending doc_id, a NULL doc_id last. Texts are read whole; repeated documents are documents
    of their own, repeated items are answered each. NULL, empty or termless texts of either side match nothing. No
    documents or items give no rows. Extra columns play no part. The index covers every document; texts of items are
    taken once each, in as many waves as ``wave_chars`` asks for, and each wave indexes the terms it needs.
    """
    keyed = items.select("item_id", F.sha2(F.col("text").cast("string").cast("binary"), 256).alias("key"), F.col("text").cast("string").alias("text"))
    texts = materialize(keyed.where(F.col("text").isNotNull()).groupBy("key").agg(F.first("text").alias("text")), "queries")
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    waves = -(-chars // wave_chars)
    found = None
    for wave in range(waves):
        rows = texts.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave).orderBy("key").toPandas()
        if len(rows):
            part = searched_wave(docs, rows, k)
            found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "key string, rank int, doc_id long, score long")
    return keyed.select("item_id", "key").join(found, "key").select(F.col("item_id").cast("long").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: The same rows of the whole tables in SQL.
RANKED_SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*) AS documents, sum(n)::BIGINT AS total FROM n),
w AS (SELECT term, floor(1000 * ln((2 * any_value(documents) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // total))))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
