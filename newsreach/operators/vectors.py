"""Similarity search with additive bonuses, neighbour scores, distinctive outlets."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsreach import constants as K
from newsreach.functions.arrays import dot, l2_normalize
from newsreach.functions.scoring import match_bonus, rarity
from newsreach.operators.pivots import build_index, met_in_leaves
from newsreach.sources import commits
from newsreach.sources.files import missing_rows, rows_of
from newsreach.sources.workspace import materialize

# Seconds between two tries of a batch call, at most
LONGEST_WAIT = 60.0

# Queries up to this many vector cells (rows x dimensions) travel to the tasks as one broadcast: 64 MB
BROADCAST_CELLS = 8_000_000

# Rows per leaf of the index, and queries scored at once inside a task
BLOCK_ROWS = 32_768
QUERY_STEP = 256

# Corpus rows scored at once, and pairs scored one by one
CORPUS_STEP = 16_384
PAIR_STEP = 65_536

# Up to this many queries are compared where the corpus lies, without asking for its size
FEW_QUERIES = 1024

# Queries of one task that has the whole corpus
TASK_QUERIES = 32_768

# More classes, or larger products, are scored in double precision throughout
MOST_CLASSES = 256
MOST_PRODUCT = 1e12

# Scores that agree to this many decimals are ties and fall back to the key order
SCORE_DECIMALS = 9


@dataclass(frozen=True)
class Bonus:
    """What is added to the similarity. Column names are shared by queries and corpus."""

    matches: dict[str, float] = field(
        default_factory=lambda: {"category": K.SAME_CATEGORY_BONUS, "place": K.SAME_PLACE_BONUS}
    )
    reach: float = 0.0
    reach_column: str = "reach_score"
    null_matches_null: bool = False


SEARCH_BONUS = Bonus(reach=K.REACH_BONUS)
SCORE_BONUS = Bonus()


def with_vectors(df: DataFrame, vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach vectors by key, never by row position (V2)."""
    return df.join(vectors, list(keys))


def called(embed_fn: Callable[[list[str]], np.ndarray], texts: list[str], retries: int, wait: float) -> np.ndarray:
    """Result of one batch call, tried again ``retries`` times after growing waits (``wait`` seconds, doubled each time)."""
    for attempt in range(retries + 1):
        try:
            found = np.asarray(embed_fn(texts), dtype=np.float64)
            if found.ndim != 2 or len(found) != len(texts):
                raise ValueError(f"{len(texts)} texts gave vectors of shape {found.shape}")
            return found
        except Exception:  # noqa: BLE001 - the function is the caller's
            if attempt == retries:
                raise
            time.sleep(min(wait * 2**attempt, LONGEST_WAIT))
    raise AssertionError


def embed(
    df: DataFrame, text: str, embed_fn: Callable[[list[str]], np.ndarray], out: str = "embedding",
    retries: int = 3, wait: float = 1.0, error: str | None = None,
) -> DataFrame:
    """Unit vectors for a text column, ``EMBED_BATCH`` texts per call of ``embed_fn`` (V1).

    Rows keep all their columns, so a vector can never end up on another row. A call that fails is repeated with
    growing waits. One that fails for good fails the task or, given an ``error`` column, leaves its rows
    without a vector and with the message there, while the other calls' rows get theirs.
    """
    more = [T.StructField(out, T.ArrayType(T.FloatType())), *([T.StructField(error, T.StringType())] if error else [])]
    schema = T.StructType([*df.schema.fields, *more])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), K.EMBED_BATCH):
                part = batch.iloc[start : start + K.EMBED_BATCH]
                message = None
                try:
                    matrix = called(embed_fn, part[text].fillna("").tolist(), retries, wait)
                    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
                    vectors = list((matrix / np.where(norm == 0, 1, norm)).astype(np.float32))
                except Exception as failure:  # noqa: BLE001
                    if error is None:
                        raise
                    vectors, message = [None] * len(part), f"{type(failure).__name__}: {failure}"
                found = part.assign(**{out: vectors})
                yield found.assign(**{error: message}) if error else found

    return df.mapInPandas(run, schema)


def embed_missing(
    df: DataFrame, keys: Sequence[str], text: str, embed_fn: Callable[[list[str]], np.ndarray], path: str,
    out: str = "embedding", retries: int = 3, wait: float = 1.0,
) -> tuple[int, int]:
    """Embed the rows whose key has no vector below ``path`` yet; gives the number of vectors and of failures of this run.

    Each run commits the vectors of the calls that worked and notes keys and errors of those that did not; the next run
    takes up what has no vector. ``embedded`` reads the vectors, ``embedding_failures`` the notes.
    """
    spark = df.sparkSession
    done = embedded(spark, path)
    todo = df.select(*keys, text) if done is None else missing_rows(df.select(*keys, text), done, keys)
    tried = materialize(embed(todo, text, embed_fn, out, retries, wait, "__error"), "embedded")
    name = uuid.uuid4().hex
    good, bad = tried.where(F.col("__error").isNull()), tried.where(F.col("__error").isNotNull())
    good.select(*keys, out).write.option("compression", "zstd").parquet(f"{path}/vectors/{name}")
    bad.select(*keys, F.col("__error").alias("error")).write.option("compression", "zstd").parquet(f"{path}/failed/{name}")
    while True:
        version, runs = commits.load(spark, f"{path}/runs")
        if commits.commit(spark, f"{path}/runs", version + 1, {"names": [*runs.get("names", []), name]}):
            return good.count(), bad.count()


def _of_runs(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    names = commits.load(spark, f"{path}/runs")[1].get("names", [])
    return spark.read.parquet(*[f"{path}/{kind}/{name}" for name in names]) if names else None


def embedded(spark: SparkSession, path: str) -> DataFrame | None:
    """Keys and vectors that ``embed_missing`` has committed; None before its first run."""
    return _of_runs(spark, path, "vectors")


def embedding_failures(spark: SparkSession, path: str) -> DataFrame | None:
    """Keys and errors of all calls that failed for good, one row per run and key."""
    return _of_runs(spark, path, "failed")


def hashed_embedding(
    df: DataFrame, text: str, dimensions: int = K.EMBEDDING_DIMENSIONS, out: str = "embedding"
) -> DataFrame:
    """Unit vectors from hashed word counts, without any model or service (V1, default)."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    hashing = HashingTF(numFeatures=dimensions, inputCol="__words", outputCol="__counts")
    counted = hashing.transform(df.withColumn("__words", words)).withColumn("__dense", vector_to_array("__counts"))
    unit = F.transform(l2_normalize("__dense"), lambda x: x.cast("float"))
    return counted.withColumn(out, unit).drop("__words", "__counts", "__dense")


def _same_class(queries: pd.DataFrame, corpus: pd.DataFrame, name: str, null_matches_null: bool) -> np.ndarray:
    """Whether query and corpus row have the same class, of any type; missing ones agree only if asked for."""
    codes, _ = pd.factorize(pd.concat([queries[name], corpus[name]], ignore_index=True))
    left, right = codes[: len(queries), None], codes[None, len(queries) :]
    return (left == right) & ((left >= 0) | null_matches_null)


def _scores(queries: pd.DataFrame, corpus: pd.DataFrame, q_vec: np.ndarray, c_vec: np.ndarray, bonus: Bonus) -> np.ndarray:
    scores = q_vec @ c_vec.T
    for name, weight in bonus.matches.items():
        scores += weight * _same_class(queries, corpus, name, bonus.null_matches_null)
    if bonus.reach:
        scores += bonus.reach * corpus[bonus.reach_column].to_numpy(dtype=np.float64)[None, :]
    return np.round(scores, SCORE_DECIMALS)


def _keep_best(query: np.ndarray, score: np.ndarray, keys: list[np.ndarray], k: int) -> np.ndarray:
    """Positions of the k best candidates of every query, best first, ties by key."""
    order = np.lexsort((*reversed(keys), -score, query))
    sorted_query = query[order]
    starts = np.flatnonzero(np.r_[True, sorted_query[1:] != sorted_query[:-1]])
    lengths = np.diff(np.r_[starts, len(order)])
    rank = np.arange(len(order)) - np.repeat(starts, lengths)
    return order[rank < k]


def _matrix(frame: pd.DataFrame, vector: str) -> np.ndarray:
    return np.stack(frame[vector].to_numpy()).astype(np.float64)


def _hints(
    queries: pd.DataFrame, corpus: pd.DataFrame, q_vec: np.ndarray, c_vec: np.ndarray, bonus: Bonus
) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Vectors of single precision whose products are the scores, bonuses included, up to the given error; None if some number is too large."""
    left, right = [q_vec], [c_vec]
    most = 0.0
    for name, weight in bonus.matches.items():
        codes, classes = pd.factorize(pd.concat([queries[name], corpus[name]], ignore_index=True), use_na_sentinel=not bonus.null_matches_null)
        if len(classes) > MOST_CLASSES:
            return None
        hot = (codes[:, None] == np.arange(len(classes))).astype(np.float32)
        left.append(weight * hot[: len(queries)])
        right.append(hot[len(queries) :])
        most += abs(weight)
    if bonus.reach:
        gain = bonus.reach * corpus[bonus.reach_column].to_numpy(dtype=np.float64)
        left.append(np.ones((len(queries), 1)))
        right.append(gain[:, None])
    asked, held = (np.concatenate(x, axis=1) for x in (left, right))
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.sqrt(np.einsum("ij,ij->i", asked, asked)).max(initial=0) * np.sqrt(np.einsum("ij,ij->i", held, held)).max(initial=0)
    if not size < MOST_PRODUCT:
        return None
    # Both sides are rounded once, and so is each of the sums.
    error = 2.0**-23 * (asked.shape[1] + 4) * size + 2 * 10.0**-SCORE_DECIMALS
    return asked.astype(np.float32), held.astype(np.float32), error


def _best_of_block(
    queries: pd.DataFrame, q_vec: np.ndarray, corpus: pd.DataFrame, vector: str | np.ndarray, keys: Sequence[str],
    carry: Sequence[str], bonus: Bonus, k: int, reached: np.ndarray | None = None,
) -> pd.DataFrame:
    """Local top-k of one corpus block (``vector``: its column or matrix) for all queries; ties at the cut are all looked at.

    Products of single precision tell which pairs can be among the best; only these are scored. ``reached`` is a score that k rows
    of the whole corpus are known to reach (NaN: none); rows below it are left out.
    """
    floor = np.full(len(queries), -np.inf)
    if reached is not None:
        floor = np.where(np.isnan(reached), -np.inf, reached - 2 * 10.0**-SCORE_DECIMALS)
    c_vec = _matrix(corpus, vector) if isinstance(vector, str) else vector
    held = [corpus[key].to_numpy() for key in keys]
    hints = _hints(queries, corpus, q_vec, c_vec, bonus)
    rows, cols, vals = [], [], []
    for start in range(0, len(queries), QUERY_STEP):
        part = slice(start, start + QUERY_STEP)
        asked, vectors = queries.iloc[part], q_vec[part]
        row, col, val = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = floor[part]
        for first in range(0, len(corpus), CORPUS_STEP):
            span = slice(first, first + CORPUS_STEP)
            if hints is None:
                scores = _scores(asked, corpus.iloc[span], vectors, c_vec[span], bonus)
                # A vector that gives no number is nobody's neighbour and must not push others out.
                scores = np.where(np.isfinite(scores), scores, -np.inf)
                slack = 0.0
            else:
                scores = hints[0][part] @ hints[1][span].T
                slack = hints[2]
            cut = least - slack
            if scores.shape[1] > k and not np.isfinite(least).all():
                cut = np.maximum(cut, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] - 2 * slack)
            # a cut of single precision is rounded down
            cut = cut if hints is None else np.nextafter(cut.astype(np.float32), np.float32(-np.inf))
            near, place = np.nonzero(scores >= cut[:, None])
            if hints is None:
                found = scores[near, place]
            else:
                found = _pair_scores(asked, corpus, vectors, c_vec, near, place + first, bonus)
            real = np.isfinite(found) & (found >= floor[part][near])
            row, col, val = np.r_[row, near[real]], np.r_[col, place[real] + first], np.r_[val, found[real]]
            if len(row):
                keep = _keep_best(row, val, [key[col] for key in held], k)
                row, col, val = row[keep], col[keep], val[keep]
                full = np.bincount(row, minlength=len(asked)) == k
                low = np.full(len(asked), np.inf)
                np.minimum.at(low, row, val)
                least = np.where(full, low, floor[part])
        rows.append(row + start)
        cols.append(col)
        vals.append(val)
    row, col = np.concatenate(rows), np.concatenate(cols)
    taken = corpus[list(dict.fromkeys([*keys, *carry]))].take(col).reset_index(drop=True)
    return taken.assign(__q=row, score=np.concatenate(vals))


def _pair_scores(
    queries: pd.DataFrame, corpus: pd.DataFrame, q_vec: np.ndarray, c_vec: np.ndarray, row: np.ndarray, col: np.ndarray, bonus: Bonus
) -> np.ndarray:
    """Scores of single pairs (positions of queries and corpus), as ``_scores`` gives them for all."""
    scores = np.zeros(len(row))
    for at in range(0, len(row), PAIR_STEP):
        scores[at : at + PAIR_STEP] = np.einsum("ij,ij->i", q_vec[row[at : at + PAIR_STEP]], c_vec[col[at : at + PAIR_STEP]])
    for name, weight in bonus.matches.items():
        left, right = queries[name].take(row), corpus[name].take(col)
        codes, _ = pd.factorize(pd.concat([left, right], ignore_index=True))
        left, right = codes[: len(row)], codes[len(row) :]
        scores += weight * ((left == right) & ((left >= 0) | bonus.null_matches_null))
    if bonus.reach:
        scores += bonus.reach * corpus[bonus.reach_column].to_numpy(dtype=np.float64)[col]
    return np.round(scores, SCORE_DECIMALS)


def _merge_best(blocks: list[pd.DataFrame], keys: Sequence[str], k: int) -> pd.DataFrame:
    merged = pd.concat(blocks, ignore_index=True)
    keep = _keep_best(merged["__q"].to_numpy(), merged["score"].to_numpy(), [merged[c].to_numpy() for c in keys], k)
    return merged.take(keep)


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    query_id: str,
    keys: Sequence[str],
    k: int,
    bonus: Bonus = SEARCH_BONUS,
    carry: Sequence[str] = (),
    vector: str = "embedding",
    broadcast_cells: int = BROADCAST_CELLS,
    block_rows: int = BLOCK_ROWS,
    stored: bool = False,
) -> DataFrame:
    """The k corpus rows of highest similarity plus bonuses for every query.

    Exact, in one of three forms:

    * A corpus whose size has been checked (``broadcast_cells``) is sent to the tasks once, unless the queries are few. Each
      task finds the best rows of its queries among all, so nothing is shuffled but the queries and k rows for each.
    * A query set whose size has been checked (``broadcast_cells``) is sent to the tasks once, and the
      corpus is scanned where it lies: every pair is scored, as blocks of matrix products, and each block gives away
      no more than its k best rows per query. No shuffle of the corpus at all.
    * Where both are larger, the corpus gets an index of pivot cells (``pivots``) with leaves of about ``block_rows`` rows. A query
      meets the leaves it is closest to, and after that those whose upper bound, the largest bonus included, reaches
      its k-th score. It travels once to each shard of neighbouring leaves, however many of them it meets there. How many these are depends on how far the vectors lie apart. Nothing passes through the driver but
      the bounded table of leaves.

    ``stored`` says that ``queries`` is a stored table already. Vectors of another length than the longest query,
    and those that give no number, have no neighbours and are none.

    Result: query id, corpus keys, carried columns, ``score`` and ``rank`` (1 = best; equal scores by key).
    """
    q_fields = [query_id, *bonus.matches, vector]
    c_fields = list(dict.fromkeys([*keys, *bonus.matches, *([bonus.reach_column] if bonus.reach else []), *carry, vector]))
    q = queries.select(*q_fields).where(F.col(vector).isNotNull())
    if not stored:
        # they are measured first and read afterwards
        q = materialize(q, "queries")
    c = corpus.select(*c_fields).where(F.col(vector).isNotNull())
    out = T.StructType(
        [
            queries.schema[query_id],
            *[T.StructField(n, corpus.schema[n].dataType) for n in dict.fromkeys([*keys, *carry]) if n != query_id],
            T.StructField("score", T.DoubleType()),
        ]
    )
    if query_id in keys or query_id in carry:
        raise ValueError(f"rename the query id: {query_id} is also a corpus column")
    names = out.fieldNames()
    extra = [n for n in carry if n not in keys]

    def finish(found: pd.DataFrame, ids: np.ndarray) -> pd.DataFrame:
        return found.assign(**{query_id: ids[found["__q"].to_numpy()]})[names]

    width = q.select(F.max(F.size(vector)).alias("w"), F.count(F.lit(1)).alias("n")).first()
    rows, dims = width["n"], width["w"] or 1
    # vectors of another length cannot be compared
    q, c = q.where(F.size(vector) == dims), c.where(F.size(vector) == dims)
    if rows > FEW_QUERIES:
        # it is counted first, and read more than once by the index
        c = materialize(c, "corpus")
    if rows > FEW_QUERIES and c.count() * dims <= broadcast_cells:
        held = c.toPandas()
        table = held.drop(columns=vector), np.stack(held[vector].to_numpy()) if len(held) else np.zeros((0, dims))
        against = queries.sparkSession.sparkContext.broadcast(table)

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            frame, matrix = against.value
            c_vec = matrix.astype(np.float64)
            for batch in batches:
                if len(batch) and len(frame):
                    ids = batch[query_id].to_numpy()
                    yield finish(_best_of_block(batch, _matrix(batch, vector), frame, c_vec, keys, extra, bonus, k), ids)

        tasks = max(1, min(3 * queries.sparkSession.sparkContext.defaultParallelism, rows // QUERY_STEP), rows // TASK_QUERIES)
        candidates = q.repartition(tasks).mapInPandas(look, out)
    elif rows * dims <= broadcast_cells:
        local = q.toPandas()
        if local.empty:
            return queries.sparkSession.createDataFrame([], T.StructType([*out.fields, T.StructField("rank", T.IntegerType())]))
        shared = queries.sparkSession.sparkContext.broadcast(local)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            frame = shared.value
            q_vec = _matrix(frame, vector)
            best: pd.DataFrame | None = None
            for batch in batches:
                if batch.empty:
                    continue
                block = _best_of_block(frame, q_vec, batch, vector, keys, extra, bonus, k)
                best = block if best is None else _merge_best([best, block], keys, k)
            if best is not None:
                yield finish(best, frame[query_id].to_numpy())

        candidates = c.mapInPandas(scan, out)
    else:
        most = sum(max(weight, 0.0) for weight in bonus.matches.values())
        index = build_index(c, keys, vector, block_rows, most, bonus.reach, bonus.reach_column if bonus.reach else None)

        def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            reached = left["__least"].to_numpy(np.float64) if "__least" in left else None
            return finish(_best_of_block(left, _matrix(left, vector), right, vector, keys, extra, bonus, k, reached), left[query_id].to_numpy())

        numbers = q.where(~F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
        first = met_in_leaves(index, index.visits(numbers, vector, k), query_id, pair, out, QUERY_STEP)
        best = top_k(first, [query_id], "score", keys, k).groupBy(query_id).agg(F.count(F.lit(1)).alias("__n"), F.min("score").alias("__score"))
        reached = best.select(F.col(query_id).alias("__id"), F.when(F.col("__n") == k, F.col("__score")).alias("__least"))
        again = numbers.join(reached, F.col(query_id).eqNullSafe(F.col("__id")), "left").drop("__id")
        candidates = met_in_leaves(index, index.visits(again, vector, k, "__least"), query_id, pair, out, QUERY_STEP)
    return top_k(candidates, [query_id], "score", keys, k)


def top_k(df: DataFrame, query: Sequence[str], score: str, keys: Sequence[str], k: int) -> DataFrame:
    """The k best rows per query with their ``rank``; the limit is pushed below the shuffle."""
    window = Window.partitionBy(*query).orderBy(F.col(score).desc_nulls_last(), *[F.col(key) for key in keys])
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def limit_top(df: DataFrame, score: str, keys: Sequence[str], k: int) -> DataFrame:
    """The k best rows of the whole table (O2); Spark keeps k rows per task and merges them."""
    return df.orderBy(F.col(score).desc_nulls_last(), *[F.col(key) for key in keys]).limit(k)


def score_pairs(pairs: DataFrame, query_vector: str, corpus_vector: str, matches: dict[str, tuple[str, str, float]]) -> DataFrame:
    """Score given (query, case) pairs in native expressions; used where the pairs are already known."""
    score = dot(query_vector, corpus_vector)
    for left, right, weight in matches.values():
        score = score + match_bonus(left, right, weight)
    return pairs.withColumn("score", score)


def search(queries: DataFrame, corpus: DataFrame, query_id: str, keys: Sequence[str], k: int = K.SEARCH_TOP_K, carry: Sequence[str] = ()) -> DataFrame:
    """Cases to show for a query: similar, and preferably same category, same place and far-reaching (V3)."""
    return nearest(queries, corpus, query_id, keys, k, SEARCH_BONUS, carry)


def plan_score(
    queries: DataFrame,
    corpus: DataFrame,
    query_id: str,
    keys: Sequence[str],
    score: str = "pv_score",
    k: int = K.NEIGHBORS,
    bonus: Bonus = SCORE_BONUS,
) -> DataFrame:
    """Median outcome of the k nearest cases of a query, NULL where there is none (V4).

    Reach earns no bonus here, or well-known cases would be near everything. The median is taken over
    at most k rows, so the aggregate buffer is bounded.
    """
    asked = materialize(queries.select(query_id, *bonus.matches, "embedding"), "queries")
    near = nearest(asked, corpus, query_id, keys, k, bonus, [score], stored=True)
    medians = near.groupBy(query_id).agg(F.median(score).alias("plan_score"))
    return asked.select(query_id).join(medians, query_id, "left")


def with_frequency(media: DataFrame, frequency: DataFrame, outlet: str) -> DataFrame:
    """Add the number of cases an outlet appears in, 1 when it was never counted."""
    return media.join(frequency, outlet, "left").withColumn("case_count", F.coalesce("case_count", F.lit(1)))


def distinctive(
    cases: DataFrame,
    media: DataFrame,
    frequency: DataFrame,
    total: DataFrame,
    query_id: str,
    keys: Sequence[str],
    outlet: str,
    per_case: int = K.OUTLETS_PER_CASE,
    overall: int = K.OUTLETS_OVERALL,
) -> tuple[DataFrame, DataFrame]:
    """Outlets typical of a case set: per case, and for the set as a whole.

    Score = cases of the set that the outlet took, times its rarity. Outlets that took more than half of
    the set (but more than one case) would have taken anything and are dropped. Name settles ties.
    """
    members = materialize(cases.select(query_id, *keys), "cases")
    asked = rows_of(media.select(*keys, outlet), keys, members.select(*keys))
    taken = materialize(members.join(asked, list(keys)), "taken")
    sizes = members.groupBy(query_id).agg(F.count(F.lit(1)).alias("__cases"))
    hits = taken.groupBy(query_id, outlet).agg(F.count(F.lit(1)).alias("hits"))
    rare = (
        with_frequency(hits.join(sizes, query_id), frequency, outlet)
        .where(F.col("hits") <= F.greatest(F.col("__cases") * F.lit(K.UBIQUITOUS_RATIO), F.lit(1.0)))
        .withColumn("__total", total.select("case_count").scalar())
        .where(F.col("__total") > 0)
        .withColumn("score", F.round(F.col("hits") * rarity("__total", "case_count"), SCORE_DECIMALS))
        .select(query_id, outlet, "hits", "score")
    )
    scored = materialize(rare, "outlet-scores")
    by_set = top_k(scored, [query_id], "score", [outlet], overall)
    by_case = top_k(
        taken.join(scored.select(query_id, outlet, "score"), [query_id, outlet]),
        [query_id, *keys],
        "score",
        [outlet],
        per_case,
    )
    return by_case, by_set


def rerank(
    cases: DataFrame,
    query_id: str,
    matches: dict[str, tuple[str, str]],
    open_count: str,
    score: str = "score",
    rank: str = "rank",
    k: int = K.SEARCH_TOP_K,
) -> DataFrame:
    """Lift cases of the same category and place when a draft has many open fields (O3).

    ``matches`` maps a label to (query column, case column). Each match adds 0.02 per open field; equal
    scores keep their earlier order; ``k`` rows remain per query.
    """
    weight = F.col(open_count) * F.lit(K.SPARSE_BONUS)
    lifted = F.col(score)
    for left, right in matches.values():
        lifted = lifted + weight * F.coalesce(F.col(left) == F.col(right), F.lit(False)).cast("int")
    window = Window.partitionBy(query_id).orderBy(F.col("lifted").desc(), F.col(rank))
    return (
        cases.withColumn("lifted", F.round(lifted, SCORE_DECIMALS))
        .withColumn("new_rank", F.row_number().over(window))
        .where(F.col("new_rank") <= k)
    )
