"""Texts that share most of their shingles: SimHash and MinHash bands propose pairs, the exact Jaccard similarity decides.

A text is known by its key, a hash of its words, so exact copies are one text from the start. Its shingles are runs of
``width`` words. Each of ``BANDS`` bands hashes the least values of ``ROWS`` hash functions over the shingles; texts
that agree in a band are candidates, and so are those that the SimHash links of ``near_duplicates`` join. By bands a pair at similarity s is proposed with probability 1 - (1 - s ** ROWS) ** BANDS:
0.99994 at 0.8, more above. Candidates are linked only if their shingle sets reach the similarity themselves.

A crowd that shares a band is first compared with single members, which joins near copies in as many comparisons as
there are texts. Of what stays apart (light edits of one short text, say) two texts are compared only if they share one
of their rarest shingles: of sets x and y at similarity s, ordered by how many of these texts hold each shingle, the
first of the shared ones is among the first |x| - ceil(s |x|) + 1 of x, and as many of y. Unlike texts of a crowd
begin with their own edits and never meet. Texts travel as sets of hashed shingles, counted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsreach.llm.components import connected_components
from newsreach.llm.near_duplicates import fingerprint, links, words_of
from newsreach.llm.rows import lean
from newsreach.sources.workspace import materialize

WIDTH = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 6
SEED = 42
#: Rounds that compare each crowd with one member, before what is not joined by then is compared by rare shingles.
STARS = 2
#: Shingles in more than one of this many of the compared texts are dealt apart; there are few of them.
HOT_SHINGLES = 1000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def key_column(text: str = "text") -> Column:
    """Key of each row's words as a long; texts without words (or NULL) share one."""

    @F.pandas_udf("long")
    @lean
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            keys = [xxhash.xxh64_intdigest(b" ".join(words_of(x or "")), SEED) for x in batch]
            yield pd.Series(np.array(keys, np.uint64).view(np.int64))

    return compute(F.col(text))


def mixed(values: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, which spreads every bit over all others."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the runs of ``width`` words, ascending; a shorter text is one run, one without words has none."""
    words = words_of(text or "")
    if not words:
        return np.zeros(0, np.uint64)
    digests = {word: xxhash.xxh64_intdigest(word, SEED) for word in set(words)}
    single = np.fromiter(map(digests.__getitem__, words), np.uint64, len(words))
    count = max(1, len(words) - width + 1)
    runs = np.full(count, min(width, len(words)), np.uint64)
    for at in range(min(width, len(words))):
        runs = mixed(runs * _MULTIPLIER + single[at : at + count])
    return np.unique(runs)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def bands(values: np.ndarray) -> np.ndarray:
    """One long per band for the shingle hashes of a text, which has at least one."""
    factors, offsets = _functions()
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(values), 2048):
        least = np.minimum(least, (values[at : at + 2048, None] * factors + offsets).min(axis=0))
    least = mixed(least).reshape(BANDS, ROWS)
    found = np.arange(BANDS, dtype=np.uint64)
    for row in range(ROWS):
        found = mixed(found * _MULTIPLIER + least[:, row])
    return found.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def marked_rows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key, SimHash fingerprint and band values (none for a text without words) of every row, in one pass over the texts."""

    @lean
    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, values, prints = [], [], []
            for text in batch["text"]:
                prints.append(fingerprint(text))
                keys.append(xxhash.xxh64_intdigest(b" ".join(words_of(text or "")), SEED))
                found = shingles(text, width)
                values.append(bands(found) if len(found) else found.view(np.int64))
            if keys:
                yield pd.DataFrame({"doc": batch["doc"], "known": batch["known"], "key": np.array(keys, np.uint64).view(np.int64), "fingerprint": np.array(prints, np.uint64).view(np.int64), "values": values})

    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.col("doc_id").isNotNull().alias("known"), F.col("text").cast("string").alias("text"))
    found = plain.mapInPandas(compute, "doc long, known boolean, key long, fingerprint long, values array<long>")
    return found.select(F.when(F.col("known"), F.col("doc")).alias("doc_id"), "key", "fingerprint", "values")


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """key, size and hashes (as bytes, ascending) of the shingle set of each row of ``texts`` (key, text)."""

    @lean
    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(x, width) for x in batch["text"]]
            if sets:
                yield pd.DataFrame({"key": batch["key"], "size": [len(x) for x in sets], "shingles": [x.tobytes() for x in sets]})

    return texts.mapInPandas(compute, "key long, size long, shingles binary")


def shared(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose ``sets`` (key, size, shingles) reach the similarity ``least``."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(batch["first"], batch["second"])]
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    first = sets.select(F.col("key").alias("a"), F.col("size").alias("m"), F.col("shingles").alias("first"))
    second = sets.select(F.col("key").alias("b"), F.col("size").alias("n"), F.col("shingles").alias("second"))
    met = pairs.join(second, "b").join(first, "a").where((F.col("m") >= least * F.col("n")) & (F.col("n") >= least * F.col("m")))
    return met.select("a", "b", "first", "second").mapInPandas(check, "a long, b long")


def rare_pairs(rest: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of keys of ``rest`` (key, root) with different roots that share one of their rarest shingles.

    Rarity counts the texts of ``rest`` alone. Among the pairs is every one that reaches the similarity ``least``.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1000):
                rows = batch.iloc[start : start + 1000]
                yield pd.DataFrame({
                    "key": np.repeat(rows["key"].to_numpy(np.int64), rows["size"]), "root": np.repeat(rows["root"].to_numpy(np.int64), rows["size"]),
                    "size": np.repeat(rows["size"].to_numpy(np.int64), rows["size"]), "shingle": np.frombuffer(b"".join(rows["shingles"]), np.int64),
                })

    named = rest.join(sets, "key")
    each = materialize(named.mapInPandas(spread, "key long, root long, size long, shingle long"), "rest-shingles")
    held = materialize(each.groupBy("shingle").agg(F.count("*").alias("texts")), "shingle-texts")
    texts = rest.count()
    # Each is in more than a thousandth of the texts, but a shingle set of bounded texts has few such; the size is checked.
    hot = materialize(held.where(F.col("texts") > max(texts // HOT_SHINGLES, 1000)), "hot-shingles")
    few = hot.count() <= 1_000_000
    common = F.broadcast(hot) if few else hot
    counted = each.join(common, "shingle").union(each.join(common.select("shingle"), "shingle", "left_anti").join(held, "shingle").select("shingle", "key", "root", "size", "texts"))
    order = Window.partitionBy("key").orderBy("texts", "shingle")
    placed = counted.withColumn("place", F.row_number().over(order))
    first = placed.where((F.col("place") <= F.col("size") - F.ceil(least * F.col("size")) + 1) & (F.col("texts") > 1))
    left = materialize(first.select("shingle", "key", "root", "size", "place"), "rare-shingles")
    right = left.select("shingle", *[F.col(x).alias(f"other_{x}") for x in ("key", "root", "size", "place")])
    met = left.join(right, "shingle").where("key < other_key and root <> other_root")
    # What both can share from here on, against what the similarity asks for.
    most = 1 + F.least(F.col("size") - F.col("place"), F.col("other_size") - F.col("other_place"))
    needed = F.lit(least / (1 + least)) * (F.col("size") + F.col("other_size"))
    return met.where(most >= needed - 1e-6).select(F.col("key").alias("a"), F.col("other_key").alias("b")).distinct()


def simhash_values(marked: DataFrame) -> DataFrame:
    """(value, key) of the texts with words of ``marked``: one value for all that SimHash links of at most 2 bits hold together."""
    prints = materialize(marked.where(F.size("values") > 0).select("key", "fingerprint").distinct(), "simhash")
    joined = connected_components(links(prints)).withColumnRenamed("node", "fingerprint")
    return prints.join(joined, "fingerprint", "left").select(F.xxhash64(F.lit("simhash"), F.coalesce("root", "fingerprint")).alias("value"), "key")


def roots(marked: DataFrame, docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """(key, root) of every key of ``marked`` (key, fingerprint, values) that is linked to another; the root is the smallest key.

    Links are the pairs of candidates with a similarity of ``least`` or more. A crowd is first compared with single
    members, so a group of near copies is joined in as many comparisons as it has texts; what remains apart is
    compared where its rarest shingles meet. Only texts of ``docs`` (key, text) that share a band are read again.
    """
    banded = marked.select("key", F.explode("values").alias("value")).select("value", "key")
    values = materialize(banded.union(simhash_values(marked)).distinct(), "band-values")
    crowds = values.groupBy("value").count().where("count > 1").select("value")
    members = materialize(values.join(crowds, "value").withColumn("root", F.col("key")), "band-members")
    candidates = members.select("key").distinct()
    texts = docs.select("key", "text").join(candidates, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    sets = materialize(sets_of(texts, width), "candidates")
    similar = found = None
    for turn in range(STARS + 1):
        centre = F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("h"), "key", "root")).alias("centre")
        apart = members.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high"), centre).where("low < high")
        if turn < STARS:
            met = members.join(apart, "value").where("root <> centre.root").select(F.col("centre.key").alias("x"), F.col("key").alias("y"))
            pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        else:
            rest = materialize(members.join(apart.select("value"), "value").select("key", "root").distinct(), "band-rest")
            pairs = rare_pairs(rest, sets, least)
        new = materialize(shared(pairs, sets, least), "similar")
        similar = new if similar is None else similar.union(new)
        found = materialize(connected_components(similar), "roots")
        if turn < STARS:
            named = found.withColumnRenamed("node", "key")
            members = materialize(members.drop("root").join(named, "key", "left").select("value", "key", F.coalesce("root", "key").alias("root")), "band-members")
    return found.select(F.col("node").alias("key"), "root")


def similar_texts(docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """doc_id, key, root of every row: rows with one root are copies or near copies of each other, over one or more links."""
    marked = materialize(marked_rows(docs, width), "keys")
    keyed = docs.select(key_column().alias("key"), F.col("text").cast("string").alias("text"))
    return marked.select("doc_id", "key").join(roots(marked, keyed, width, least), "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))
