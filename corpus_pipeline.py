"""Corpus pipeline: quality filter, language filter, near-duplicate removal, packing.

Every stage works on all that its predecessor kept, written as Parquet and read again. All but the last return the
columns of their input unchanged; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsreach.llm import language, packing, quality, similar_texts
from newsreach.llm.queries import WORD_BPE
from newsreach.llm.rows import table
from newsreach.sources.workspace import materialize

#: A document is kept if it is likelier good than this.
KEEP_QUALITY = 0.5

#: The stages learn and iterate; SQL cannot express them. The tests hold each against a plain version.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of ``sf_dir``, does not reject.

    NULL and empty texts have the score of a text without words and stay or go by it like any other.
    """
    model = quality.fit_from_labels(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(model) >= KEEP_QUALITY)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that ``lang`` names, as far as the text shows.

    Texts without any letter (or NULL) are rejected, and those whose loss against the nearest codeword is beyond what
    998 in 1000 documents of known languages stay within, short and long ones apart, held-out ones not counted. Without any
    label all texts with letters stay.
    """
    model = language.fit_from_documents(docs)
    if not model.classes:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    found = language.with_loss(model, docs)
    return found.where(language.accepted(language.loss_limits(found))).drop("__loss", "__short")


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that five-word shingles at a similarity of 0.8 link: that of least doc_id, then words.

    Pairs are proposed by SimHash and, as its two bits do not reach that similarity, by MinHash bands; the sets decide.
    Groups are groups of rows, so rows without doc_id and different texts under one doc_id lose nothing. A NULL doc_id is
    the greatest. Of rows with the same doc_id and words the one of least text stays. Texts without words (NULL, empty) are one group.
    """
    marked = materialize(similar_texts.similar_texts(docs), "similar-rows")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    least = materialize(marked.groupBy("root").agg(F.min(rank).alias("least")), "least-rows").select("root", F.col("least.doc_id").alias("id"), F.col("least.key").alias("kept"))
    rows = marked.join(least, "root").where(F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("kept")))
    chosen = materialize(rows.groupBy(F.col("id").alias("__id"), F.col("kept").alias("__kept")).count(), "kept-rows")
    keyed = docs.withColumn("__key", similar_texts.key_column())

    def kept(which: DataFrame) -> DataFrame:
        return keyed.join(which.drop("count"), (F.col("__key") == F.col("__kept")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi")

    once = kept(chosen.where("count = 1")).drop("__key")
    repeated = kept(chosen.where("count > 1"))
    first = repeated.groupBy("__key", F.col("doc_id").alias("__id")).agg(F.min_by(F.struct(*docs.columns), F.struct("text")).alias("row"))
    return once.union(first.select("row.*"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, WORD_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("language", language_filter),
    ("near_duplicates", near_duplicate_filter),
    ("packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
