"""The registered queries of this folder, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newsreach.llm import (
    ann, fingerprints, html_text, language, lexical, licenses, near_duplicates, packing, periodic, pieces, quality, toxicity, warc,
)
from newsreach.llm.rows import table

#: Where the public tokenizers' vocabularies lie; parameters of the operators that read them.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_pruned_graph_search(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), every=20, k=20)


def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.classify(docs, quality.fit_from_labels(docs, table(spark, folder, "labels")))


def op4_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), WORD_BPE)


def op5_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op6_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compared(table(spark, folder, "documents"))


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"), PIECE_MODEL)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.classify(docs, toxicity.fit_from_labels(docs, table(spark, folder, "labels")))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).drop("places")


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.fit_from_documents(docs))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(table(spark, folder, "pages"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(table(spark, folder, "documents"), echo=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pruned_graph_search": op1_pruned_graph_search,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_toxicity": op8_toxicity,
    "op9_license_scan": op9_license_scan,
    "op10_language_id": op10_language_id,
    "op11_ranked_search": op11_ranked_search,
    "op12_html_text": op12_html_text,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {"op11_ranked_search": lexical.RANKED_SQL}
