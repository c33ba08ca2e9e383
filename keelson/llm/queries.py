"""The registered queries: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, html_extraction, jaccard_join, language_id, lexical_search, line_dedup, merkle_manifest, nearest_neighbours, packing, quality_classifier, quality_rules, sentencepiece_codec, url_filters
from .common import table

#: Vocabulary files are read where the library that brings them has them.
WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary(PIECE_VOCABULARY)
    encoded = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), model)
    covered = F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long")
    return sentencepiece_codec.digests(encoded.withColumn("n_bytes", covered), model, keep=("doc_id", "n_bytes"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "text", "n_lines", "n_dropped")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), url_filters.block_list(spark))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verify_documents(table(spark, sf_dir, "documents"))


def op13_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary(WORD_VOCABULARY)
    return bpe_automaton.digests(bpe_automaton.encode(table(spark, sf_dir, "documents"), model), model)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_sentencepiece,
        op3_html_extraction,
        op4_best_fit_packing,
        op5_quality_classifier,
        op6_ngram_jaccard_join,
        op7_language_id,
        op8_nearest_neighbours,
        op9_line_dedup,
        op10_url_filters,
        op11_lexical_search,
        op12_merkle_manifest,
        op13_bpe_automaton,
    )
}
ORACLE_SQL = {
    "op6_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
    "op9_line_dedup": line_dedup.ORACLE_SQL,
    "op10_url_filters": url_filters.ORACLE_SQL,
    "op11_lexical_search": lexical_search.ORACLE_SQL,
    "op12_merkle_manifest": merkle_manifest.ORACLE_SQL,
}
