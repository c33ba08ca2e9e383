"""The corpus pipeline: five stages, each on all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written and reread as the next one's ``docs``. All but the last return the
columns of ``documents``; where a stage works beside them, they have positional
names meanwhile, so that no name of theirs can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import jaccard_join, line_dedup, packing, quality_classifier, quality_rules
from keelson.llm.common import scratch, table
from keelson.llm.queries import WORD_VOCABULARY, vocabulary


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns ``_0``, ``_1`` and so on, and what each was called (the first of a name)."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(reversed(docs.columns), reversed(names), strict=True))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality."""
    rows, name = _numbered(docs)
    judged = quality_classifier.classify_quality(rows, table(spark, sf_dir, "labels"), keep=tuple(rows.columns), doc_id=name["doc_id"], text=name["text"])
    return judged.where("predicted = 1").select(*rows.columns).toDF(*docs.columns)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    rows, name = _numbered(docs)
    judged = quality_rules.quality_rules(rows, name["text"], keep=tuple(rows.columns), doc_id=name["doc_id"], groups=(name["lang"], name["source"]))
    return judged.where("kept").select(*rows.columns).toDF(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source. Copies count once: the next stage removes them."""
    rows, name = _numbered(docs)
    cut = line_dedup.drop_boilerplate(rows, name["source"], name["text"], copies_once=True)
    if n_chars := name.get("n_chars"):
        cut = cut.withColumn(n_chars, F.when(F.col("n_dropped") > 0, F.length(name["text"])).otherwise(F.col(n_chars)).cast(docs.schema["n_chars"].dataType))
    return cut.select(*rows.columns).toDF(*docs.columns)


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document of the smallest id (of ids alike or null, any one).

    A document is what has one id and one text: it is joined by a hash of both,
    so different texts that share an id are judged each, and rows that repeat an
    id and its text are one. Null ids come last.
    """
    key = F.xxhash64("doc_id", "text")
    ids = jaccard_join.jaccard_components(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"))
    by_key = ids.groupBy("key").agg(F.min("group").alias("group"), F.count("*").alias("n"))
    several = by_key.groupBy("group").agg(F.sum("n").alias("rows")).where("rows > 1")
    members = scratch(by_key.join(several, "group").select("key", "group", "n"), "members")
    hint = F.broadcast if members.count() <= jaccard_join.BROADCAST_ROWS else lambda df: df
    named = docs.select(key.alias("key"), "doc_id").join(hint(members), "key").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    stays = named.select(F.col("first.key").alias("key"), F.lit(True).alias("stays"))
    members = scratch(members.join(stays, "key", "left").select(F.col("key").alias("__key"), F.coalesce("stays", F.lit(False)).alias("__stays"), F.col("n").alias("__n")), "members")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), key.alias("__key")).join(hint(members), "__key", "left").where("__stays or __stays is null")
    once = rows.where("__n > 1").dropDuplicates(["__key"])
    return rows.where("__n = 1 or __n is null").unionByName(once).select("__row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in the sequences."""
    return packing.pack(docs, vocabulary(WORD_VOCABULARY))


STAGES = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", jaccard_join_stage),
    ("best_fit_packing", packing_stage),
]
#: SQL can express neither the classifier nor the packing; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = scratch(docs, name)
    return docs
