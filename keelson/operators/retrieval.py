"""Retrieval: nearest vectors, clauses by shared words, questions to intents, upserts by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ids_in, words
from .events import first_by

# Words that don't count, and what a question must contain for an intent.
STOP_WORDS = ("the", "for", "ups", "what", "spec")
DELIVERY_WORDS = ("deliver", "eta", "supply", "lead time")
SPEC_WORDS = ("spec", "requirement", "clause", "shall", "autonomy", "require")
STATUS_WORDS = ("status", "submittal", "deviation")
NCR_WORDS = ("ncr", "non-conformance", "nonconformance")


def squared_distance(one: Column, other: Column) -> Column:
    """Squared Euclidean distance in double precision."""
    parts = F.zip_with(one, other, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def nearest_vectors(vectors: DataFrame, query: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to one query vector (a one-row table with ``query``): a top-k, not a sort."""
    near = vectors.join(F.broadcast(query.select("query").limit(1)))
    return near.withColumn("distance", squared_distance(F.col(vector), F.col("query"))).select(key, "distance").orderBy("distance", key).limit(k)


def sharing_words(rows: DataFrame, text: Column, question: Column) -> DataFrame:
    """Rows whose text shares a word with the question that is no stop word."""
    told = F.array_except(words(text), F.array(*map(F.lit, STOP_WORDS)))
    return rows.withColumn("shared", F.size(F.array_intersect(words(question), told))).where("shared > 0")


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for part in parts:
        test = test | text.contains(part)
    return test


def routed(questions: DataFrame, question: str = "question") -> DataFrame:
    """Questions with ``intent`` and the fact branches that answer them, additive ones included.

    The first three kinds exclude one another; deliveries and clauses add to
    them and name the intent only where nothing else does. Words are looked for
    as substrings.
    """
    q = F.lower(F.coalesce(F.col(question), F.lit("")))
    equipment = F.size(ids_in(F.coalesce(F.col(question), F.lit("")), "equipment")) > 0
    first = (
        F.when(q.contains("rfi") & (q.contains("critical") | q.contains("path")), "open_rfis_on_critical_path")
        .when(_any(q, NCR_WORDS), "open_ncrs")
        .when(equipment | _any(q, STATUS_WORDS), "equipment_status")
    )
    delivery, spec = _any(q, DELIVERY_WORDS), _any(q, SPEC_WORDS)
    named = F.coalesce(first, F.when(delivery, "deliveries_at_risk"), F.when(spec, "spec_requirement"), F.lit("general"))
    branches = F.array_compact(F.array(first, F.when(delivery, "deliveries_at_risk"), F.when(spec, "spec_requirement")))
    return questions.withColumns({"intent": named, "branches": branches})


def upserted(stored: DataFrame, fresh: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Stored rows, replaced and added to by key; of repeated fresh keys the last counts."""
    last = first_by(fresh, [key], F.col(order).desc())
    return stored.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def corpus(requirements: DataFrame, rfis: DataFrame, pages: DataFrame) -> DataFrame:
    """``id, document, metadata`` of what is indexed: clauses, RFIs and pages; empty texts and null metadata are left out."""
    meta = lambda **c: F.map_filter(F.create_map(*(x for k, v in c.items() for x in (F.lit(k), v.cast("string")))), lambda k, v: v.isNotNull())
    clauses = requirements.select(
        F.concat_ws("::", F.lit("spec"), "clause_id", F.coalesce("parameter", "canonical_parameter")).alias("id"), F.concat_ws(" ", "clause_id", "parameter", "source_text").alias("document"),
        meta(source=F.lit("specification"), clause_id=F.col("clause_id"), page=F.col("page")).alias("metadata"),
    )
    asked = rfis.select(
        F.concat_ws("::", F.lit("rfi"), "rfi_id").alias("id"), F.concat_ws(" ", "rfi_id", "subject", "question", "response").alias("document"), meta(source=F.lit("RFI register"), rfi_id=F.col("rfi_id")).alias("metadata")
    )
    read = pages.select(F.concat_ws("::", F.lit("page"), F.col("doc_id").cast("string"), F.col("page").cast("string")).alias("id"), F.col("text").alias("document"), meta(source=F.col("doc_id"), page=F.col("page")).alias("metadata"))
    return clauses.unionByName(asked).unionByName(read).where(F.length(F.trim("document")) > 0)
