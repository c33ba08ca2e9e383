"""Submitted parameters against requirements: matching, comparison, deviations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import deviation_risk, overall_risk, with_comparison
from ..functions.scalars import leading_number, unit_factor, words
from ..sources.store import scratch
from .events import first_by

LEAST_OVERLAP = 2


def governing(requirements: DataFrame, specified: DataFrame, tag: str) -> DataFrame:
    """Requirements that govern a tag: its clauses, or those that name it; all, if there are none.

    ``specified`` has ``clause_id, parameter`` of the tag's SPECIFIED_BY edges.
    """
    hit = requirements.join(specified.select("clause_id", "parameter").distinct().withColumn("__linked", F.lit(True)), ["clause_id", "parameter"], "left")
    hit = hit.withColumn("__hit", F.coalesce("__linked", F.lit(False)) | F.upper(F.coalesce("source_text", F.lit(""))).contains(tag.upper()))
    any_hit = hit.agg(F.coalesce(F.bool_or("__hit"), F.lit(False)).alias("__any"))
    return hit.join(F.broadcast(any_hit), F.col("__hit") | ~F.col("__any")).drop("__linked", "__hit", "__any")


def best_matches(requirements: DataFrame, parameters: DataFrame, req_key: str = "req", group: str | None = None) -> DataFrame:
    """Each requirement with the parameter that answers it best; without one it is absent.

    Of parameters with the requirement's canonical name, the one whose name
    shares most words, then one of a convertible unit, then the first. Without
    any, the same order over all that share ``LEAST_OVERLAP`` words or more.

    What decides is a name's words, the canonical name, the unit and whether a
    number is given, which recur: rows are first brought to their distinct kinds,
    a parameter's kind with its first row. Kinds are joined by equal canonical
    names, or by a pair of words within the group, so that a word that all names
    have adds nothing; of several pairs that two kinds share the first counts.
    """
    on = [group] if group else []
    kind = ["canon", "unit", "words", *on]
    shape = lambda df, *more: df.select(*on, F.col("canonical_parameter").alias("canon"), F.lower(F.trim("unit")).alias("unit"), F.array_sort(words(F.col("parameter"))).alias("words"), *more)
    req = shape(requirements, req_key)
    req_kinds = scratch(req.select(*kind).distinct().withColumn("r", F.monotonically_increasing_id()), "kinds")
    number = leading_number(F.col("value")).isNotNull().alias("number")
    par_kinds = scratch(shape(parameters, "seq", number).groupBy(*kind, "number").agg(F.min("seq").alias("seq")), "kinds")
    r = req_kinds.select("r", *on, F.col("canon").alias("r_canon"), F.col("unit").alias("r_unit"), F.col("words").alias("r_words"))
    p = par_kinds.select("seq", "number", *on, F.col("canon").alias("p_canon"), F.col("unit").alias("p_unit"), F.col("words").alias("p_words"))
    fits = F.col("number") & unit_factor(F.col("p_unit"), F.col("r_unit")).isNotNull()
    shared = F.array_intersect("r_words", "p_words")
    scored = lambda canonical: ["r", "seq", F.lit(canonical).alias("canonical"), F.size("shared").alias("overlap"), F.coalesce(fits, F.lit(False)).alias("fits")]
    named = r.where("r_canon <> ''").join(p.withColumnRenamed("p_canon", "r_canon"), [*on, "r_canon"]).withColumn("shared", shared).select(*scored(True))
    by_pair = lambda df, own: df.withColumn("pair", F.explode(F.flatten(F.transform(own, lambda a, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda b: F.concat(a, F.lit(" "), b))))))
    paired = by_pair(r, "r_words").join(by_pair(p, "p_words"), [*on, "pair"]).withColumn("shared", shared)
    paired = paired.where(F.col("pair") == F.array_join(F.slice("shared", 1, LEAST_OVERLAP), " ")).select(*scored(False))
    best = first_by(named.unionByName(paired), ["r"], F.col("canonical").desc(), F.col("overlap").desc(), F.col("fits").desc(), F.col("seq").asc())
    best = best.join(req_kinds, "r")
    same = reduce(lambda a, b: a & b, (req[k].eqNullSafe(best[k]) for k in kind))
    return req.join(best, same).select(req_key, "seq", "canonical", "overlap", "fits")


def comparisons(requirements: DataFrame, parameters: DataFrame, req_key: str = "req", group: str | None = None) -> DataFrame:
    """Requirements with their best parameter's columns (``submitted_``) and the comparison; incomparable ones are left out."""
    matched = best_matches(requirements, parameters, req_key, group).select(req_key, "seq")
    submitted = parameters.select("seq", *(F.col(c).alias(f"submitted_{c}") for c in ("parameter", "value", "unit", "page")))
    joined = requirements.join(matched, req_key).join(submitted, "seq")
    return with_comparison(joined).where(F.col("compliant").isNotNull())


def deviations(compared_rows: DataFrame) -> DataFrame:
    """The rows that don't comply, with severity and risk."""
    severity = F.coalesce("criticality", F.lit("MAJOR"))
    told = lambda *parts: F.trim(F.concat_ws(" ", *parts))
    return compared_rows.where(~F.col("compliant")).withColumns(
        {
            "severity": severity,
            "risk_score": deviation_risk(severity, F.col("margin_pct")),
            "required": told("comparison", "value", "unit"),
            "submitted": told(F.col("submitted_value_num").cast("string"), "submitted_unit"),
            "spec_text": F.substring(F.coalesce("source_text", F.lit("")), 1, 200),
        }
    )


def overall(deviating: DataFrame) -> DataFrame:
    return deviating.agg(F.count("*").alias("n_deviations"), overall_risk(F.col("risk_score")).alias("overall_risk"))


def narrative(deviating: DataFrame, tag: Column) -> DataFrame:
    """One row: the finding as text."""
    line = F.concat(F.col("clause_id"), F.lit(": submitted "), F.col("submitted"), F.lit(" vs required "), F.col("required"), F.lit(" ("), F.col("severity"), F.lit(")"))
    row = deviating.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("clause_id", line.alias("line")))), lambda x: x["line"]), "; ").alias("lines"))
    none = F.concat(F.lit("Submittal for "), tag, F.lit(" reviewed: all comparable parameters comply with the requirements."))
    return row.select(F.when(F.col("n") == 0, none).otherwise(F.concat(F.lit("Deviations found: "), F.col("lines"))).alias("narrative"))
