"""Rules that turn values to verdicts, severities and risks, as Column expressions.

Rounding is half-up on the decimal value throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import leading_number, tolerance, unit_factor

# Risks by severity, of deviations and of field reports; thresholds and rates.
DEVIATION_RISK = {"CRITICAL": 0.9, "MAJOR": 0.6, "MINOR": 0.3}
FIELD_RISK = {"CRITICAL": 0.9, "MAJOR": 0.7, "MINOR": 0.4}
FIELD_RISK_WITHOUT = 0.1
PENALTY_PER_DAY = 50_000.0
HOURS_PER_SUBMITTAL, HOURS_PER_RFI, HOURS_PER_ITP = 5.5, 0.75, 2.5
TRUE_TEXTS = ("true", "1", "yes", "y")
SYSTEM_OF_PREFIX = {"ELEC": "Electrical", "MECH": "Mechanical", "FIRE": "Fire Protection", "IT": "IT/Telecom", "TEL": "IT/Telecom", "CIV": "Civil", "STR": "Structural"}


def by_value(key: Column, values: dict[str, float | str], otherwise: float | str | Column | None = None) -> Column:
    chosen = None
    for name, value in values.items():
        chosen = F.when(key == name, F.lit(value)) if chosen is None else chosen.when(key == name, F.lit(value))
    return chosen.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def complies(comparison: Column, submitted: Column, required: Column, highest: Column, amount: Column, relative: Column) -> Column:
    """Whether a submitted number meets a requirement; null if it can't be compared."""
    margin = F.coalesce(F.when(relative, amount * required).otherwise(amount), F.lit(1e-9))
    return (
        F.when(comparison == "greater_equal", submitted >= required)
        .when(comparison == "less_equal", submitted <= required)
        .when(comparison == "equal", F.abs(submitted - required) <= margin)
        .when(comparison == "range", (submitted >= required) & (submitted <= F.coalesce(highest, required)))
    )


def margin_percent(submitted: Column, required: Column) -> Column:
    return F.round(F.when(required == 0, F.lit(0.0)).otherwise(F.try_divide(F.abs(submitted - required), F.abs(required)) * 100), 2)


def with_comparison(rows: DataFrame, requirement: str = "", parameter: str = "submitted_") -> DataFrame:
    """``rows`` with the columns of a comparison, from those of a requirement and (prefixed) a parameter.

    Numbers and tolerance are parsed, and the units' factor looked up, once a
    row: they are elements of an array that is exploded, as the optimiser would
    otherwise write them out anew wherever they are used.
    """
    r, p = (lambda c: F.col(f"{requirement}{c}")), (lambda c: F.col(f"{parameter}{c}"))
    amount, relative = tolerance(r("tolerance"))
    parsed = F.struct(
        leading_number(p("value")).alias("submitted"), unit_factor(p("unit"), r("unit")).alias("factor"), leading_number(r("value")).alias("required"),
        leading_number(r("value_max")).alias("highest"), amount.alias("amount"), relative.alias("relative"),
    )
    rows = rows.select("*", F.explode(F.array(parsed)).alias("__n"))
    value, required = F.col("__n.submitted") * F.col("__n.factor"), F.col("__n.required")
    return rows.withColumns(
        {
            "submitted_value_num": F.col("__n.submitted"),
            "compared_value": F.round(value, 6),
            "required_value": required,
            "compliant": complies(r("comparison"), value, required, F.col("__n.highest"), F.col("__n.amount"), F.col("__n.relative")),
            "margin_pct": margin_percent(value, required),
        }
    ).drop("__n")


def deviation_risk(severity: Column, margin: Column) -> Column:
    """At most 1: the severity's risk and up to a tenth for the margin."""
    base = by_value(F.coalesce(severity, F.lit("MAJOR")), DEVIATION_RISK, DEVIATION_RISK["MAJOR"])
    return F.round(F.least(F.lit(1.0), base + F.least(margin, F.lit(50.0)) / 500), 3)


def overall_risk(risks: Column) -> Column:
    """Aggregate: the largest risk and 0.02 for each further one; 0 without any."""
    return F.coalesce(F.round(F.least(F.lit(1.0), F.max(risks) + 0.02 * (F.count(risks) - 1)), 3), F.lit(0.0))


def accepted(operator: Column, reading: Column, limit: Column, least: Column, most: Column, allowed: Column, expected: Column) -> Column:
    """Whether a reading (text) meets a step's acceptance criteria; null if its number can't be read."""
    number = reading.try_cast("double")
    return (
        F.when(operator == "boolean", F.lower(F.trim(reading)).isin(*TRUE_TEXTS) == expected)
        .when(operator == "less_equal", number <= limit)
        .when(operator == "greater_equal", number >= limit)
        .when(operator == "equal", F.abs(number - limit) <= F.coalesce(allowed, F.lit(0.0)))
        .when(operator == "range", (number >= least) & (number <= most))
    )


def delivery_severity(buffer_days: Column) -> Column:
    """By days between delivery and need; null where the delivery is on track."""
    return F.when(buffer_days < 0, "CRITICAL").when(buffer_days < 7, "HIGH").when(buffer_days < 14, "MEDIUM")


def delivery_risk(buffer_days: Column, critical: Column) -> Column:
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (14 - buffer_days) / F.lit(20.0)))
    return F.round(F.least(F.lit(0.95), (0.15 + 0.65 * share) * F.when(critical, 1.2).otherwise(1.0)), 3)


def milestone_risk(breach: Column) -> Column:
    return F.least(F.lit(1.0), 0.4 + 0.6 * breach)


def milestone_severity(breach: Column) -> Column:
    return F.when(breach > 0.5, "CRITICAL").otherwise("HIGH")


def slip_risk(slip: Column) -> Column:
    return F.least(F.lit(1.0), 0.3 + slip / F.lit(30.0) * 0.5)


def slip_severity(slip: Column) -> Column:
    return F.when(slip >= 10, "HIGH").otherwise("MEDIUM")


def exposure(delay_days: Column, rate: float = PENALTY_PER_DAY) -> Column:
    return F.coalesce(delay_days, F.lit(0)) * F.lit(rate)


def risk_band(risk: Column) -> Column:
    return F.when(risk >= 0.8, "critical").when(risk >= 0.6, "high").when(risk >= 0.3, "medium").otherwise("low")


def hours_saved(submittals: Column, rfis: Column, itps: Column) -> Column:
    return F.round(submittals * HOURS_PER_SUBMITTAL + rfis * HOURS_PER_RFI + itps * HOURS_PER_ITP, 1)


def completed_requirement() -> dict[str, Column]:
    """A requirement's optional columns where they were left out."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    prefix = F.split(F.coalesce("clause_id", F.lit("")), "-")[0]
    return {
        "parameter": F.coalesce(blank("parameter"), blank("canonical_parameter"), F.lit("unspecified")),
        "mandatory": F.coalesce("mandatory", F.coalesce(F.col("criticality").isin("CRITICAL", "MAJOR"), F.lit(False))),
        "system": F.coalesce(blank("system"), by_value(prefix, SYSTEM_OF_PREFIX), F.nullif(prefix, F.lit("")), F.lit("General")),
    }


def parse_status(is_known: Column, is_parsed: Column, modified: Column, parsed: Column, self_refreshing: Column) -> Column:
    """Where a document stands: ``parsed`` is the earliest time of what was derived from it, null if nothing was."""
    return (
        F.when(~F.coalesce(is_known, F.lit(False)), "reference only")
        .when(~is_parsed, "on file")
        .when(parsed.isNull(), "not parsed yet")
        .when(modified > parsed, F.when(self_refreshing, "changed: derived again on the next run").otherwise("changed: rebuild to parse again"))
        .otherwise("parsed")
    )
