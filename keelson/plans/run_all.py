"""All analyses of a project in order: compliance, schedule, supply and their convergence.

Each stage is a set of transformations; the events that they give are the only
thing handed on. A derivation replaces the events of the one before.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import milestone_risk, milestone_severity, slip_risk, slip_severity
from ..functions.scalars import tags_in
from ..operators import compliance, convergence, delivery, graph, schedule
from ..operators.events import by_agent, without_agents
from ..sources.store import scratch

AGENTS = ("SPECTRA", "CHRONOS", "TRACIS")
_FIELDS = ("event_type", "entity_id", "entity_type", "severity", "description", "risk_score")


def timed(stages: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Run stages one after the other: their written results, and ``stage, seconds`` (a row each)."""
    results, rows = {}, []
    for name, stage in stages.items():
        begin = time.monotonic()
        results[name] = scratch(stage(), name)
        rows.append((name, time.monotonic() - begin))
    spark = SparkSession.active()
    return results, spark.createDataFrame(rows, "stage string, seconds double")


@dataclass
class Reports:
    """What an analysis gives; every field is a DataFrame."""

    deviations: DataFrame
    compliant: DataFrame
    forecast: DataFrame
    driving_path: DataFrame
    slips: DataFrame
    late_activities: DataFrame
    simulation: DataFrame
    deliveries: DataFrame
    events: DataFrame
    alerts: DataFrame


def _events(rows: DataFrame, agent: str, **fields: Column) -> DataFrame:
    return by_agent(rows.select(*(fields[f].alias(f) for f in _FIELDS)), agent)


def analyse(activities: DataFrame, links: DataFrame, requirements: DataFrame, parameters: DataFrame, log: DataFrame, data_date: Column, milestone: str, tag: str, trials: int = schedule.TRIALS) -> Reports:
    """Run the agents on a project's facts and reconcile their events with the rest of the log."""
    spark = activities.sparkSession
    compared = compliance.comparisons(requirements, parameters)
    deviating = compliance.deviations(compared)
    worst = compliance.overall(deviating).where("n_deviations > 0")
    found = _events(
        worst, "SPECTRA", event_type=F.lit("spec_deviation"), entity_id=F.lit(tag), entity_type=F.lit("Equipment"), severity=F.when(F.col("overall_risk") >= 0.9, "CRITICAL").otherwise("MAJOR"),
        description=F.concat(F.col("n_deviations").cast("string"), F.lit(" spec deviation(s)")), risk_score=F.col("overall_risk"),
    )

    work = schedule.remaining_durations(activities, data_date)
    passed = schedule.forward_pass(work, links, data_date)
    path = schedule.driving_path(passed, milestone)
    slipped = schedule.slips(passed, activities, data_date)
    origin = schedule.slip_origin(path, slipped)
    baseline = activities.where(F.col("task_code") == milestone).select("target_end").first()["target_end"]
    simulated = schedule.simulation_summary(schedule.simulate_finish(spark, activities, links, data_date, milestone, trials), data_date, F.lit(baseline))
    late = _events(
        simulated, "CHRONOS", event_type=F.lit("milestone_at_risk"), entity_id=F.lit(milestone), entity_type=F.lit("Milestone"), severity=milestone_severity(F.col("breach")),
        description=F.concat(F.lit("P90 "), F.col("p90_date").cast("string"), F.lit(" vs baseline "), F.lit(str(baseline))), risk_score=milestone_risk(F.col("breach")),
    )
    tagged = origin.where("slip > 0").join(activities.select(F.col("task_code").alias("origin"), F.explode(tags_in(F.col("name"))).alias("tag")), "origin")
    driven = _events(
        tagged, "CHRONOS", event_type=F.lit("schedule_slip"), entity_id=F.col("tag"), entity_type=F.lit("Equipment"), severity=slip_severity(F.col("slip")),
        description=F.concat(F.col("origin"), F.lit(" slipped "), F.format_string("%+.0f", "slip"), F.lit(" workdays on the driving path to "), F.col("milestone")), risk_score=slip_risk(F.col("slip")),
    )

    named = activities.withColumn("seq", F.monotonically_increasing_id()).select("*", F.explode(tags_in(F.col("name"))).alias("tag"), F.col("name").rlike(delivery.DELIVERY).alias("is_delivery"))
    deliveries = delivery.delivery_report(delivery.delivery_buffers(named))
    waiting = _events(
        deliveries.where("severity <> 'ON_TRACK'"), "TRACIS", event_type=F.lit("delivery_at_risk"), entity_id=F.col("tag"), entity_type=F.lit("Equipment"), severity=F.col("severity"), description=F.col("alert"), risk_score=F.col("risk_score")
    )

    fresh = found.unionByName(late).unionByName(driven).unionByName(waiting).withColumns({"ts": F.current_timestamp(), "seq": F.monotonically_increasing_id() + F.lit(1 << 40)})
    events = without_agents(log, list(AGENTS)).unionByName(fresh, allowMissingColumns=True)
    critical = activities.where("is_critical").select(F.explode(tags_in(F.col("name"))).alias("entity_id")).union(graph.final_milestone(activities).select("task_code"))
    delay = simulated.first()["expected_delay_days"]
    alerted = convergence.alerts(events, critical, F.lit(delay))
    return Reports(deviating, compared.where("compliant"), passed, path, slipped, schedule.late_activities(slipped, activities), simulated, deliveries, events, alerted)
