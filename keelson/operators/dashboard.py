"""Dashboard counters and reports: small aggregates, each over its own table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import hours_saved, risk_band
from .events import recent
from .graph import AT_RISK, critical_activities


def counters(nodes: DataFrame, alerts: DataFrame, events: DataFrame) -> DataFrame:
    """One row: equipment at risk, deviations, open RFIs and NCRs, alerts, events and hours saved.

    ``nodes`` (node_type, status, risk_score) is read once for all its counters.
    """
    kind, state = F.col("node_type"), F.lower(F.coalesce("status", F.lit("")))
    of_nodes = nodes.agg(
        F.count_if((kind == "Equipment") & (F.col("risk_score") > AT_RISK)).alias("equipment_at_risk"),
        F.count_if(kind == "Deviation").alias("open_deviations"),
        F.count_if((kind == "RFI") & (state == "open")).alias("open_rfis"),
        F.count_if((kind == "NCR") & (state != "closed")).alias("open_ncrs"),
        F.count_if(kind == "Submittal").alias("n_submittals"),
        F.count_if(kind == "RFI").alias("n_rfis"),
        F.count_if(kind == "ITPRecord").alias("n_itps"),
    )
    of_alerts, of_events = alerts.agg(F.count("*").alias("n_alerts")), events.agg(F.count("*").alias("n_events"))
    row = of_nodes.join(of_alerts).join(of_events)  # one row each
    return row.withColumn("hours_saved", hours_saved(F.col("n_submittals"), F.col("n_rfis"), F.col("n_itps")))


def empty_counters(spark) -> DataFrame:
    """The counters of a project without data."""
    return spark.range(1).select(*(F.lit(0).cast("long").alias(n) for n in ("equipment_at_risk", "open_deviations", "open_rfis", "open_ncrs", "n_alerts", "n_events")), F.lit(0.0).alias("hours_saved"))


def equipment_by_risk(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type = 'Equipment'").withColumn("band", risk_band(F.coalesce("risk_score", F.lit(0.0)))).orderBy(F.col("risk_score").desc_nulls_last(), "node_id")


def gantt_rows(activities: DataFrame) -> DataFrame:
    """Bars of a schedule: the dates drawn, and days by which the forecast end is after the target."""
    start, end = F.coalesce("actual_start", "early_start", "target_start"), F.coalesce("actual_end", "early_end", "target_end")
    rows = activities.withColumns({"bar_start": start, "bar_end": end, "slip_days": F.greatest(F.lit(0), F.coalesce(F.datediff(end, "target_end"), F.lit(0)))})
    return rows.where("bar_start is not null and bar_end is not null")


def time_domain(bars: DataFrame, padding: int = 7) -> DataFrame:
    return bars.agg(F.date_sub(F.min("bar_start"), padding).alias("domain_start"), F.date_add(F.max("bar_end"), padding).alias("domain_end"))


def month_ticks(domain: DataFrame) -> DataFrame:
    """The first days of months within a time domain."""
    months = F.sequence(F.trunc("domain_start", "month"), F.trunc("domain_end", "month"), F.expr("interval 1 month"))
    return domain.select(F.explode(months).alias("tick")).where("tick is not null")


def summary(nodes: DataFrame, activities: DataFrame, milestones: DataFrame, alerts: DataFrame, events: DataFrame, recent_events: int = 25) -> dict[str, DataFrame]:
    """The parts of the dashboard, each a table of its own.

    ``nodes`` (node_id, node_type, status, risk_score), ``milestones`` the
    simulated ones (node_id, p90 and what else is known of them).
    """
    return {
        "metrics": counters(nodes, alerts, events),
        "equipment": equipment_by_risk(nodes),
        "deviations": nodes.where("node_type = 'Deviation'"),
        "milestone": milestones.where("p90 is not null").orderBy("node_id").limit(1),
        "critical_path": critical_activities(activities),
        "alerts": alerts,
        "recent_events": recent(events, recent_events),
    }


def report(nodes: DataFrame, activities: DataFrame, milestones: DataFrame, alerts: DataFrame, events: DataFrame, most: int = 25) -> DataFrame:
    """``section, place, id, body``: the whole summary as one table, a section in its order after the other, bodies as JSON.

    Lists (equipment by risk, deviations, the critical path, alerts by score,
    the newest events) show their first ``most`` rows, the metrics count all. What
    there is none of has no rows.
    """
    parts = summary(nodes, activities, milestones, alerts, events, most)

    def section(name: str, id_: str, *order: Column) -> DataFrame:
        rows = parts[name]
        first = rows.orderBy(*order).limit(most) if order else rows
        place = F.row_number().over(Window.orderBy(*(order or (F.lit(1),))))  # over ``most`` rows
        return first.select(F.lit(name).alias("section"), place.alias("place"), (F.col(id_) if id_ else F.lit(None)).cast("string").alias("id"), F.to_json(F.struct("*")).alias("body"))

    sections = [
        section("metrics", ""),
        section("equipment", "node_id", F.col("risk_score").desc_nulls_last(), F.col("node_id")),
        section("deviations", "node_id", F.col("node_id")),
        section("milestone", "node_id"),
        section("critical_path", "task_code", F.col("early_start").asc_nulls_first(), F.col("task_code")),
        section("alerts", "entity_id", F.col("score").desc(), F.col("first_seen")),
        section("recent_events", "seq", F.col("seq").desc()),
    ]
    return reduce(DataFrame.unionByName, sections)
