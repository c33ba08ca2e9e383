"""Convergence: entities that several agents flag independently.

Of each entity and agent the strongest signal counts (of equal ones the
earliest). Their risks are summed as decimals, weighted if the entity lies on
the critical path, and compared with a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import first_by

# Threshold, weight, and how many alerted entities make a storm.
THRESHOLD, CRITICAL_WEIGHT, STORM_ENTITIES = 0.65, 1.5, 3
_RISK = "decimal(10,6)"


def strongest_signals(events: DataFrame, order: str = "seq") -> DataFrame:
    """One row an entity and agent, INFO left out."""
    signals = events.where(F.coalesce(F.col("severity") != "INFO", F.lit(True)))
    return first_by(signals, ["entity_id", "agent"], F.col("risk_score").desc_nulls_last(), F.col(order).asc())


def convergence_scores(events: DataFrame, critical: DataFrame, order: str = "seq", threshold: float = THRESHOLD) -> DataFrame:
    """``entity_id, agents, n_agents, score, on_critical_path`` of entities over the threshold.

    ``critical`` has the ``entity_id`` of those on the critical path.
    """
    per_agent = strongest_signals(events, order)
    # The first aggregation keeps the window's partitioning by entity and agent apart; sums are partial before the shuffle.
    summed = per_agent.groupBy("entity_id").agg(
        F.sum(F.col("risk_score").cast(_RISK)).alias("total"), F.count("*").alias("n_agents"), F.array_sort(F.collect_set("agent")).alias("agents"), F.min(order).alias("first_seen")
    ).where(F.col("n_agents") >= 2)
    flagged = summed.join(critical.select("entity_id").distinct().withColumn("on_critical_path", F.lit(True)), "entity_id", "left")
    flagged = flagged.withColumn("on_critical_path", F.coalesce("on_critical_path", F.lit(False)))
    weight = F.when(F.col("on_critical_path"), F.lit(CRITICAL_WEIGHT)).otherwise(F.lit(1.0)).cast("decimal(3,1)")
    scored = flagged.withColumn("score", F.round(F.col("total") * weight, 3).cast("double"))
    return scored.where(F.col("score") >= threshold).select("entity_id", "agents", "n_agents", "score", "on_critical_path", "first_seen")


def alerts(events: DataFrame, critical: DataFrame, delay_days: Column | None = None, order: str = "seq") -> DataFrame:
    """Alerts by falling score (equal ones in the log's order), each with its signals by agent and the exposure."""
    from ..functions.rules import PENALTY_PER_DAY, exposure

    scores = convergence_scores(events, critical, order)
    signal = F.struct("event_type", "severity", "risk_score", "description", "ts")
    signals = strongest_signals(events, order).groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", signal.alias("signal"))))).alias("agent_signals"))
    delay = delay_days if delay_days is not None else F.lit(0)
    told = scores.join(signals, "entity_id").withColumns(
        {
            "criticality_weight": F.when(F.col("on_critical_path"), CRITICAL_WEIGHT).otherwise(1.0),
            "threshold": F.lit(THRESHOLD),
            "delay_days": delay,
            "penalty_per_day": F.lit(PENALTY_PER_DAY),
            "exposure": exposure(delay),
            "narrative": F.concat(F.col("entity_id"), F.lit(" flagged independently by "), F.array_join("agents", ", "), F.lit(" (score "), F.col("score").cast("string"), F.lit(")")),
            "mitigation_options": F.transform(F.slice(F.map_values("agent_signals"), 1, 3), lambda s: F.substring(s["description"], 1, 120)),
        }
    )
    return told.orderBy(F.col("score").desc(), "first_seen")


def risk_storm(scores: DataFrame) -> DataFrame:
    """One row: how many entities converge, and whether that is a storm."""
    return scores.agg(F.count("*").alias("n_entities")).withColumn("risk_storm", F.col("n_entities") >= STORM_ENTITIES)


def candidates(events: DataFrame) -> DataFrame:
    """Entities that two or more agents mention at all, INFO included, with the agents in order."""
    return events.groupBy("entity_id").agg(F.array_sort(F.collect_set("agent")).alias("agents")).where(F.size("agents") >= 2)
