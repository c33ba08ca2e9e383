"""The event log: an append-only table, its filters, and the rules for what may enter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The severities an event may have.
SEVERITIES = ("CRITICAL", "HIGH", "MAJOR", "MEDIUM", "MINOR", "LOW", "INFO")
REQUIRED = ("agent", "event_type", "entity_id", "entity_type", "severity", "description", "risk_score")


def publishable(events: DataFrame) -> DataFrame:
    """``events`` as they enter the log; a missing field or an unknown severity fails the job."""
    if missing := set(REQUIRED) - set(events.columns):
        raise ValueError(f"events lack {sorted(missing)}")
    whole = F.lit(True)
    for name in REQUIRED:
        whole = whole & F.col(name).isNotNull()
    checked = F.when(~whole, F.raise_error(F.lit("an event lacks a required field"))).when(
        ~F.col("severity").isin(*SEVERITIES), F.raise_error(F.concat(F.lit("unknown severity "), F.col("severity")))
    )
    ts = F.col("ts") if "ts" in events.columns else F.lit(None).cast("timestamp")
    return events.withColumn("severity", F.coalesce(checked.cast("string"), F.col("severity"))).withColumn("ts", F.coalesce(ts, F.current_timestamp()))


def by_agent(rows: DataFrame, agent: str) -> DataFrame:
    """Rows of an agent's findings as events of that agent, risks rounded."""
    return rows.withColumn("agent", F.lit(agent)).withColumn("risk_score", F.round("risk_score", 3))


def select_events(events: DataFrame, entity: str | None = None, agent: str | None = None) -> DataFrame:
    if entity is not None:
        events = events.where(F.col("entity_id") == entity)
    return events.where(F.col("agent") == agent) if agent is not None else events


def recent(events: DataFrame, limit: int = 100, order: str = "seq") -> DataFrame:
    """The newest events, newest first: a top-k, so no full sort."""
    return events.orderBy(F.col(order).desc()).limit(limit)


def without_agents(events: DataFrame, agents: list[str]) -> DataFrame:
    return events.where(~F.coalesce(F.col("agent").isin(*agents), F.lit(False)) if agents else F.lit(True))


def matching(**fields: object) -> Column:
    """True where every field has its value; a null matches nothing."""
    test = F.lit(True)
    for name, value in fields.items():
        test = test & F.coalesce(F.col(name) == F.lit(value), F.lit(False))
    return test


def without_matching(events: DataFrame, **fields: object) -> DataFrame:
    return events.where(~matching(**fields))


def removed_count(events: DataFrame, **fields: object) -> DataFrame:
    """One row: how many rows ``without_matching`` leaves out."""
    return events.agg(F.count_if(matching(**fields)).alias("n_removed"))


def page(events: DataFrame, entity: str | None = None, agent: str | None = None, limit: int = 100, order: str = "seq") -> DataFrame:
    """The newest events that the filters leave, newest first, each with ``n_total``, their count before the limit."""
    chosen = select_events(events, entity, agent)
    return recent(chosen, limit, order).join(chosen.agg(F.count("*").alias("n_total"))).orderBy(F.col(order).desc())  # one row beside


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first by ``order`` (the window is cut to one row before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
