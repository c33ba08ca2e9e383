"""Field non-conformance reports: a log of actions, current states and what they mean for equipment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import FIELD_RISK, FIELD_RISK_WITHOUT, by_value
from ..functions.scalars import next_id
from .segments import Transitions

# Severities, dispositions, and the state that each action needs and gives.
DISPOSITIONS = ("use-as-is", "rework", "reject")
TRANSITIONS = {"raise": (None, "OPEN"), "disposition": ("OPEN", "DISPOSITIONED"), "close": ("DISPOSITIONED", "CLOSED")}


def raised(reports: DataFrame, last_number: int = 0) -> DataFrame:
    """New reports as they are stored: ids continue the last number, tags are trimmed and upper-cased.

    A blank title or description, or an unknown severity, fails the job.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    fault = F.when(blank(F.col("title")) | blank(F.col("description")), F.raise_error(F.lit("a report needs a title and a description"))).when(
        ~F.coalesce(F.col("severity").isin(*FIELD_RISK), F.lit(False)), F.raise_error(F.lit("unknown severity"))
    )
    from ..sources.store import numbered

    number = F.col("__number")
    return numbered(reports, "__number", "seq", first=last_number).withColumns({"severity": F.coalesce(fault.cast("string"), F.col("severity")), "ncr_id": next_id(number, "NCR"), "equipment_tag": F.upper(F.trim(F.coalesce("equipment_tag", F.lit("")))), "status": F.lit("OPEN")}).drop("__number")


def highest_number(ids: Column) -> Column:
    """Aggregate: the largest number at the end of ids; null without one."""
    return F.max(F.regexp_extract(ids, r"-(\d+)$", 1).try_cast("int"))


def states(log: DataFrame, key: str = "ncr_id", order: str = "seq", strict: bool = False, hot_rows: int = 100_000) -> DataFrame:
    """``key, status, n_actions, n_refused``: what each report's actions in order lead to.

    An action that its report's state does not allow is refused and changes
    nothing; with ``strict`` it fails the job. Runs of actions compose, so a
    report of more than ``hot_rows`` actions is folded in parts.
    """
    names = ["", *dict.fromkeys(gives for _, gives in TRANSITIONS.values())]
    machine = Transitions(names, {action: (needs or "", gives) for action, (needs, gives) in TRANSITIONS.items()})
    found = machine.runs(log, [key], order, "action", hot_rows)
    refused = F.get("run.refused", F.lit(0)).cast("int")
    if strict:
        refused = F.when(refused > 0, F.raise_error(F.lit("a transition is not allowed")).cast("int")).otherwise(refused)
    status = F.get(F.array(*map(F.lit, names)), F.get("run.to", F.lit(0)))
    return found.select(key, status.alias("status"), F.col("n_actions").cast("int").alias("n_actions"), refused.alias("n_refused"))


def field_risk(reports: DataFrame, tags: DataFrame) -> DataFrame:
    """``tag, field_risk``: the largest severity of a tag's reports that aren't closed, or the least risk."""
    live = reports.where(F.upper(F.coalesce("status", F.lit(""))) != "CLOSED")
    worst = live.groupBy(F.col("equipment_tag").alias("tag")).agg(F.max(by_value(F.col("severity"), FIELD_RISK)).alias("worst"))
    return tags.select("tag").distinct().join(worst, "tag", "left").select("tag", F.coalesce("worst", F.lit(FIELD_RISK_WITHOUT)).alias("field_risk"))


def mirrored(reports: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and IMPACTS edges of open reports on known tags; doing it again changes nothing."""
    live = reports.where(F.upper(F.coalesce("status", F.lit(""))) != "CLOSED")
    own = live.select(F.col("ncr_id").alias("node_id"), F.lit("NCR").alias("node_type"))
    kept = nodes.select("node_id", "node_type").where("node_type <> 'NCR'").unionByName(own).distinct()
    known = nodes.select(F.col("node_id").alias("equipment_tag"))
    edges = live.join(known, "equipment_tag", "left_semi").select(F.col("ncr_id").alias("src"), F.col("equipment_tag").alias("dst"), F.lit("IMPACTS").alias("relationship")).distinct()
    return kept, edges


def in_step(reports: DataFrame, log: DataFrame, nodes: DataFrame, tags: DataFrame, hot_rows: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What a log of actions makes of reports, and of the graph and the risks beside them: reports with the ``status`` that their
    actions lead to (those without any keep theirs), the mirrored nodes and edges, and ``tag, field_risk``."""
    after = states(log, hot_rows=hot_rows).where("status <> ''").select("ncr_id", F.col("status").alias("__status"))
    now = reports.join(after, "ncr_id", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status").select(*reports.columns)
    return now, *mirrored(now, nodes), field_risk(now, tags)


def report_events(reports: DataFrame, nodes: DataFrame) -> DataFrame:
    """The events of new reports: on the tag, if the graph knows it, or else on the report."""
    known = nodes.select(F.col("node_id").alias("equipment_tag")).distinct().withColumn("known", F.lit(True))
    entity = F.when(F.col("known"), F.col("equipment_tag")).otherwise(F.col("ncr_id"))
    return reports.join(known, "equipment_tag", "left").select(
        F.lit("FIELD").alias("agent"), F.lit("ncr_raised").alias("event_type"), entity.alias("entity_id"), F.when(F.col("known"), "Equipment").otherwise("NCR").alias("entity_type"),
        "severity", F.concat_ws(": ", "ncr_id", "title").alias("description"), by_value(F.col("severity"), FIELD_RISK).alias("risk_score"),
    )


def listing(reports: DataFrame, order: str = "seq") -> DataFrame:
    """Reports, the newest first, each with ``n_open``, how many of all are not closed."""
    live = reports.agg(F.count_if(F.coalesce("status", F.lit("")) != "CLOSED").alias("n_open"))
    return reports.join(live).orderBy(F.col(order).desc())  # one row beside


def drafted(notes: DataFrame, text: str = "description") -> DataFrame:
    """Drafts of reports from their descriptions alone: the start as title, nothing known of the place, a major one."""
    blank = [F.lit("").alias(c) for c in ("equipment_tag", "location", "spec_clause")]
    return notes.select("*", F.substring(F.coalesce(text, F.lit("")), 1, 90).alias("title"), *blank, F.lit("MAJOR").alias("severity"))
