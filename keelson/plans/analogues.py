"""The domain's tables as views of the benchmark tables, for the registered queries.

Events are the log (entity: user, agent: event type), orders are activities,
parts are equipment, conversations are schedules and test sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    severity = F.when(F.col("event_type") == "view", "INFO").when(value >= 200, "CRITICAL").when(value >= 100, "HIGH").when(value >= 50, "MEDIUM").otherwise("LOW")
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("agent"), "event_type", F.col("user_id").cast("string").alias("entity_id"), F.lit("User").alias("entity_type"),
        severity.alias("severity"), F.col("props").alias("description"), F.least(F.lit(1.0), value / 500).alias("risk_score"), "ts", "value",
    )


EVENT_LOG = """ev as (
  select event_id as seq, event_type as agent, cast(user_id as varchar) as entity_id,
    case when event_type = 'view' then 'INFO' when value >= 200 then 'CRITICAL' when value >= 100 then 'HIGH' when value >= 50 then 'MEDIUM' else 'LOW' end as severity,
    least(1.0, value / 500) as risk_score, ts, value, props from events)"""


def critical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).where("agent = 'purchase' and value > 100").select("entity_id").distinct()


CRITICAL = "crit as (select distinct cast(user_id as varchar) as entity_id from events where event_type = 'purchase' and value > 100)"


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as schedules: turn n follows turn n-1 (FS) and starts three days after turn n-2 does (SS)."""
    t = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    code = lambda turn: F.concat(F.lit("C"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    activities = t.select(
        code(F.col("turn")).alias("task_code"), F.lit("work").alias("name"), F.lit("TK_NotStart").alias("status"), (F.col("n") % 10).cast("double").alias("duration"),
        *(F.lit(None).cast("date").alias(c) for c in ("target_start", "actual_start", "actual_end")), F.lit(False).alias("is_milestone"),
        F.date_add(F.lit("2026-07-20").cast("date"), (F.col("turn") * 7).cast("int")).alias("target_end"), "conv_id", "turn",
    )
    fs = t.where("turn >= 1").select(code(F.col("turn") - 1).alias("predecessor"), code(F.col("turn")).alias("successor"), F.lit("FS").alias("link"), F.lit(0.0).alias("lag_days"), (F.col("turn") * 2).alias("seq"))
    ss = t.where("turn >= 2").select(code(F.col("turn") - 2).alias("predecessor"), code(F.col("turn")).alias("successor"), F.lit("SS").alias("link"), F.lit(3.0).alias("lag_days"), (F.col("turn") * 2 + 1).alias("seq"))
    return activities, fs.unionByName(ss)


#: Start and finish by enumerating all chains, which the recursion of SQL can do for short schedules.
FORWARD = """act as (select conv_id, turn, cast(length(text) % 10 as double) as d from conversations),
paths as (
  select conv_id, turn, 0.0::double as s from act
  union
  select a.conv_id, a.turn, case when a.turn - p.turn = 1 then p.s + q.d else p.s + 3 end
  from paths p join act q on q.conv_id = p.conv_id and q.turn = p.turn join act a on a.conv_id = p.conv_id and a.turn - p.turn in (1, 2)
), passed as (select a.conv_id, a.turn, a.d, max(s) as start, max(s) + a.d as finish from paths join act a using (conv_id, turn) group by a.conv_id, a.turn, a.d)"""
