"""Convergence over a stream of events.

The stream's state is the strongest signal of each entity and agent, one row a
pair. In update mode a batch brings the pairs that it changed; these go to a
keyed store, and the entities that they touch are scored anew by the operator
that scores whole logs. Readers of the scores see each batch whole, and a batch
that is run again after a failure puts the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.convergence import convergence_scores
from ..sources.store import KeyedStore, scratch

SIGNALS = "entity_id string, agent string, risk_score double, seq long"
SCORES = "entity_id string, agents array<string>, n_agents long, score double, on_critical_path boolean, first_seen long"


def stores(spark: SparkSession, root: str) -> tuple[KeyedStore, KeyedStore]:
    """The strongest signals, dealt by entity, and the scores, under a folder."""
    return KeyedStore(spark, f"{root}/signals", SIGNALS, ["entity_id", "agent"], by=["entity_id"]), KeyedStore(spark, f"{root}/scores", SCORES, ["entity_id"])


def strongest_by_agent(events: DataFrame) -> DataFrame:
    """The strongest risk so far of each entity and agent, INFO left out, and the earliest event that has it.

    A pair's state is kept, as its next event may come at any time.
    """
    signals = events.where(F.coalesce(F.col("severity") != "INFO", F.lit(True)))
    strongest = F.max(F.struct(F.col("risk_score").alias("risk"), (-F.col("seq")).alias("before")))
    return signals.groupBy("entity_id", "agent").agg(strongest.alias("s")).select("entity_id", "agent", F.col("s.risk").alias("risk_score"), (-F.col("s.before")).alias("seq"))


def score_batch(changed: DataFrame, critical: DataFrame, signals: KeyedStore, scores: KeyedStore) -> None:
    """Keep the changed signals, and score the entities that have them."""
    changed = scratch(changed, "signals")
    if changed.isEmpty():
        return
    signals.put(changed)
    scores.put(convergence_scores(signals.get(changed).withColumn("severity", F.lit(None).cast("string")), critical))
    for store in (signals, scores):
        store.compact()


def start(events: DataFrame, critical: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Score a stream of events into the stores under ``root``; by default what is there now, and then end."""
    signals, scores = stores(events.sparkSession, root)
    sink = strongest_by_agent(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return sink.foreachBatch(lambda batch, _: score_batch(batch, critical, signals, scores)).trigger(**(trigger or {"availableNow": True})).start()
