"""Deliveries against the work that needs them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import delivery_risk, delivery_severity

# Fixed value: names of delivery activities.
DELIVERY = r"(?i)deliver|receiv|procure|fabricat|ship"


def delivery_buffers(rows: DataFrame) -> DataFrame:
    """One row an item that has a delivery and unfinished work waiting for it.

    ``rows`` (tag, task_code, is_delivery, status, is_critical, actual_end,
    early_end, target_end, early_start, target_start, seq) are the activities of
    each item; one aggregation finds its first delivery, the earliest need and
    whether either is critical, so no join of the two kinds is needed.
    """
    done = F.coalesce(F.col("status") == "TK_Complete", F.lit(False))
    eta = F.when(done, F.col("actual_end")).otherwise(F.coalesce("early_end", "target_end"))
    need = F.coalesce("early_start", "target_start")
    waiting = ~F.col("is_delivery") & ~done
    first = F.min(F.when(F.col("is_delivery"), F.struct("seq", F.col("task_code").alias("code"), eta.alias("eta"), F.col("is_critical").alias("critical")))).alias("delivery")
    wanted = F.min(F.when(waiting & need.isNotNull(), F.struct(need.alias("need"), "seq", F.col("task_code").alias("code")))).alias("wanted")
    by_tag = rows.groupBy("tag").agg(first, wanted, F.bool_or(waiting & F.col("is_critical")).alias("critical"))
    days = F.datediff("required_by", "revised_eta")
    found = by_tag.select(
        "tag", F.col("delivery.code").alias("delivery_activity"), F.col("delivery.eta").alias("revised_eta"), F.col("wanted.need").alias("required_by"),
        F.col("wanted.code").alias("required_by_activity"), (F.coalesce("critical", F.lit(False)) | F.coalesce("delivery.critical", F.lit(False))).alias("on_critical_path"),
    )
    return found.where("revised_eta is not null and required_by is not null").withColumn("buffer_days", days)


def delivery_report(buffers: DataFrame) -> DataFrame:
    """Buffers with severity (ON_TRACK where nothing is wrong) and risk; on track, the critical path adds nothing."""
    severity = delivery_severity(F.col("buffer_days"))
    return buffers.withColumns(
        {
            "severity": F.coalesce(severity, F.lit("ON_TRACK")),
            "risk_score": delivery_risk(F.col("buffer_days"), F.col("on_critical_path") & severity.isNotNull()),
            "alert": F.when(severity.isNotNull(), F.concat(F.col("tag"), F.lit(": ETA "), F.col("revised_eta").cast("string"), F.lit(" vs required "), F.col("required_by").cast("string"), F.format_string(" (%+d days, ", F.col("buffer_days")), severity, F.lit(")"))),
        }
    ).orderBy("tag")


def overall(report: DataFrame) -> DataFrame:
    at_risk = F.col("severity") != "ON_TRACK"
    return report.agg(F.count_if(at_risk).alias("n_at_risk"), F.round(F.coalesce(F.max(F.when(at_risk, F.col("risk_score"))), F.lit(0.0)), 3).alias("overall_risk"))
