"""Schedule exports: tab-separated tables marked by %T (name), %F (fields) and %R (row)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import scratch

# Kinds of links in the export.
LINKS = {"PR_FS": "FS", "PR_SS": "SS", "PR_FF": "FF", "PR_SF": "SF"}
HOURS_PER_DAY = 8.0
_TABLES = ("PROJECT", "TASK", "TASKPRED")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """``file, table_name, seq, fields``: each %R record as a map from its table's field names.

    Files are read in splits. A line's ``seq`` is its split's place in the file
    and the line's number in the task, which a split's bytes exceed: it grows
    along a file over all splits. The few header lines, with what holds after
    each, are gathered a file, and every record takes the last one before it, in
    whatever split that is; records are not shuffled.
    """
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + at).alias("seq"), "value")
    parts = F.split("value", "\t")
    heads = lines.where(F.col("value").startswith("%T") | F.col("value").startswith("%F"))
    so_far = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda kind, value: F.last(F.when(parts[0] == kind, value), ignorenulls=True).over(so_far)
    heads = heads.select("file", "seq", F.coalesce(last("%T", F.get(parts, F.lit(1))), F.lit("")).alias("name"), last("%F", F.slice(parts, 2, 10_000)).alias("names"))
    heads = scratch(heads.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "names"))).alias("heads")), "heads")
    records = lines.where(F.col("value").startswith("%R")).join(heads, "file")
    records = records.select("file", "seq", "value", F.try_element_at(F.filter("heads", lambda h: h["seq"] < F.col("seq")), F.lit(-1)).alias("head"))
    records = records.where(F.col("head.name").isin(*_TABLES) & F.col("head.names").isNotNull())
    fields = F.map_from_arrays("head.names", F.transform("head.names", lambda _, i: F.get(parts, i + 1)))
    return records.select("file", F.col("head.name").alias("table_name"), "seq", fields.alias("fields"))


def read_schedule(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(projects, activities, links) of the exports at a path; of several projects in a file the first counts."""
    rows = read_rows(spark, path)
    f = lambda name: F.nullif(F.col("fields")[name], F.lit(""))
    day = lambda name: F.substring(f(name), 1, 10).try_cast("date")
    days = lambda name: f(name).try_cast("double") / HOURS_PER_DAY
    first = rows.where("table_name = 'PROJECT'").groupBy("file").agg(F.min(F.struct("seq", *(F.col("fields")[n].alias(n) for n in ("proj_id", "proj_short_name", "last_recalc_date")))).alias("p"))
    projects = first.select("file", F.col("p.proj_id").alias("proj_id"), F.col("p.proj_short_name").alias("project_name"), F.substring("p.last_recalc_date", 1, 10).try_cast("date").alias("data_date"))
    tasks = rows.where("table_name = 'TASK'").withColumn("proj_id", f("proj_id")).join(projects.select("file", "proj_id"), ["file", "proj_id"])
    total_float = f("total_float_hr_cnt").try_cast("double") / HOURS_PER_DAY
    activities = tasks.select(
        "file", f("task_code").alias("task_code"), f("task_id").alias("uid"), f("task_name").alias("name"), f("task_type").alias("type"),
        f("task_type").isin("TT_Mile", "TT_FinMile").alias("is_milestone"), f("status_code").alias("status"), F.coalesce(total_float <= 0, F.lit(False)).alias("is_critical"), total_float.alias("total_float"),
        days("target_drtn_hr_cnt").alias("original_duration_days"), days("remain_drtn_hr_cnt").alias("remaining_duration_days"),
        day("target_start_date").alias("target_start"), day("target_end_date").alias("target_end"), day("act_start_date").alias("actual_start"), day("act_end_date").alias("actual_end"),
        day("early_start_date").alias("early_start"), day("early_end_date").alias("early_end"), day("late_start_date").alias("late_start"), day("late_end_date").alias("late_end"),
    )
    kinds = F.create_map(*(F.lit(x) for pair in LINKS.items() for x in pair))
    raw = rows.where("table_name = 'TASKPRED'").select("file", "seq", f("pred_task_id").alias("p"), f("task_id").alias("s"), F.element_at(kinds, f("pred_type")).alias("link"), F.coalesce(days("lag_hr_cnt"), F.lit(0.0)).alias("lag_days"))
    codes = activities.select("file", "uid", "task_code")
    links = raw.join(codes.select("file", F.col("uid").alias("p"), F.col("task_code").alias("predecessor")), ["file", "p"]).join(codes.select("file", F.col("uid").alias("s"), F.col("task_code").alias("successor")), ["file", "s"])
    return projects, activities, links.select("file", "predecessor", "successor", "link", "lag_days", "seq")
