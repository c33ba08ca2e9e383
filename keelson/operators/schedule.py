"""Schedules: topological waves, the forward pass, driving paths, slips and simulation.

The forward pass is a max-plus recursion, which one query can't express; it is
solved by elimination (``maxplus``), in rounds that grow with the logarithm of a
schedule's depth. Results in between are written, so that each starts anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import workday_offset, workdays_between
from .events import first_by
from .maxplus import longest
from .quantiles import summarised

# Names of logistics work, trials and seed of a simulation, and the spreads of durations.
LOGISTICS = re.compile(r"deliver|receiv|procure|fabricat|ship|manufactur", re.I)
TRIALS, SEED = 5000, 42
TRIALS_PER_BLOCK = 2500
#: Activities of a schedule that is one row, and bytes of a block's arrays, at most.
MOST_TASKS, TRIAL_BYTES = 100_000, 64 << 20
#: What draws are taken modulo.
PRIME = (1 << 31) - 1


def _cut(df: DataFrame) -> DataFrame:
    from ..sources.store import scratch

    return scratch(df, "wave")


def valid_links(activities: DataFrame, links: DataFrame) -> DataFrame:
    """Links of which both ends are activities."""
    codes = activities.select("task_code")
    return links.join(codes.withColumnRenamed("task_code", "predecessor"), "predecessor", "left_semi").join(codes.withColumnRenamed("task_code", "successor"), "successor", "left_semi")


def waves(activities: DataFrame, links: DataFrame) -> DataFrame:
    """``task_code, wave``: the longest chain of links that leads to each activity; a cycle fails."""
    steps = valid_links(activities, links).select(F.col("predecessor").alias("src"), F.col("successor").alias("dst"), F.lit(1.0).alias("weight"))
    found = longest(activities.select(F.col("task_code").alias("node"), F.lit(0.0).alias("least")), steps)
    return found.select(F.col("node").alias("task_code"), F.col("value").cast("int").alias("wave"))


def remaining_durations(activities: DataFrame, data_date: Column) -> DataFrame:
    """Activities with ``duration``, the workdays left by status."""
    forecast = F.coalesce("early_end", "target_end", data_date)
    active = F.greatest(workdays_between(data_date, F.greatest(forecast, data_date)), F.lit(0))
    planned = F.bround(F.coalesce("original_duration_days", F.lit(0.0)), 0).cast("long")
    return activities.withColumn("duration", F.when(F.col("status") == "TK_Complete", F.lit(0)).when(F.col("status") == "TK_Active", active).otherwise(planned).cast("double"))


def forward_pass(activities: DataFrame, links: DataFrame, data_date: Column) -> DataFrame:
    """``task_code, start, finish, driver`` in workdays from the data date.

    ``activities`` has ``duration`` (see ``remaining_durations``). Finished and
    active work stands on its actual dates; other work starts at the latest of
    the data date, its planned start and what its predecessors allow. The driver
    is the first predecessor, in the links' order, that sets the start.

    What a predecessor of actual dates allows is known, so those links only raise
    the earliest starts. All others add a constant to the predecessor's start:
    ``longest`` solves them, and one more join of the links finds the drivers.
    """
    links = valid_links(activities, links).withColumn("lag", F.coalesce("lag_days", F.lit(0.0)))
    offset = lambda day: workdays_between(data_date, F.coalesce(day, data_date)).cast("double")
    done, active = F.col("status") == "TK_Complete", F.col("status") == "TK_Active"
    begun = offset(F.col("actual_start"))
    own = activities.select(
        "task_code", "duration",
        F.coalesce(done | active, F.lit(False)).alias("fixed"),
        F.when(done | active, begun).otherwise(F.greatest(F.lit(0.0), F.coalesce(workdays_between(data_date, F.col("target_start")).cast("double"), F.lit(0.0)))).alias("earliest"),
        F.when(done, offset(F.col("actual_end"))).when(active, F.greatest(begun, F.lit(0.0)) + F.col("duration")).alias("fixed_finish"),
    )
    own = _cut(own)
    end = lambda name: own.select(F.col("task_code").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("duration", "fixed", "earliest", "fixed_finish")))
    into = links.join(end("successor").where("not successor_fixed"), "successor").join(end("predecessor"), "predecessor")
    before = F.when(F.col("link") == "SS", F.lit(0.0)).otherwise(F.col("predecessor_duration"))
    weight = before + F.col("lag") - F.when(F.col("link") == "FF", F.col("successor_duration")).otherwise(0.0)
    known = F.when(F.col("link") == "SS", F.col("predecessor_earliest")).otherwise(F.col("predecessor_fixed_finish")) - before + weight
    into = _cut(into.select("predecessor", "successor", "seq", weight.alias("weight"), F.when(F.col("predecessor_fixed"), known).alias("known")))
    raised = into.where("known is not null").groupBy(F.col("successor").alias("task_code")).agg(F.max("known").alias("known"))
    nodes = own.where("not fixed").join(raised, "task_code", "left").select(F.col("task_code").alias("node"), F.greatest("earliest", "known").alias("least"))
    moving = into.where("known is null").select(F.col("predecessor").alias("src"), F.col("successor").alias("dst"), "weight")
    started = longest(nodes, moving).select(F.col("node").alias("task_code"), F.col("value").alias("start"))
    allowed = into.join(started.select(F.col("task_code").alias("predecessor"), F.col("start").alias("s")), "predecessor", "left")
    allowed = allowed.select(F.col("successor").alias("task_code"), F.col("predecessor").alias("who"), F.coalesce("known", F.col("s") + F.col("weight")).alias("cand"), "seq")
    top = first_by(allowed, ["task_code"], F.col("cand").desc(), F.col("seq").asc()).select("task_code", "who", "cand")
    best = own.join(started, "task_code", "left").join(top, "task_code", "left")
    driven = ~F.col("fixed") & F.coalesce(F.col("cand") > F.col("earliest"), F.lit(False))
    start = F.coalesce("start", "earliest")
    return _cut(best.select("task_code", start.alias("start"), F.coalesce("fixed_finish", start + F.col("duration")).alias("finish"), F.when(driven, F.col("who")).alias("driver")))


def driving_path(passed: DataFrame, milestones: DataFrame | str | None = None) -> DataFrame:
    """``milestone, task_code, pos``: the chain of drivers up to each milestone, origin first.

    ``milestones`` is a table with ``task_code``, or one code; without it every
    activity is one. Chains double in length a round: those of up to n links are
    joined with each activity's driver n links back, so a chain of n links takes
    log2(n) rounds.
    """
    if isinstance(milestones, str):
        milestones = passed.where(F.col("task_code") == milestones)
    ends = passed.select("task_code") if milestones is None else milestones.select("task_code").distinct().join(passed.select("task_code"), "task_code", "left_semi")
    chain = _cut(ends.select(F.col("task_code").alias("milestone"), "task_code", F.lit(0).alias("back")))
    jump = _cut(passed.where("driver is not null").select("task_code", F.col("driver").alias("before")))
    length = 1
    while True:
        longer = chain.join(jump, "task_code").select("milestone", F.col("before").alias("task_code"), (F.col("back") + length).alias("back"))
        longer = _cut(longer)
        if longer.isEmpty():
            break
        if length > passed.count():
            raise ValueError("drivers form a cycle")
        chain = _cut(chain.union(longer))
        jump = _cut(jump.join(jump.select(F.col("task_code").alias("before"), F.col("before").alias("far")), "before").select("task_code", F.col("far").alias("before")))
        length *= 2
    last = F.max("back").over(Window.partitionBy("milestone"))
    return chain.select("milestone", "task_code", (last - F.col("back")).alias("pos"))


def slips(passed: DataFrame, activities: DataFrame, data_date: Column) -> DataFrame:
    """``task_code, slip``: workdays by which unfinished work ends after its target."""
    planned = activities.where(F.col("target_end").isNotNull() & ~F.coalesce(F.col("status") == "TK_Complete", F.lit(False)))
    return planned.join(passed, "task_code").select("task_code", (F.col("finish") - workdays_between(data_date, F.col("target_end"))).alias("slip"))


def slip_origin(path: DataFrame, slipped: DataFrame) -> DataFrame:
    """``milestone, origin, slip``: the first activity of a path that slips, or else the path's first."""
    known = path.join(slipped, "task_code", "left").withColumn("slip", F.coalesce("slip", F.lit(0.0)))
    first = first_by(known, ["milestone"], (F.col("slip") > 0).desc(), F.col("pos").asc())
    return first.select("milestone", F.col("task_code").alias("origin"), "slip")


def late_activities(slipped: DataFrame, activities: DataFrame) -> DataFrame:
    """Slipping activities but for milestones, the worst first."""
    named = slipped.where("slip > 0").join(activities.where(~F.coalesce("is_milestone", F.lit(False))).select("task_code", "name", "is_critical"), "task_code")
    return named.orderBy(F.col("slip").desc(), "task_code")


def forecast_date(data_date: Column, finish: Column) -> Column:
    return workday_offset(data_date, finish)


# Simulation


def triangular(duration: float, name: str, status: str) -> tuple[float, float, float]:
    """(least, likeliest, most) of a duration: twice as wide to the right; logistics spread most."""
    spread = 0.1 * duration
    if LOGISTICS.search(name or ""):
        spread = max(spread, 3.0)
    elif status == "TK_Active":
        spread = max(spread, 1.0)
    return max(duration - spread, 0.5 * duration), duration, duration + 2 * spread


def _key(seed: int, schedule: Column, code: Column) -> list[Column]:
    """Two numbers below ``PRIME`` of an activity, the first not 0."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), schedule.cast("string"), code).cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return [(1 + part(1) % (PRIME - 1)).alias("a"), (part(9) % PRIME).alias("b")]


def _durations(a: int, b: int, trials: np.ndarray, least: float, likeliest: float, most: float) -> np.ndarray:
    """An activity's duration in each trial: its draws are the points of a lattice of its own, shifted and spaced by its key."""
    u = ((a * trials + b) % PRIME + 0.5) / PRIME
    rising = u * (most - least) < likeliest - least
    return np.where(rising, least + np.sqrt(u * (most - least) * (likeliest - least)), most - np.sqrt((1 - u) * (most - least) * (most - likeliest)))


def _trials(tasks: list[dict], milestone: str, trials: np.ndarray) -> np.ndarray:
    """The milestone's finish in some trials; ``tasks`` in the order of their waves. What no later one needs is let go."""
    last = {link["predecessor"]: i for i, task in enumerate(tasks) for link in task["links"] or ()}
    done: dict[int, list[str]] = {}
    for code, i in last.items():
        done.setdefault(i, []).append(code)
    start: dict[str, np.ndarray] = {}
    finish: dict[str, np.ndarray] = {}
    n = len(trials)
    for i, task in enumerate(tasks):
        code, d = task["task_code"], task["duration"]
        if task["status"] == "TK_Complete":
            start[code], finish[code] = np.full(n, min(task["fixed_finish"], 0.0)), np.full(n, task["fixed_finish"])
        else:
            sampled = _durations(task["a"], task["b"], trials, *triangular(d, task["name"], task["status"])) if d > 0 else np.zeros(n)
            begin = np.full(n, max(0.0, task["planned"] or 0.0) if task["status"] == "TK_NotStart" else 0.0)
            for link in task["links"] or ():
                before, lag = link["predecessor"], link["lag"]
                begin = np.maximum(begin, start[before] + lag if link["link"] == "SS" else finish[before] + lag - (sampled if link["link"] == "FF" else 0))
            start[code], finish[code] = begin, begin + sampled
        for over in [*done.get(i, ()), *(() if code in last else (code,))]:
            if over != milestone:
                del start[over], finish[over]
    return finish[milestone]


def _simulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            one = row.drop_columns("schedule").to_pylist()[0]
            trials = np.arange(one["first"], one["first"] + one["n"])
            finish = _trials(one["tasks"], one["milestone"], trials)
            key = row.column("schedule").take(pa.array(np.zeros(one["n"], np.int64)))
            yield pa.RecordBatch.from_arrays([key, pa.array(trials), pa.array(finish)], names=["schedule", "trial", "finish"])


def _simulate_wide(work: DataFrame, linked: DataFrame, milestones: DataFrame, trials: int) -> DataFrame:
    """``schedule, trial, finish`` with a row for each activity and trial, solved as one network without links between trials."""
    u = ((F.col("a") * F.col("trial") + F.col("b")) % PRIME + 0.5) / PRIME
    spread = F.when(F.coalesce("name", F.lit("")).rlike(f"(?i){LOGISTICS.pattern}"), F.greatest(0.1 * F.col("duration"), F.lit(3.0))).when(F.col("status") == "TK_Active", F.greatest(0.1 * F.col("duration"), F.lit(1.0))).otherwise(0.1 * F.col("duration"))
    work = work.withColumn("spread", spread).withColumns({"low": F.greatest(F.col("duration") - F.col("spread"), 0.5 * F.col("duration")), "high": F.col("duration") + 2 * F.col("spread")})
    width, up, down = F.col("high") - F.col("low"), F.col("duration") - F.col("low"), F.col("high") - F.col("duration")
    drawn = F.when(u * width < up, F.col("low") + F.sqrt(u * width * up)).otherwise(F.col("high") - F.sqrt((1 - u) * width * down))
    fixed = F.coalesce(F.col("status") == "TK_Complete", F.lit(False))
    each = work.withColumn("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long"))))
    own = _cut(each.select("schedule", "trial", "task_code", fixed.alias("fixed"), "fixed_finish", F.when(F.col("duration") > 0, drawn).otherwise(0.0).alias("d"), F.when(F.col("status") == "TK_NotStart", F.greatest(F.lit(0.0), F.coalesce("planned", F.lit(0.0)))).otherwise(0.0).alias("least")))
    end = lambda name, *columns: own.select("trial", F.col("task_code").alias(name), *(F.col(c).alias(f"{name[0]}_{c}") for c in columns))
    into = linked.select("predecessor", "successor", "link", F.coalesce("lag_days", F.lit(0.0)).alias("lag")).join(end("successor", "d", "fixed").where("not s_fixed"), "successor").join(end("predecessor", "d", "fixed", "fixed_finish"), ["predecessor", "trial"])
    before = F.when(F.col("link") == "SS", F.lit(0.0)).otherwise(F.col("p_d"))
    weight = F.col("lag") - F.when(F.col("link") == "FF", F.col("s_d")).otherwise(0.0)
    known = F.when(F.col("link") == "SS", F.least("p_fixed_finish", F.lit(0.0))).otherwise(F.col("p_fixed_finish")) + weight
    node = lambda code: F.concat_ws("|", F.col("trial").cast("string"), code)
    into = _cut(into.select("trial", "predecessor", "successor", (before + weight).alias("weight"), F.when(F.col("p_fixed"), known).alias("known")))
    raised = into.where("known is not null").groupBy("trial", F.col("successor").alias("task_code")).agg(F.max("known").alias("known"))
    nodes = own.where("not fixed").join(raised, ["trial", "task_code"], "left").select(node("task_code").alias("node"), F.greatest("least", "known").alias("least"))
    started = longest(nodes, into.where("known is null").select(node("predecessor").alias("src"), node("successor").alias("dst"), "weight"))
    asked = own.join(milestones.select("schedule", F.col("milestone").alias("task_code")), ["schedule", "task_code"]).withColumn("node", node("task_code"))
    return asked.join(started, "node", "left").select("schedule", "trial", F.when(F.col("fixed"), F.col("fixed_finish")).otherwise(F.col("value") + F.col("d")).alias("finish"))


def simulate_each(activities: DataFrame, links: DataFrame, data_date: Column, milestones: DataFrame, schedule: str, trials: int = TRIALS, seed: int = SEED, most_tasks: int = MOST_TASKS) -> DataFrame:
    """``schedule, trial, finish`` of every schedule: its milestone's finish in each trial, in workdays from the data date.

    ``activities`` has the column named by ``schedule``, ``milestones`` has it
    and ``milestone``, one a schedule; links stay within a schedule. A trial's
    draws follow from the seed, the schedule, the activity and the trial's number
    alone, so results depend neither on tasks nor on other schedules.

    A schedule of up to ``most_tasks`` activities is one row with its links, and
    goes to as many tasks as its trials have blocks: a block's arrays take
    ``TRIAL_BYTES`` at most. A larger one is spread, a row for each activity and
    trial. Nothing is gathered on the driver.
    """
    linked = valid_links(activities, links)
    offset = lambda day: workdays_between(data_date, day).cast("double")
    key = F.col(schedule)
    work = remaining_durations(activities, data_date).select(
        key.alias("schedule"), "task_code", "name", "status", "duration", offset(F.coalesce("actual_end", data_date)).alias("fixed_finish"), offset(F.col("target_start")).alias("planned"), *_key(seed, key, F.col("task_code"))
    )
    ends = milestones.select(key.alias("schedule"), "milestone")
    large = _cut(work.groupBy("schedule").agg(F.count("*").alias("n")).where(F.col("n") > most_tasks).select("schedule"))
    wide = None
    if not large.isEmpty():
        big = _cut(work.join(large, "schedule", "left_semi"))
        wide = _simulate_wide(big, linked.join(big.select(F.col("task_code").alias("successor")), "successor", "left_semi"), ends.join(large, "schedule", "left_semi"), trials)
        work = work.join(large, "schedule", "left_anti")
        activities, ends = activities.join(large, key == large["schedule"], "left_anti"), ends.join(large, "schedule", "left_anti")
    link = F.struct("seq", "predecessor", "link", F.coalesce("lag_days", F.lit(0.0)).alias("lag"))
    into = linked.groupBy(F.col("successor").alias("task_code")).agg(F.array_sort(F.collect_list(link)).alias("links"))
    work = work.join(waves(activities, linked), "task_code").join(into, "task_code", "left")
    task = F.struct("wave", "task_code", "name", "status", "duration", "fixed_finish", "planned", "a", "b", "links")
    whole = work.groupBy("schedule").agg(F.array_sort(F.collect_list(task)).alias("tasks")).join(ends, "schedule")
    size = F.greatest(F.lit(1), F.least(F.lit(TRIALS_PER_BLOCK), F.expr(f"cast({TRIAL_BYTES} div (16 * size(tasks)) as int)")))
    blocks = whole.withColumn("size", size.cast("long")).withColumn("first", F.explode(F.expr(f"if({trials} = 0, cast(array() as array<bigint>), sequence(0L, {trials} - 1L, size))")))
    blocks = blocks.select("schedule", "tasks", "milestone", "first", F.least("size", F.lit(trials) - F.col("first")).alias("n")).repartition("schedule", "first")
    found = blocks.mapInArrow(_simulate, f"schedule {whole.schema['schedule'].dataType.simpleString()}, trial long, finish double")
    return found if wide is None else found.unionByName(wide)


def simulate_finish(spark: SparkSession, activities: DataFrame, links: DataFrame, data_date: Column, milestone: str, trials: int = TRIALS, seed: int = SEED) -> DataFrame:
    """``trial, finish`` of one schedule: ``simulate_each`` with all activities in one."""
    wanted = spark.range(1).select(F.lit(0).alias("__schedule"), F.lit(milestone).alias("milestone"))
    return simulate_each(activities.withColumn("__schedule", F.lit(0)), links, data_date, wanted, "__schedule", trials, seed).select("trial", "finish")


def simulation_summary(trials: DataFrame, data_date: Column, baseline: Column, by: str | None = None) -> DataFrame:
    """P50, P80 and P90 (interpolated) in workdays and as dates, the share later than the baseline, and the delay.

    One row, or with ``by`` one for each of that column's values.
    """
    row = summarised(trials, "finish", workdays_between(data_date, baseline), {f"p{q}": q / 100 for q in (50, 80, 90)}, [by] if by else [])
    row = row.withColumns({f"p{q}_date": workday_offset(data_date, F.col(f"p{q}")) for q in (50, 80, 90)})
    return row.withColumn("expected_delay_days", F.datediff("p50_date", baseline))


# What may be done about a late milestone.
MITIGATIONS = (
    "Expedite the slipped delivery (air freight / vendor premium).",
    "Resequence downstream commissioning to overlap non-dependent tests.",
    "Negotiate interim milestone relief with the owner before breach.",
)


def narrative(path: DataFrame, origin: DataFrame, simulated: DataFrame, sla: Column) -> DataFrame:
    """``milestone, causal_narrative, mitigation_options``: what drives each milestone, as text.

    ``path`` (milestone, task_code, pos), ``origin`` (milestone, origin, slip),
    ``simulated`` one row with P50, P80, P90 dates and the share beyond ``sla``.
    """
    codes = path.groupBy("milestone").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "task_code"))), lambda x: x["task_code"]), " -> ").alias("codes"))
    facts = codes.join(origin, "milestone", "left").join(F.broadcast(simulated))  # one row beside
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("None"))
    text = F.concat(
        F.lit("Driving path "), "codes", F.lit(": origin slip "), said("slip"), F.lit(" workdays at "), said("origin"), F.lit("; P50 "), said("p50_date"),
        F.lit(", P80 "), said("p80_date"), F.lit(", P90 "), said("p90_date"), F.lit("; P(miss SLA "), sla.cast("string"), F.lit(") = "), said("breach"),
    )
    return facts.select("milestone", text.alias("causal_narrative"), F.array(*map(F.lit, MITIGATIONS)).alias("mitigation_options"))
