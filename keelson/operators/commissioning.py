"""Commissioning: readings of test sessions against the steps of procedures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import accepted
from ..functions.scalars import next_id


def steps_of(procedures: DataFrame) -> DataFrame:
    """One row a step, with its criteria as columns."""
    step = procedures.select("procedure_id", F.explode("steps").alias("s"))
    criteria = [F.col(f"s.acceptance_criteria.{c}").alias(c) for c in ("operator", "limit", "min", "max", "tolerance", "expected")]
    return step.select("procedure_id", *(F.col(f"s.{c}").alias(c) for c in ("step_no", "measurement", "hold_point", "critical_hold")), F.coalesce("s.unit", "s.acceptance_criteria.unit").alias("unit"), *criteria)


def listing(procedures: DataFrame) -> DataFrame:
    return procedures.select("procedure_id", "title", "system", "equipment_tag", F.size("steps").alias("n_steps"))


def judged(readings: DataFrame, steps: DataFrame) -> DataFrame:
    """Readings with the step that they answer (the n-th reading of a session, the n-th step) and the result.

    ``readings`` (session_id, procedure_id, seq, reading). What can't be read as
    the step needs fails. Readings beyond the last step are left out.
    """
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    joined = readings.withColumn("step_no", nth).join(steps, ["procedure_id", "step_no"])
    passes = accepted(F.col("operator"), F.col("reading"), F.col("limit"), F.col("min"), F.col("max"), F.col("tolerance"), F.col("expected"))
    unit = F.coalesce(F.concat(F.lit(" "), "unit"), F.lit(""))
    detail = (
        F.when(F.col("operator") == "boolean", F.concat(F.lit("expected "), F.col("expected").cast("string"), F.lit(", recorded "), "reading"))
        .when(F.col("operator") == "range", F.concat("reading", unit, F.lit(" vs range "), F.col("min").cast("string"), F.lit("-"), F.col("max").cast("string"), unit))
        .when(F.col("operator") == "equal", F.concat("reading", unit, F.lit(" vs "), F.col("limit").cast("string"), F.lit(" ± "), F.coalesce("tolerance", F.lit(0.0)).cast("string"), unit))
        .otherwise(F.concat("reading", unit, F.when(F.col("operator") == "less_equal", " vs limit <= ").otherwise(" vs limit >= "), F.col("limit").cast("string"), unit))
    )
    return joined.withColumns({"result": F.when(F.coalesce(passes, F.lit(False)), "PASS").otherwise("FAIL"), "detail": detail})


def verdicts(results: DataFrame, steps: DataFrame) -> DataFrame:
    """``session_id, procedure_id, n_done, n_failed, state``: in progress until every step has a reading, then passed or failed."""
    total = steps.groupBy("procedure_id").agg(F.count("*").alias("n_steps"))
    done = results.groupBy("session_id", "procedure_id").agg(F.count("*").alias("n_done"), F.count_if(F.col("result") == "FAIL").alias("n_failed"))
    state = F.when(F.col("n_done") < F.col("n_steps"), "in_progress").when(F.col("n_failed") == 0, "passed").otherwise("failed")
    return done.join(total, "procedure_id").select("session_id", "procedure_id", "n_done", "n_failed", state.alias("state"))


def started(requests: DataFrame, procedures: DataFrame) -> DataFrame:
    """Sessions as they begin: ``requests`` (session_id, procedure_id, operator, started_at); an unknown procedure fails the job."""
    known = procedures.select("procedure_id", F.col("title").alias("procedure_title"), "equipment_tag", F.size("steps").alias("total_steps"))
    fault = F.when(F.col("total_steps").isNull(), F.raise_error(F.concat(F.lit("unknown procedure "), F.coalesce("procedure_id", F.lit("null")))))
    return requests.join(known, "procedure_id", "left").withColumns(
        {"operator": F.coalesce("operator", F.lit("Commissioning Engineer")), "current_step": F.lit(1), "status": F.coalesce(fault.cast("string"), F.lit("in_progress")), "sign_off_blocked": F.lit(False)}
    )


def session_states(sessions: DataFrame, results: DataFrame, steps: DataFrame) -> DataFrame:
    """``session_id, procedure_id, n_done, n_failed, current_step, sign_off_blocked, state`` of each session.

    ``sessions`` (session_id, procedure_id, completed_at null until it is
    completed). In progress until every step has a reading, then
    ``steps_complete``; once completed it passed, if every step has a reading
    and none failed, and else failed. Sessions without readings are there too.
    """
    total = steps.groupBy("procedure_id").agg(F.count("*").alias("n_steps"))
    done = results.groupBy("session_id").agg(F.count("*").alias("n_done"), F.count_if(F.col("result") == "FAIL").alias("n_failed"))
    joined = sessions.join(done, "session_id", "left").join(total, "procedure_id", "left").fillna(0, ["n_done", "n_failed", "n_steps"])
    read = F.col("n_done") >= F.col("n_steps")
    state = F.when(F.col("completed_at").isNotNull(), F.when(read & (F.col("n_failed") == 0), "passed").otherwise("failed")).when(read, "steps_complete").otherwise("in_progress")
    return joined.select("session_id", "procedure_id", "n_done", "n_failed", F.least(F.col("n_done") + 1, "n_steps").alias("current_step"), (F.col("n_failed") > 0).alias("sign_off_blocked"), state.alias("state"))


def failure_rfis(results: DataFrame, procedures: DataFrame, last_number: int = 0) -> DataFrame:
    """An RFI for each failed reading, numbered on in the order of sessions and steps."""
    failed = results.where("result = 'FAIL'").join(procedures.select("procedure_id", "title", "system", "equipment_tag", "linked_activity"), "procedure_id")
    from ..sources.store import numbered

    number = F.col("__number")
    return numbered(failed, "__number", "session_id", "step_no", first=last_number).select(
        next_id(number, "RFI").alias("rfi_id"), F.concat("title", F.lit(" - step "), F.col("step_no").cast("string"), F.lit(" acceptance failure")).alias("subject"),
        F.coalesce("system", F.lit("Commissioning")).alias("discipline"), F.lit("Open").alias("status"), F.when(F.col("critical_hold"), "High").otherwise("Medium").alias("priority"),
        F.lit("GUIDE (auto)").alias("raised_by"), F.lit("Vendor").alias("ball_in_court"), "linked_activity", "equipment_tag",
        F.concat(F.lit("Reading "), "reading", F.lit(" failed acceptance ("), "detail", F.lit(") during "), "procedure_id", F.lit(".")).alias("question"),
    )


def failure_events(results: DataFrame, procedures: DataFrame) -> DataFrame:
    """Events of failed readings: critical holds weigh more."""
    failed = results.where("result = 'FAIL'").join(procedures.select("procedure_id", "equipment_tag"), "procedure_id")
    hold = F.coalesce("critical_hold", F.lit(False))
    return failed.select(
        F.lit("GUIDE").alias("agent"), F.lit("test_failed").alias("event_type"), F.col("equipment_tag").alias("entity_id"), F.lit("Equipment").alias("entity_type"),
        F.when(hold, "CRITICAL").otherwise("HIGH").alias("severity"), F.concat_ws(" ", "procedure_id", F.lit("step"), F.col("step_no").cast("string"), F.lit("FAILED:"), "detail").alias("description"),
        F.when(hold, 0.85).otherwise(0.6).alias("risk_score"),
    )


def summary(procedure: Column, state: Column, first_failure: Column) -> Column:
    """A record's closing text."""
    return F.when(first_failure.isNull(), F.concat(procedure, F.lit(" "), F.upper(state), F.lit(": all steps within acceptance."))).otherwise(
        F.concat(procedure, F.lit(" "), F.upper(state), F.lit(": "), first_failure, F.lit(". Sign-off blocked."))
    )


def records(results: DataFrame, judged_sessions: DataFrame) -> DataFrame:
    """A record for each complete session: its readings in order and a summary."""
    reading = F.struct("step_no", "measurement", "reading", "result", "detail")
    gathered = results.groupBy("session_id").agg(
        F.array_sort(F.collect_list(reading)).alias("readings"), F.min(F.when(F.col("result") == "FAIL", F.struct("step_no", "detail"))).alias("failure")
    )
    return judged_sessions.where("state <> 'in_progress'").join(gathered, "session_id").withColumn("summary", summary(F.col("procedure_id"), F.col("state"), F.col("failure.detail"))).drop("failure")
