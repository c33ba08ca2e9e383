"""Sessions, revisions, deviations, rounding, and stores with several writers."""

import datetime as dt
import math
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from keelson.functions import scalars
from keelson.operators import commissioning, dashboard, documents, events, graph, ncr, questions, schedule
from keelson.plans.run_all import timed
from keelson.sources import store, tables

EVENT = "seq long, agent string, event_type string, entity_id string, entity_type string, severity string, description string, risk_score double, ts timestamp"


def event(spark, agent):
    return spark.createDataFrame([(agent, "x", "e", "Equipment", "LOW", "d", 0.1)], EVENT.split(", ", 1)[1].rsplit(",", 1)[0])


def test_writers_at_once_lose_nothing(spark, tmp_path):
    log = store.Store(spark, str(tmp_path / "log"), EVENT)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: store.publish(log, event(spark, f"A{i}")), range(4)))
    assert sorted((r["seq"], r["agent"]) for r in log.read().collect()) == sorted(zip(range(1, 5), [r["agent"] for r in log.read().orderBy("seq").collect()], strict=True))
    assert log.read().select("agent").distinct().count() == 4


def test_a_store_is_built_once(spark, tmp_path):
    table = store.Store(spark, str(tmp_path / "graph"), "id long")
    built = table.read_or_build(lambda: spark.range(3))
    assert built.count() == 3 and table.read_or_build(lambda: spark.range(9)).count() == 3
    assert table.append(spark.range(2)).count() == 5
    assert table.replace(spark.range(1)).count() == 1 and table.append(spark.range(1)).count() == 2


def test_rounding_is_that_of_ieee_numbers(spark):
    draw = random.Random(5)
    numbers = [2.675, 0.125, 0.375, 2.5, 3.5, -2.5, 1.005, 0.0005, 0.0015, 1e300] + [draw.randrange(10**7) / 10**draw.randrange(1, 8) for _ in range(2000)] + [draw.uniform(-5, 5) for _ in range(500)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double")
    for places in (0, 2, 3):
        for r in rows.select("x", scalars.half_even(F.col("x"), places).alias("r")).collect():
            assert math.isclose(r["r"], round(r["x"], places), rel_tol=0, abs_tol=0), (r, places)


def test_sessions(spark):
    procedures = spark.createDataFrame([("P", "Load test", "UPS-01", [1, 2])], "procedure_id string, title string, equipment_tag string, steps array<int>")
    asked = spark.createDataFrame([("s", "P", None, None)], "session_id string, procedure_id string, operator string, started_at timestamp")
    row = commissioning.started(asked, procedures).first()
    assert (row["status"], row["current_step"], row["total_steps"], row["operator"], row["sign_off_blocked"]) == ("in_progress", 1, 2, "Commissioning Engineer", False)
    with pytest.raises(Exception, match="unknown procedure Q"):
        commissioning.started(asked.withColumn("procedure_id", F.lit("Q")), procedures).collect()
    steps = spark.createDataFrame([("P", 1), ("P", 2)], "procedure_id string, step_no int")
    results = spark.createDataFrame([("b", "PASS"), ("c", "PASS"), ("c", "PASS"), ("d", "PASS"), ("d", "FAIL"), ("e", "PASS"), ("f", "PASS"), ("f", "PASS")], "session_id string, result string")
    done = dt.datetime(2026, 1, 1)
    sessions = spark.createDataFrame([("a", "P", None), ("b", "P", None), ("c", "P", None), ("d", "P", done), ("e", "P", done), ("f", "P", done)], "session_id string, procedure_id string, completed_at timestamp")
    got = {r["session_id"]: r["state"] for r in commissioning.session_states(sessions, results, steps).collect()}
    assert got == {"a": "in_progress", "b": "in_progress", "c": "steps_complete", "d": "failed", "e": "failed", "f": "passed"}


def test_revisions(spark):
    versions = spark.createDataFrame([("v1",), ("v2",)], "version_id string")
    log = spark.createDataFrame([], "version_id string, ts timestamp, uploaded_by string, original_name string")
    at = F.lit("2026-01-01").cast("timestamp")
    assert documents.activated(versions, log, "v1", "v1", "me", at).count() == 0
    assert documents.activated(versions, log, "v2", "v1", "me", at).first()["original_name"] == "activated v2"
    with pytest.raises(ValueError):
        documents.activated(versions, log, "v9", "v1", "me", at)
    assert sorted(r[0] for r in documents.with_seeds(versions, spark.createDataFrame([("v2",), ("v3",)], "version_id string")).collect()) == ["v1", "v2", "v3"]
    assets = spark.createDataFrame([("R2", "two"), ("R3", "three")], "revision string, content string")
    files = spark.createDataFrame([("a", "three"), ("b", "other"), ("c", None)], "name string, content string")
    assert {r["name"]: r["revision"] for r in documents.active_revision(files, assets).collect()} == {"a": "R3", "b": "unknown", "c": "unknown"}


def test_deviations_reach_clauses_and_activities(spark):
    found = spark.createDataFrame([("UPS-01", "ELEC-4.2.1", "power")], "equipment_tag string, clause_id string, parameter string")
    edges = spark.createDataFrame([("UPS-01", "SPEC::ELEC-4.2.10::x", "SPECIFIED_BY"), ("UPS-01", "SPEC::MECH-1::x", "SPECIFIED_BY"), ("ACT-1", "UPS-01", "REQUIRES"), ("ACT-2", "UPS-02", "REQUIRES")], "src string, dst string, relationship string")
    nodes, fresh = graph.deviation_graph(found, edges)
    assert nodes.first()["node_id"] == "DEV::UPS-01::ELEC-4.2.1::power"
    assert {(r["dst"], r["relationship"]) for r in fresh.collect()} == {("SPEC::ELEC-4.2.10::x", "DEVIATES_FROM"), ("ACT-1", "IMPACTS")}


def test_many_parts_are_found_as_few_are(spark, monkeypatch):
    texts = spark.createDataFrame([("a-1 and b",), ("xa-12",), (None,)], "t string")
    parts = spark.createDataFrame([("a-1",), ("b",), ("",)], "p string").where("p <> ''")
    few = sorted(map(tuple, graph.containing(texts, F.col("t"), parts, F.col("p")).collect()))
    monkeypatch.setattr(graph, "MOST_PARTS", 1)
    assert few == sorted(map(tuple, graph.containing(texts, F.col("t"), parts, F.col("p")).collect())) and len(few) == 3


def test_schedules_are_simulated_apart(spark):
    columns = "task_code string, name string, status string, original_duration_days double, early_end date, target_end date, actual_end date, target_start date, s string"
    work = spark.createDataFrame([(f"{s}{i}", "n", "TK_NotStart", 10.0, None, None, None, None, s) for s in "xy" for i in range(2)], columns)
    links = spark.createDataFrame([(f"{s}0", f"{s}1", "FS", 0.0, 1) for s in "xy"], "predecessor string, successor string, link string, lag_days double, seq long")
    last = spark.createDataFrame([("x", "x1"), ("y", "y1")], "s string, milestone string")
    day = F.lit("2026-07-20").cast("date")
    both = schedule.simulate_each(work, links, day, last, "s", trials=3000)
    alone = schedule.simulate_each(work.where("s = 'x'"), links, day, last, "s", trials=3000)
    assert both.groupBy("schedule").count().collect() and both.count() == 6000
    assert sorted(r["finish"] for r in both.where("schedule = 'x'").collect()) == sorted(r["finish"] for r in alone.collect())
    assert {r["schedule"]: 20 < r["p50"] < 23 for r in schedule.simulation_summary(both, day, day, by="schedule").collect()} == {"x": True, "y": True}
    told = schedule.narrative(
        spark.createDataFrame([("m", "b", 1), ("m", "a", 0)], "milestone string, task_code string, pos int"), spark.createDataFrame([("m", "a", 3)], "milestone string, origin string, slip int"),
        spark.createDataFrame([("1", "2", "3", 0.5)], "p50_date string, p80_date string, p90_date string, breach double"), F.lit("4"),
    )
    assert told.first()["causal_narrative"] == "Driving path a -> b: origin slip 3 workdays at a; P50 1, P80 2, P90 3; P(miss SLA 4) = 0.5" and len(told.first()["mitigation_options"]) == 3


def test_listings_drafts_and_answers(spark):
    reports = spark.createDataFrame([(1, "A", "OPEN"), (2, "B", "CLOSED"), (3, "C", "OPEN")], "seq long, ncr_id string, status string")
    assert [(r["ncr_id"], r["n_open"]) for r in ncr.listing(reports).collect()] == [("C", 2), ("B", 2), ("A", 2)]
    notes = spark.createDataFrame([("d" * 200,), (None,)], "description string")
    assert [(len(r["title"]), r["severity"]) for r in ncr.drafted(notes).collect()] == [(90, "MAJOR"), (0, "MAJOR")]
    facts = spark.createDataFrame([("ncr", str(i), f'{{"n":{i}}}', None) for i in range(7)], "kind string, id string, fact string, path string")
    assert questions.evidence(facts).first()["answer"] == 'Graph evidence: [{"n":0}, {"n":1}, {"n":2}, {"n":3}, {"n":4}]'
    rows = spark.createDataFrame([(i, "A", "e") for i in range(5)], "seq long, agent string, entity_id string")
    assert [(r["seq"], r["n_total"]) for r in events.page(rows, limit=2).collect()] == [(4, 5), (3, 5)]
    assert events.removed_count(rows, agent="A", seq=3).first()[0] == 1 and events.removed_count(rows, agent=None).first()[0] == 0


def test_caches_have_no_answers_and_stages_are_timed(spark):
    plain = spark.createDataFrame([], "a string, b array<struct<c: int>>")
    assert tables.without_answers(plain, "x") is plain
    bad = spark.createDataFrame([], "a string, b array<struct<Severity: int>>, m map<string, struct<compliant: boolean>>")
    assert tables.forbidden_keys(bad) == ["b.Severity", "m.compliant"]
    with pytest.raises(ValueError):
        tables.without_answers(bad, "x")
    results, times = timed({"one": lambda: spark.range(3), "two": lambda: spark.range(4)})
    assert results["two"].count() == 4 and [r["stage"] for r in times.collect()] == ["one", "two"]


def test_the_dashboard_has_its_parts(spark):
    nodes = spark.createDataFrame([("UPS-01", "Equipment", None, 0.7), ("GEN-01", "Equipment", None, 0.2), ("D", "Deviation", None, None), ("R", "RFI", "Open", None)], "node_id string, node_type string, status string, risk_score double")
    activities = spark.createDataFrame([("a", True, dt.date(2026, 2, 1)), ("b", True, dt.date(2026, 1, 1)), ("c", False, None)], "task_code string, is_critical boolean, early_start date")
    milestones = spark.createDataFrame([("m", 9.0), ("l", None)], "node_id string, p90 double")
    rows = spark.createDataFrame([(i,) for i in range(30)], "seq long")
    parts = dashboard.summary(nodes, activities, milestones, spark.range(2), rows)
    metrics = parts["metrics"].first()
    assert (metrics["equipment_at_risk"], metrics["open_deviations"], metrics["open_rfis"], metrics["n_alerts"], metrics["n_events"]) == (1, 1, 1, 2, 30)
    assert [r["node_id"] for r in parts["equipment"].collect()] == ["UPS-01", "GEN-01"]
    assert [r["task_code"] for r in parts["critical_path"].collect()] == ["b", "a"]
    assert parts["milestone"].first()["node_id"] == "m" and parts["deviations"].count() == 1
    assert [r["seq"] for r in parts["recent_events"].collect()] == list(range(29, 4, -1))
