"""A small schedule export end to end, registers, and the stream."""

import datetime as dt

from pyspark.sql import functions as F

from keelson.operators import graph, schedule
from keelson.sources import tables, xer
from keelson.streaming import convergence as stream

FIELDS = "task_id proj_id task_code task_name task_type status_code total_float_hr_cnt target_drtn_hr_cnt remain_drtn_hr_cnt target_start_date target_end_date act_start_date act_end_date early_start_date early_end_date late_start_date late_end_date"


def export(tmp_path):
    row = lambda *c: "%R\t" + "\t".join(c)
    task = lambda i, code, name, kind, status, float_, days, start="", end="", a0="", a1="", e0="", e1="": row(str(i), "1", code, name, kind, status, str(float_), str(days * 8), str(days * 8), start, end, a0, a1, e0, e1, "", "")
    lines = [
        "ERMHDR\t19.12", "%T\tPROJECT", "%F\tproj_id\tproj_short_name\tlast_recalc_date", row("1", "P-1", "2026-07-20 00:00"), row("2", "P-2", "2026-01-01 00:00"), "%T\tTASK", "%F\t" + FIELDS.replace(" ", "\t"),
        task(10, "ACT-001", "Deliver UPS-02A", "TT_Task", "TK_Active", 0, 10, "2026-07-01 08:00", "2026-07-24 17:00", "2026-07-01 08:00", "", "2026-07-20 08:00", "2026-08-13 17:00"),
        task(11, "ACT-002", "Install UPS-02A", "TT_Task", "TK_NotStart", 0, 5, "2026-07-27 08:00", "2026-07-31 17:00"),
        task(12, "ACT-003", "Commissioning complete", "TT_FinMile", "TK_NotStart", 0, 0, "2026-07-31 08:00", "2026-07-31 17:00"),
        task(13, "ACT-004", "Site setup", "TT_Task", "TK_Complete", 80, 5, "", "", "2026-07-06 08:00", "2026-07-10 17:00"),
        "%T\tTASKPRED", "%F\ttask_pred_id\ttask_id\tpred_task_id\tpred_type\tlag_hr_cnt", row("1", "11", "10", "PR_FS", "0"), row("2", "12", "11", "PR_FS", "16"), row("3", "11", "13", "PR_SS", ""), row("4", "99", "13", "PR_FS", "0"), "%E",
    ]
    (tmp_path / "a.xer").write_text("\n".join(lines))
    return str(tmp_path / "a.xer")


def test_export_to_forecast(spark, tmp_path):
    projects, activities, links = xer.read_schedule(spark, export(tmp_path))
    assert projects.first()["data_date"] == dt.date(2026, 7, 20)
    assert activities.count() == 4 and links.count() == 3
    assert {r["link"] for r in links.collect()} == {"FS", "SS"} and links.where("lag_days = 2").count() == 1
    day = F.lit("2026-07-20").cast("date")
    work = schedule.remaining_durations(activities, day)
    passed = schedule.forward_pass(work, links, day)
    got = {r["task_code"]: (r["start"], r["finish"], r["driver"]) for r in passed.collect()}
    # Active: 18 workdays from the data date to 2026-08-13.
    assert got["ACT-001"] == (-13.0, 18.0, None)
    assert got["ACT-002"] == (18.0, 23.0, "ACT-001")
    assert got["ACT-003"] == (25.0, 25.0, "ACT-002")
    long = spark.createDataFrame([(f"it's {i}", f"it's {i - 1}" if i else None) for i in range(1001)], "task_code string, driver string")
    chain = schedule.driving_path(long, "it's 1000")
    assert [(r["pos"], r["task_code"]) for r in chain.orderBy("pos").collect()] == [(i, f"it's {i}") for i in range(1001)]
    path = schedule.driving_path(passed, "ACT-003")
    assert [r["task_code"] for r in path.orderBy("pos").collect()] == ["ACT-001", "ACT-002", "ACT-003"]
    slipped = schedule.slips(passed, activities, day)
    assert {r["task_code"]: r["slip"] for r in slipped.collect()} == {"ACT-001": 14.0, "ACT-002": 14.0, "ACT-003": 16.0}
    assert schedule.slip_origin(path, slipped).first()["origin"] == "ACT-001"
    assert [r["task_code"] for r in schedule.late_activities(slipped, activities).collect()] == ["ACT-001", "ACT-002"]
    trials = schedule.simulate_finish(spark, activities, links, day, "ACT-003", trials=3000)
    assert trials.count() == 3000
    again = schedule.simulation_summary(schedule.simulate_finish(spark, activities, links, day, "ACT-003", trials=3000), day, F.lit("2026-07-31").cast("date")).first()
    row = schedule.simulation_summary(trials, day, F.lit("2026-07-31").cast("date")).first()
    assert row == again and row["breach"] == 1.0 and 25 < row["p50"] < row["p80"] < row["p90"] < 18 + 6 + 5 + 1 + 2 + 1
    nodes, edges = graph.schedule_graph(activities, links)
    assert {(r["node_id"], r["node_type"]) for r in nodes.collect()} >= {("UPS-02A", "Equipment"), ("ACT-003", "Milestone")}
    assert {(r["src"], r["dst"]) for r in edges.where("relationship = 'ON_CRITICAL_PATH'").collect()} == {("ACT-001", "ACT-003"), ("ACT-002", "ACT-003")}


def test_finish_never_falls_as_durations_grow(spark, tmp_path):
    _, activities, links = xer.read_schedule(spark, export(tmp_path))
    day = F.lit("2026-07-20").cast("date")
    base = schedule.remaining_durations(activities, day)
    longer = base.withColumn("duration", F.col("duration") + F.when(F.col("task_code") == "ACT-002", 3).otherwise(0))
    a = {r["task_code"]: r["finish"] for r in schedule.forward_pass(base, links, day).collect()}
    b = {r["task_code"]: r["finish"] for r in schedule.forward_pass(longer, links, day).collect()}
    assert all(b[k] >= a[k] for k in a) and b["ACT-003"] == a["ACT-003"] + 3


def test_register(spark):
    rows = [("f", 0, ["Project register", None, None]), ("f", 1, ["RFI No.", "Subject", "Status"]), ("f", 2, ["RFI-0001", " text ", "Open"]), ("f", 3, ["", "x", "Open"]), ("f", 4, ["RFI-0002", "=A1", "Closed"])]
    got = tables.register(spark.createDataFrame(rows, "file string, row int, cells array<string>")).orderBy("row").collect()
    assert [(r["rfi_id"], r["subject"], r["status"], r["question"]) for r in got] == [("RFI-0001", "text", "Open", None), ("RFI-0002", None, "Closed", None)]


def test_json_and_folders(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / ".hidden").write_text("h")
    assert sorted(r["x"] for r in tables.read_json(spark, str(tmp_path / "*.json"), "x int").collect()) == [1, 2]
    assert [r["name"] for r in tables.read_folder(spark, str(tmp_path)).collect()] == ["a.json", "b.json"]
    (tmp_path / "p.json").write_text('{"procedures": [{"procedure_id": "P", "steps": [{"step_no": 1, "acceptance_criteria": {"operator": "range", "min": 1, "max": 2}}]}]}')
    (tmp_path / "q.json").write_text('[{"procedure_id": "Q", "steps": []}]')
    assert [tables.read_procedures(spark, str(tmp_path / f"{n}.json")).first()["procedure_id"] for n in "pq"] == ["P", "Q"]


def test_stream_equals_batch(spark, tmp_path, small):
    from keelson.operators.convergence import convergence_scores
    from keelson.plans.analogues import critical_entities, event_log

    log = event_log(spark, small)
    critical = critical_entities(spark, small)
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    scores = stream.stores(spark, str(tmp_path / "out"))[1]
    for part in ("seq % 3 <> 0", "seq % 3 = 0"):
        log.where(part).write.mode("append").parquet(str(tmp_path / "in"))
        stream.start(source, critical, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = lambda df: {(r["entity_id"], r["score"], r["n_agents"], r["first_seen"], r["on_critical_path"]) for r in df.collect()}
    assert rows(scores.read()) == rows(convergence_scores(log, critical))
    stream.start(source, critical, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert rows(scores.read()) == rows(convergence_scores(log, critical))


def test_a_whole_project(spark, tmp_path):
    """The agents' findings converge on the equipment; a corrected submittal takes one agent's signal away."""
    from keelson.plans.run_all import analyse

    _, activities, links = xer.read_schedule(spark, export(tmp_path))
    req = spark.createDataFrame([(1, "E-1", "rated output", "output", "2.0", "MVA", "greater_equal", None, None, "CRITICAL", "")], "req int, clause_id string, parameter string, canonical_parameter string, value string, unit string, comparison string, value_max string, tolerance string, criticality string, source_text string")
    log = spark.createDataFrame([], "seq long, agent string, event_type string, entity_id string, entity_type string, severity string, description string, risk_score double, ts timestamp")
    day = F.lit("2026-07-20").cast("date")

    def run(output):
        par = spark.createDataFrame([(1, "Rated output", "output", output, "MVA", 1)], "seq int, parameter string, canonical_parameter string, value string, unit string, page int")
        return analyse(activities, links, req, par, log, day, "ACT-003", "UPS-02A", trials=500)

    def of(reports):
        return {r["entity_id"]: r["agents"] for r in reports.alerts.collect()}

    assert of(run("1.8")) == {"UPS-02A": ["CHRONOS", "SPECTRA", "TRACIS"]}
    assert of(run("2.1")) == {"UPS-02A": ["CHRONOS", "TRACIS"]}


def test_questions(spark):
    from keelson.operators import questions

    nodes = spark.createDataFrame(
        [("UPS-02A", "Equipment", {"vendor": "V"}, 0.8), ("DEV::UPS-02A::E-1::p", "Deviation", {}, None), ("DEV::UPS-02AB::E-1::p", "Deviation", {}, None), ("ACT-1", "ScheduleActivity", {"is_critical": "true"}, None), ("V", "Vendor", {}, None), ("NCR-1", "NCR", {"status": "OPEN"}, None), ("NCR-2", "NCR", {"status": "closed"}, None), ("RFI-1", "RFI", {"status": "Open"}, None)],
        "node_id string, node_type string, attributes map<string,string>, risk_score double",
    )
    edges = spark.createDataFrame([("ACT-1", "UPS-02A", "REQUIRES"), ("UPS-02A", "V", "PROCURED_FROM"), ("NCR-1", "UPS-02A", "IMPACTS"), ("NCR-2", "UPS-02A", "IMPACTS"), ("RFI-1", "ACT-1", "LINKED_TO")], "src string, dst string, relationship string")
    assert sorted(r["kind"] for r in questions.equipment_status(nodes, edges, "UPS-02A").collect()) == ["activity", "deviation", "equipment", "ncr", "ncr", "vendor"]
    assert [r["id"] for r in questions.field_reports(nodes, edges).collect()] == ["NCR-1"]
    assert questions.field_reports(nodes, edges, True).count() == 2
    risks = spark.createDataFrame([("UPS-02A", "TRACIS", 0.8)], "node_id string, agent string, score double")
    assert questions.deliveries_at_risk(nodes, risks).count() == 1
    row = questions.entity_contexts(nodes, edges).first()
    assert (row["n_activities"], row["n_open_ncrs"], row["n_open_rfis"], row["n_deviations"], row["on_critical_path"]) == (1, 1, 1, 1, True)
