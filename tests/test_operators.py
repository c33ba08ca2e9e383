"""Operators on small hand-made tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from keelson.operators import commissioning, compliance, convergence, dashboard, delivery, documents, events, graph, ncr, retrieval, schedule
from keelson.sources import store

EVENT = "seq long, agent string, event_type string, entity_id string, entity_type string, severity string, description string, risk_score double, ts timestamp"


def log(spark, rows):
    t = dt.datetime(2026, 7, 20)
    return spark.createDataFrame([(i, a, "x", e, "Equipment", s, "d", r, t) for i, (a, e, s, r) in enumerate(rows)], EVENT)


def test_convergence_worked_numbers(spark):
    rows = log(spark, [("SPECTRA", "UPS-02A", "CRITICAL", 1.0), ("SPECTRA", "UPS-02A", "MAJOR", 0.7), ("CHRONOS", "UPS-02A", "HIGH", 0.65), ("TRACIS", "UPS-02A", "HIGH", 0.687), ("TRACIS", "GEN-01", "HIGH", 0.9), ("FIELD", "UPS-02A", "INFO", 1.0)])
    critical = spark.createDataFrame([("UPS-02A",)], "entity_id string")
    got = convergence.convergence_scores(rows, critical).collect()
    assert [(r["entity_id"], r["score"], r["agents"]) for r in got] == [("UPS-02A", 3.506, ["CHRONOS", "SPECTRA", "TRACIS"])]
    without = events.without_agents(rows, ["SPECTRA"])
    assert convergence.convergence_scores(without, critical).first()["score"] == 2.006
    assert [r["entity_id"] for r in convergence.candidates(rows).collect()] == ["UPS-02A"]


def test_threshold_is_inclusive_and_ties_keep_the_earliest(spark):
    rows = log(spark, [("A", "e", "LOW", 0.3), ("B", "e", "LOW", 0.35), ("A", "e", "HIGH", 0.3)])
    none = spark.createDataFrame([], "entity_id string")
    assert convergence.convergence_scores(rows, none).first()["score"] == 0.65
    assert {r["agent"]: r["seq"] for r in convergence.strongest_signals(rows).collect()} == {"A": 0, "B": 1}


def test_event_filters(spark):
    rows = log(spark, [("A", "e", "LOW", 0.3), ("B", "f", "LOW", 0.35), (None, "e", "HIGH", 0.3)])
    assert events.without_agents(rows, ["A"]).count() == 2
    assert events.without_matching(rows, agent="A", entity_id="f").count() == 3
    assert events.without_matching(rows, agent="A", entity_id="e").count() == 2
    assert events.recent(rows, 0).count() == 0
    assert [r["seq"] for r in events.recent(rows, 2).collect()] == [2, 1]


def test_publishing_checks(spark, tmp_path):
    rows = log(spark, [("A", "e", "LOW", 0.3)])
    bad = rows.withColumn("severity", F.lit("ODD"))
    with pytest.raises(Exception, match="unknown severity"):
        events.publishable(bad).collect()
    with pytest.raises(ValueError):
        events.publishable(rows.drop("agent"))
    table = store.Store(spark, str(tmp_path / "log"), EVENT)
    assert table.read().count() == 0
    assert store.publish(table, rows.drop("seq")).count() == 1
    assert sorted(r["seq"] for r in store.publish(table, rows.drop("seq")).collect()) == [1, 2]
    assert table.replace(rows).count() == 1
    assert table.clear().count() == 0


def test_versions(spark):
    t = lambda d: dt.datetime(2026, 1, d)
    v = spark.createDataFrame([("n", t(1), 1, {"a": "1", "b": "2"}), ("n", t(3), 2, {"a": "9"}), ("m", t(2), 3, {})], "node_id string, tx_time timestamp, seq long, attributes map<string,string>")
    assert {r["node_id"]: r["seq"] for r in graph.as_of(v, F.lit("2026-01-02").cast("timestamp")).collect()} == {"n": 1, "m": 3}
    assert graph.as_of(v, F.lit("2025-01-02").cast("timestamp")).count() == 0
    merged = {r["node_id"]: r["attributes"] for r in graph.merged_attributes(v).collect()}
    assert merged["n"] == {"a": "9", "b": "2"}
    asked = spark.createDataFrame([("n", t(2)), ("n", t(9)), ("m", t(1))], "node_id string, at timestamp")
    assert sorted((r["node_id"], r["seq"]) for r in graph.as_of_each(v, asked).collect()) == [("n", 1), ("n", 2)]


def test_compliance_and_its_metamorphic_edits(spark):
    req = spark.createDataFrame(
        [(1, "ELEC-4.2.1", "rated output", "output", "2.0", "MVA", "greater_equal", None, None, "CRITICAL", ""), (2, "ELEC-4.2.2", "transfer time", "transfer", "4", "ms", "less_equal", None, None, "CRITICAL", ""), (3, "ELEC-4.2.3", "thd", "thd", "3", "%", "less_equal", None, None, "MAJOR", ""), (4, "ELEC-4.2.4", "efficiency", "eff", "96", "%", "greater_equal", None, None, "MAJOR", "")],
        "req int, clause_id string, parameter string, canonical_parameter string, value string, unit string, comparison string, value_max string, tolerance string, criticality string, source_text string",
    )

    def run(output):
        par = spark.createDataFrame([(1, "Rated output", "output", output, "kVA", 1), (2, "Transfer time", "transfer", "6", "ms", 1), (3, "THD", "thd", "4.5", "percent", 1), (4, "Efficiency", "eff", "96.5", "%", 1)], "seq int, parameter string, canonical_parameter string, value string, unit string, page int")
        return compliance.deviations(compliance.comparisons(req, par))

    found = run("1800 kVA")
    assert {r["clause_id"]: (r["margin_pct"], r["risk_score"]) for r in found.collect()} == {"ELEC-4.2.1": (10.0, 0.92), "ELEC-4.2.2": (50.0, 1.0), "ELEC-4.2.3": (50.0, 0.7)}
    assert compliance.overall(found).first()["overall_risk"] == 1.0
    assert {r["clause_id"] for r in run("2100").collect()} == {"ELEC-4.2.2", "ELEC-4.2.3"}
    assert "Deviations found" in compliance.narrative(found, F.lit("UPS-02A")).first()["narrative"]
    assert "comply" in compliance.narrative(found.limit(0), F.lit("UPS-02A")).first()["narrative"]


def test_delivery_example(spark):
    d = lambda s: dt.date.fromisoformat(s)
    rows = spark.createDataFrame(
        [("UPS-02A", "ACT-014", True, "TK_Active", False, None, d("2026-08-13"), None, None, None, 1), ("UPS-02A", "ACT-033", False, "TK_NotStart", True, None, None, None, d("2026-08-14"), None, 2), ("GEN-01", "ACT-2", True, "TK_Complete", False, d("2026-01-01"), None, None, None, None, 3)],
        "tag string, task_code string, is_delivery boolean, status string, is_critical boolean, actual_end date, early_end date, target_end date, early_start date, target_start date, seq int",
    )
    report = delivery.delivery_report(delivery.delivery_buffers(rows))
    got = report.collect()
    assert [(r["tag"], r["buffer_days"], r["severity"], r["risk_score"], r["required_by_activity"]) for r in got] == [("UPS-02A", 1, "HIGH", 0.687, "ACT-033")]
    assert "(+1 days, HIGH)" in got[0]["alert"]
    assert delivery.overall(report).first()["overall_risk"] == 0.687
    assert delivery.overall(report.limit(0)).first()["overall_risk"] == 0.0


def test_report_lifecycle(spark):
    moves = [("a", 1, "raise"), ("a", 2, "disposition"), ("a", 3, "close"), ("b", 1, "raise"), ("b", 2, "close"), ("c", 1, "close")]
    rows = spark.createDataFrame(moves, "ncr_id string, seq int, action string")
    assert {r["ncr_id"]: (r["status"], r["n_refused"]) for r in ncr.states(rows).collect()} == {"a": ("CLOSED", 0), "b": ("OPEN", 1), "c": ("", 1)}
    with pytest.raises(Exception, match="not allowed"):
        ncr.states(rows, strict=True).collect()
    reports = spark.createDataFrame([("NCR-0001", "UPS-01", "CRITICAL", "CLOSED"), ("NCR-0002", "UPS-01", "MINOR", "OPEN"), ("NCR-0003", "", "MAJOR", "open")], "ncr_id string, equipment_tag string, severity string, status string")
    tags = spark.createDataFrame([("UPS-01",), ("GEN-01",)], "tag string")
    assert {r["tag"]: r["field_risk"] for r in ncr.field_risk(reports, tags).collect()} == {"UPS-01": 0.4, "GEN-01": 0.1}
    nodes = spark.createDataFrame([("UPS-01", "Equipment"), ("NCR-0001", "NCR")], "node_id string, node_type string")
    kept, edges = ncr.mirrored(reports, nodes)
    again, same = ncr.mirrored(reports, kept)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, again.collect()))
    assert [tuple(r) for r in same.collect()] == [("NCR-0002", "UPS-01", "IMPACTS")]
    new = ncr.raised(spark.createDataFrame([(1, " t ", "d", "MAJOR", " ups-01 ")], "seq int, title string, description string, severity string, equipment_tag string"), 41).first()
    assert (new["ncr_id"], new["equipment_tag"]) == ("NCR-0042", "UPS-01")


def test_commissioning_example(spark):
    steps = spark.createDataFrame(
        [("P", 1, "load", "%", "greater_equal", 95.0, None, None, None, None, False), ("P", 2, "alarm", None, "boolean", None, None, None, None, False, False), ("P", 3, "transfer", "ms", "less_equal", 4.0, None, None, None, None, False), ("P", 4, "thd", "%", "less_equal", 5.0, None, None, None, None, True)],
        "procedure_id string, step_no int, measurement string, unit string, operator string, limit double, min double, max double, tolerance double, expected boolean, critical_hold boolean",
    )
    procedures = spark.createDataFrame([("P", "UPS test", None, "UPS-02A", "ACT-046")], "procedure_id string, title string, system string, equipment_tag string, linked_activity string")
    readings = spark.createDataFrame([("s", "P", i, v) for i, v in enumerate(["98", "false", "3.8", "6"])], "session_id string, procedure_id string, seq int, reading string")
    results = commissioning.judged(readings, steps)
    assert [r["result"] for r in results.orderBy("step_no").collect()] == ["PASS", "PASS", "PASS", "FAIL"]
    verdict = commissioning.verdicts(results, steps)
    assert verdict.first()["state"] == "failed"
    rfi = commissioning.failure_rfis(results, procedures).first()
    assert (rfi["rfi_id"], rfi["priority"], rfi["linked_activity"]) == ("RFI-0001", "High", "ACT-046")
    assert commissioning.failure_events(results, procedures).first()["risk_score"] == 0.85
    assert "Sign-off blocked" in commissioning.records(results, verdict).first()["summary"]
    partial = commissioning.judged(readings.where("seq < 2"), steps)
    assert commissioning.verdicts(partial, steps).first()["state"] == "in_progress"


def test_dashboard(spark):
    nodes = spark.createDataFrame([("UPS-02A", "Equipment", None, 0.8), ("CRAH-11", "Equipment", None, 0.5), ("RFI-1", "RFI", "Open", None), ("RFI-2", "RFI", "Closed", None), ("DEV-1", "Deviation", None, None)], "node_id string, node_type string, status string, risk_score double")
    row = dashboard.counters(nodes, spark.range(0), spark.range(3)).first()
    assert (row["equipment_at_risk"], row["open_deviations"], row["open_rfis"], row["n_alerts"], row["n_events"], row["hours_saved"]) == (1, 1, 1, 0, 3, 1.5)
    assert [r["node_id"] for r in dashboard.equipment_by_risk(nodes).collect()] == ["UPS-02A", "CRAH-11"]
    assert dashboard.empty_counters(spark).first()["hours_saved"] == 0.0


def test_documents(spark):
    t = lambda d: dt.datetime(2026, 1, d)
    files = spark.createDataFrame([(b"a", t(1)), (b"b", t(2)), (b"a", t(3))], "content binary, kept_at timestamp")
    kept = documents.retained(files).select("version_id", "kept_at")
    assert kept.count() == 2
    ids = sorted(r["version_id"] for r in kept.collect())
    entries = spark.createDataFrame([(ids[0], t(5), "u", "x.pdf"), (ids[0], t(9), "v", "x.pdf")], "version_id string, ts timestamp, uploaded_by string, original_name string")
    listed = documents.version_listing(kept, entries, F.lit(ids[1])).collect()
    assert [r["version_id"] for r in listed] == [ids[1], ids[0]] and [r["deletable"] for r in listed] == [False, True]
    assert listed[1]["uploaded_by"] == "u"
    with pytest.raises(ValueError):
        documents.deleted(kept, entries, ids[1], ids[1])
    pages = spark.createDataFrame([(1, p, "x" * n) for p, n in enumerate([300, 300, 0, 700, 100])], "doc_id int, page int, text string")
    chunks = documents.page_chunks(pages, 650).orderBy("chunk").collect()
    assert [(r["first_page"], r["last_page"], r["chars"]) for r in chunks] == [(0, 1, 600), (3, 3, 700), (4, 4, 100)]
    clauses = spark.createDataFrame([("ELEC-4.2.1",), ("ELEC-4.2.10",)], "clause_id string")
    text = spark.createDataFrame([(1, "x\nELEC-4.2.10 ten\nELEC-4.2.1 one\nnext\nafter\nlast")], "page int, text string")
    assert {r["clause_id"]: r["source_text"] for r in documents.clause_texts(clauses, text).collect()} == dict.fromkeys(("ELEC-4.2.1", "ELEC-4.2.10"), "ELEC-4.2.10 ten ELEC-4.2.1 one next")
    assert documents.clause_texts(clauses.limit(0), text).count() == 0
    fault = lambda name, content: spark.createDataFrame([(name, content)], "n string, c binary").select(documents.upload_fault(F.col("n"), F.col("c"))).first()[0]
    assert fault("a.pdf", b"%PDF-1") is None and fault("a.pdf", b"x") == "no PDF" and fault("a.exe", b"x") == "extension not allowed" and fault("../a.pdf", b"%PDF") == "unsafe name"


def test_retrieval(spark):
    asked = spark.createDataFrame([("Status of UPS-02A details",), ("hello",), ("what does the clause say",)], "question string")
    assert [(r["intent"], r["branches"]) for r in retrieval.routed(asked).collect()] == [("equipment_status", ["equipment_status", "deliveries_at_risk"]), ("general", []), ("spec_requirement", ["spec_requirement"])]
    stored = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "id string, v int, seq int")
    fresh = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "id string, v int, seq int")
    assert sorted((r["id"], r["v"]) for r in retrieval.upserted(stored, fresh).collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_cycle_fails(spark):
    a = spark.createDataFrame([("x",), ("y",)], "task_code string")
    links = spark.createDataFrame([("x", "y"), ("y", "x")], "predecessor string, successor string")
    with pytest.raises(ValueError, match="cycle"):
        schedule.waves(a, links)


def test_clauses_name_equipment_anywhere(spark):
    """Plurals, suffixed tags and words joined by hyphens count: texts are searched for substrings."""
    equipment = spark.createDataFrame([("UPS-01",), ("GEN-01",), ("CH-02",), ("XY-1",), ("plain",)], "tag string")
    texts = ["unit UPS-07", "spare for unit ups-01a", "Two diesel generators", "air cooled chillers", "pre-XY-1-post", "a plainer one", "nothing", None, ""]
    clauses = spark.createDataFrame(list(enumerate(texts)), "clause int, text string")
    got = sorted((r["dst"], r["src"]) for r in graph.clause_edges(equipment, clauses).collect())
    assert got == [(0, "UPS-01"), (1, "UPS-01"), (2, "GEN-01"), (3, "CH-02"), (4, "XY-1"), (5, "plain")]
    assert graph.clause_edges(equipment.limit(0), clauses).count() == 0
