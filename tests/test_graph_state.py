"""Nodes in both times, bundles, changes between snapshots, the keyed store, and facts as a graph."""

import datetime as dt

from pyspark.sql import functions as F

from keelson.operators import graph, questions
from keelson.sources.store import KeyedStore

T = [dt.datetime(2026, 7, d) for d in range(1, 9)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upserts_keep_type_and_valid_time(spark):
    writes = spark.createDataFrame(
        [("n", "Equipment", {"a": "1", "b": "1"}, None, T[0], 1), ("n", "Vendor", {"b": "2"}, T[5], T[1], 2), ("n", None, None, None, T[2], 3), ("m", "RFI", None, None, T[3], 4), ("m", "RFI", {"x": None}, None, T[3], 5)],
        "node_id string, node_type string, attributes map<string,string>, valid_time timestamp, tx_time timestamp, seq long",
    )
    got = {r.node_id: r for r in graph.current_nodes(writes).collect()}
    assert (got["n"].node_type, got["n"].attributes, got["n"].valid_time, got["n"].transaction_time) == ("Equipment", {"a": "1", "b": "2"}, T[5], T[2])
    assert (got["m"].node_type, got["m"].attributes, got["m"].valid_time, got["m"].transaction_time) == ("RFI", {"x": None}, T[3], T[3])
    for hot_rows in (1, 10**6):
        history = graph.node_history(writes, hot_rows=hot_rows).where("node_id = 'n'").orderBy("seq").collect()
        assert [(r.node_type, r.valid_time, r.tx_from, r.tx_to) for r in history] == [("Equipment", T[0], T[0], T[1]), ("Equipment", T[5], T[1], T[2]), ("Equipment", T[5], T[2], None)]
    assert graph.current_nodes(writes.limit(0)).count() == 0


NODES = [
    ("UPS-02A", "Equipment", {"vendor": "V", "submitted_parameters": "[...]"}, 0.8), ("DEV::UPS-02A::E-1::p", "Deviation", {"parameter": "p"}, None), ("DEV::UPS-02AB::E-1::p", "Deviation", {}, None),
    ("ACT-1", "ScheduleActivity", {"is_critical": "true", "name": "one"}, None), ("ACT-2", "ScheduleActivity", {"name": "two"}, None), ("NCR-1", "NCR", {"status": "OPEN", "title": "t"}, None), ("NCR-2", "NCR", {"status": "closed"}, None),
    ("RFI-1", "RFI", {"status": "Open", "subject": "s"}, None), ("RFI-2", "RFI", {"status": "Closed"}, None), ("MS-2", "Milestone", {"expected_delay_days": "9"}, None), ("MS-1", "Milestone", {"expected_delay_days": "22", "mc_p50": "2026-12-01"}, None), ("MS-0", "Milestone", {}, None),
]
EDGES = [("ACT-1", "UPS-02A", "REQUIRES"), ("ACT-2", "UPS-02A", "REQUIRES"), ("NCR-1", "UPS-02A", "IMPACTS"), ("NCR-2", "UPS-02A", "IMPACTS"), ("RFI-1", "ACT-1", "LINKED_TO"), ("RFI-1", "ACT-2", "LINKED_TO"), ("RFI-2", "ACT-1", "LINKED_TO"), ("ACT-1", "UPS-02A", "REQUIRES")]


def test_bundles(spark):
    nodes = spark.createDataFrame(NODES, "node_id string, node_type string, attributes map<string,string>, risk_score double")
    edges = spark.createDataFrame(EDGES, "src string, dst string, relationship string")
    asked = spark.createDataFrame([("UPS-02A",), ("unheard",), ("UPS-02A",)], "entity_id string")
    got = {r.entity_id: r.asDict(True) for r in questions.entity_bundles(nodes, edges, asked, most=1).collect()}
    one = got["UPS-02A"]
    assert set(got) == {"UPS-02A", "unheard"} and one["attributes"] == {"vendor": "V"} and one["node_type"] == "Equipment"
    assert (one["n_activities"], one["activities"]) == (2, [{"id": "ACT-1", "name": "one", "status": None, "is_critical": "true"}])
    assert (one["n_open_rfis"], one["open_rfis"]) == (1, [{"id": "RFI-1", "subject": "s"}])
    assert one["open_ncrs"] == [{"id": "NCR-1", "title": "t", "severity": None, "raised_by": None}] and one["deviations"] == [{"id": "DEV::UPS-02A::E-1::p", "attributes": {"parameter": "p"}}]
    assert (one["milestone"]["id"], one["milestone"]["expected_delay_days"], one["milestone"]["mc_p50"]) == ("MS-1", "22", "2026-12-01")
    assert got["unheard"]["activities"] == [] and got["unheard"]["n_open_ncrs"] == 0
    assert questions.entity_bundles(nodes, edges).count() == len(NODES)
    bare = questions.entity_bundles(nodes.where("node_type = 'RFI'"), edges.limit(0)).collect()
    assert len(bare) == 2 and bare[0].milestone is None


def test_changes_and_their_application(spark):
    old = spark.createDataFrame([("a", 1, {"x": "1", "y": "2"}), ("b", 2, None), ("c", None, {})], "k string, v int, m map<string,string>")
    new = spark.createDataFrame([("a", 1, {"y": "2", "x": "1"}), ("b", None, None), ("d", 4, {"z": None})], "k string, v int, m map<string,string>")
    found = graph.changes(old, new, ["k"])
    assert {(r.op, r.k, r.v) for r in found.collect()} == {("changed", "b", None), ("removed", "c", None), ("added", "d", 4)}
    assert rows_of(graph.applied(old, found, ["k"])) == rows_of(new)
    assert graph.changes(new, new, ["k"]).count() == 0


def test_keyed_store(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "edges"), "src string, dst string, relationship string, n long", ["src", "dst"], buckets=4)
    assert store.read().count() == 0 and store.get(spark.createDataFrame([("a", "b")], "src string, dst string")).count() == 0
    rows = spark.range(100).selectExpr("concat('s', id) as src", "'d' as dst", "'R' as relationship", "id as n")
    store.put(rows)
    store.put(spark.createDataFrame([("s1", "d", "S", 7), ("s1", "d", "T", 8), (None, "d", "N", 1)], "src string, dst string, relationship string, n long"), order="n")
    assert store.get(spark.createDataFrame([("s1", "d"), ("s2", "d")], "src string, dst string")).orderBy("src").collect() == [("s1", "d", "T", 8), ("s2", "d", "R", 2)]
    store.remove(spark.createDataFrame([("s3", "d"), ("none", "d")], "src string, dst string"))
    assert store.read().count() == 100
    assert store.compact() is False and store.reap() == 0
    assert store.compact(always=True) is True and len(store._current(store._versions())) == 1
    assert store.read().count() == 100 and store.get(spark.createDataFrame([("s3", "d")], "src string, dst string")).count() == 0
    assert store.reap(keep=1) == 2 and store.read().count() == 100
    now = scratch_copy(spark, store.read(), tmp_path)
    store.apply(graph.changes(now, now.where("n <> 5").withColumn("n", F.when(F.col("n") == 6, 600).otherwise(F.col("n"))), ["src", "dst"]))
    assert store.read().where("n in (5, 6, 600)").select("n").collect() == [(600,)]
    plan = store.get(spark.createDataFrame([("s1", "d")], "src string, dst string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "__bucket#" in plan.split("PartitionFilters: [", 1)[1][:40]


def scratch_copy(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "copy"))
    return spark.read.parquet(str(tmp_path / "copy"))


def test_facts_as_a_graph(spark):
    nodes = spark.createDataFrame([("ACT-1", "ScheduleActivity"), ("GEN-01", "Equipment")], "node_id string, node_type string")
    submittals = spark.createDataFrame([("UPS-02A", "PowerVolt"), ("UPS-02A", None)], "equipment_tag string, vendor string")
    requirements = spark.createDataFrame([("E-1", "", "output", "Electrical", "the UPS shall"), ("E-2", "run time", None, None, "a genset"), ("E-3", None, None, "x", None)], "clause_id string, parameter string, canonical_parameter string, system string, source_text string")
    rfis = spark.createDataFrame([("RFI-1", "ACT-1"), ("RFI-2", "ACT-9"), ("RFI-3", None)], "rfi_id string, linked_activity string")
    procedures = spark.createDataFrame([("CX-1", "test of GEN-01 and UPS-09")], "procedure_id string, title string")
    found, edges = graph.fact_graph(nodes, submittals, requirements, rfis, procedures)
    assert {r.node_id for r in found.collect()} == {"ACT-1", "GEN-01", "UPS-02A", "PowerVolt", "SPEC::E-1::output", "SPEC::E-2::run time", "SPEC::E-3::param", "RFI-1", "RFI-2", "RFI-3", "CX-1"}
    assert rows_of(edges) == [("CX-1", "GEN-01", "TESTS"), ("GEN-01", "SPEC::E-2::run time", "SPECIFIED_BY"), ("RFI-1", "ACT-1", "LINKED_TO"), ("UPS-02A", "PowerVolt", "PROCURED_FROM"), ("UPS-02A", "SPEC::E-1::output", "SPECIFIED_BY")]
    kept = graph.replaced(edges, F.col("relationship") == "TESTS", edges.limit(0))
    assert kept.count() == 4


def test_rebuild_in_five_steps(spark, tmp_path):
    from keelson.plans.rebuild import Sources, rebuild
    from tests.test_large_sources import DATA, TEXTS, make_workbook
    from tests.test_sources_schedule import export

    export(tmp_path)
    (tmp_path / "spec.json").write_text('[{"clause_id": "ELEC-4.2.1", "parameter": "rated output", "source_text": ""}, {"clause_id": "X-1", "canonical_parameter": "run time", "criticality": "MAJOR", "source_text": "UPS shall run"}]')
    (tmp_path / "sub.json").write_text('{"vendor": "PowerVolt", "equipment_tag": "UPS-02A", "parameters": [{"parameter": "Rated output", "value": "1.8", "unit": "MVA"}, {"parameter": "Run time", "value": "10", "unit": "min"}]}')
    (tmp_path / "proc.json").write_text('[{"procedure_id": "CX-1", "title": "test of UPS-02A", "steps": []}]')
    make_workbook(tmp_path / "rfi.xlsx", {"data": DATA}, TEXTS)
    pages = spark.createDataFrame([("spec", 1, "intro"), ("spec", 2, "ELEC-4.2.1 Output\nThe UPS shall give 2.0 MVA.\nEnd")], "doc_id string, page int, text string")
    at = lambda name: str(tmp_path / name)
    sources = Sources(pages, at("spec.json"), at("sub.json"), at("proc.json"), at("a.xer"), at("rfi.xlsx"))
    project, stages = rebuild(spark, sources, at("stores"))
    assert {r.stage: r.rows for r in stages.collect()} == {"specification": 2, "submittals": 2, "schedule": 4, "register": 2, "index": 6}
    spec = {r.clause_id: r for r in project.read("requirements").collect()}
    assert spec["ELEC-4.2.1"].source_text == "ELEC-4.2.1 Output The UPS shall give 2.0 MVA. End" and spec["ELEC-4.2.1"].page == 2
    assert (spec["X-1"].parameter, spec["X-1"].mandatory, spec["X-1"].system) == ("run time", True, "X")
    edges = {tuple(r) for r in project.edges.read().collect()}
    assert {("UPS-02A", "PowerVolt", "PROCURED_FROM"), ("UPS-02A", "SPEC::X-1::run time", "SPECIFIED_BY"), ("CX-1", "UPS-02A", "TESTS")} <= edges
    (tmp_path / "sub.json").write_text('{"vendor": "Volta", "equipment_tag": "UPS-02A", "parameters": []}')
    again, _ = rebuild(spark, sources, at("stores"))
    last = again.edges._versions()[-1]
    assert {tuple(r)[:3] for r in spark.read.parquet(f"{again.edges.path}/v{last}").select("src", "dst", "relationship").collect()} == {("UPS-02A", "PowerVolt", "PROCURED_FROM"), ("UPS-02A", "Volta", "PROCURED_FROM")}
    assert {tuple(r) for r in again.edges.read().collect()} == edges - {("UPS-02A", "PowerVolt", "PROCURED_FROM")} | {("UPS-02A", "Volta", "PROCURED_FROM")}
    again.reset()
    assert again.nodes.read().count() == again.read("rfis").count() == again.read("corpus").count() == 0
