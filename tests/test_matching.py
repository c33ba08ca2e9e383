"""Names in texts and parameters of requirements: indexes against brute force."""

import random

from pyspark.sql import functions as F

from keelson.functions.rules import with_comparison
from keelson.operators import compliance, documents, graph


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_names_in_texts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(documents, "CHUNK", 16)  # so that most texts have several chunks, and names lie over their borders
    r = random.Random(1)
    letters = "abAé-😀 \n"
    names = ["a", "é😀", "ab-a", "", None, "UPS-02A", "UPS-02", "a" * 30, "-", "UPS-02A", "😀😀😀😀😀"] + ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(40)]
    texts = [None, "", "x", "UPS-02AUPS-02", "a" * 100, "see UPS-\n02A"] + ["".join(r.choice(letters) for _ in range(r.randint(0, 120))) for _ in range(60)] + ["é" * 50 + "UPS-02A" + "ab-a" * 9]
    t = spark.createDataFrame([(i, x, "c") for i, x in enumerate(texts)] + [(3, texts[3], "c")], "id int, t string, gram string").repartition(4)
    n = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "k int, name string")
    want = [(i, x, "c", k, m) for i, x in [*enumerate(texts), (3, texts[3])] for k, m in enumerate(names) if x and m and m in x]
    assert rows_of(documents.occurring(t, "t", n, "name")) == sorted(want, key=str)
    assert documents.occurring(t, "t", n.where("name = ''"), "name").count() == 0
    assert documents.occurring(t.limit(0), "t", n, "name").count() == 0


def test_a_long_text_is_searched_in_chunks(spark):
    text = "é- " * 400_000 + "UPS-02A" + " x" * 100_000
    n = spark.createDataFrame([("UPS-02A",), ("UPS-02B",), ("é- é- é",)], "name string")
    got = documents.occurring(spark.createDataFrame([(1, text)], "id int, t string"), "t", n, "name").select("name")
    assert rows_of(got) == [("UPS-02A",), ("é- é- é",)]


def test_grams_of_many_names_pick_the_rarest(spark):
    n = spark.createDataFrame([("UPS-01",), ("UPS-02",), ("UPS-03",), ("x",)], "name string")
    assert {r.name: r.gram for r in documents._anchors(n).collect()} == {"UPS-01": "S-01", "UPS-02": "S-02", "UPS-03": "S-03", "x": "x"}


def best_by_force(reqs, pars):
    units = {"kV": {"kV": 1, "volts": 1}, "ms": {"ms": 1, "s": 1}}
    out = []
    for req, group, name, canon, unit in reqs:
        found = []
        for seq, g, pname, pcanon, punit, value in pars:
            if g != group or g is None:
                continue
            overlap = len(set((name or "").split()) & set((pname or "").split()))
            same = bool(canon) and canon == pcanon
            if same or overlap >= 2:
                fits = value is not None and punit in units[unit]
                found.append((not same, -overlap, not fits, seq))
        if found:
            same, overlap, fits, seq = min(found)
            out.append((req, seq, not same, -overlap, not fits))
    return sorted(out, key=str)


def test_best_matches_equal_brute_force(spark):
    r = random.Random(2)
    words = ["pump", "rated", "output", "of", "water", "flow"]
    name = lambda: " ".join(["common", *r.sample(words, r.randint(0, 4))])
    reqs = [(i, r.choice(["g", "h", None]), r.choice([name(), None]), r.choice(["", "c1", "c2", None]), r.choice(["kV", "ms"])) for i in range(80)]
    pars = [(i, r.choice(["g", "h", None]), name(), r.choice(["", "c1", "c3", None]), r.choice(["volts", "s", "kg"]), r.choice(["400 V", None])) for i in range(80)]
    req = spark.createDataFrame(reqs, "req int, g string, parameter string, canonical_parameter string, unit string")
    par = spark.createDataFrame(pars, "seq int, g string, parameter string, canonical_parameter string, unit string, value string")
    assert rows_of(compliance.best_matches(req, par, "req", "g")) == best_by_force(reqs, pars)
    assert compliance.best_matches(req, par.limit(0), "req", "g").count() == 0
    ungrouped = [(a, "g", *rest) for a, _, *rest in reqs], [(a, "g", *rest) for a, _, *rest in pars]
    assert rows_of(compliance.best_matches(req.drop("g"), par.drop("g"))) == best_by_force(*ungrouped)


def test_a_word_that_all_names_have_adds_no_pairs(spark):
    req = spark.range(300).selectExpr("id as req", "concat('common w', char(97 + id % 26), char(97 + id div 26)) as parameter", "'' as canonical_parameter", "'kV' as unit")
    par = req.selectExpr("req as seq", "concat(parameter, ' x', char(97 + req % 26), char(97 + req div 26)) as parameter", "'' as canonical_parameter", "'kV' as unit", "'1' as value")
    got = compliance.best_matches(req, par)
    assert {(r.req, r.seq, r.overlap) for r in got.collect()} == {(i, i, 2) for i in range(300)}


def test_comparisons_parse_once_a_row(spark):
    rows = spark.createDataFrame(
        [("greater_equal", "2.0", "MVA", None, None, "1800 kVA", "kVA"), ("range", "5", "min", "9", None, "8 minutes", "minutes"), ("equal", "100", "kW", None, "±10%", "0.095", "MW"), ("equal", "4", "ms", None, None, "4", "kg"), ("less_equal", None, "ms", None, "x", "4", "ms")],
        "comparison string, value string, unit string, value_max string, tolerance string, submitted_value string, submitted_unit string",
    )
    found = with_comparison(rows)
    got = [(r.compliant, r.margin_pct, r.compared_value) for r in found.collect()]
    assert got == [(False, 10.0, 1.8), (True, 60.0, 8.0), (True, 5.0, 95.0), (None, None, None), (None, None, 4.0)]
    plan = found.select("compliant", "margin_pct", "compared_value").where("compliant").agg(F.max("margin_pct"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") <= 8


def test_filters_by_status_and_prefix(spark):
    rows = spark.createDataFrame([("SPEC::a", "Open"), ("SPEC::b", None), ("DEV::a", "OPEN"), (None, "closed")], "node_id string, status string")
    assert [r.node_id for r in graph.of_status(rows, "open").orderBy("node_id").collect()] == ["DEV::a", "SPEC::a"]
    assert [r.node_id for r in graph.of_prefix(rows, "SPEC::", but=("SPEC::b",)).collect()] == ["SPEC::a"]


def records_shuffled(spark, job):
    """Rows that the stages of ``job`` wrote for a shuffle."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    count = lambda: sum(s.shuffleWriteRecords() for s in (found.apply(i) for found in [stages()] for i in range(found.size())))
    before = count()
    job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return count() - before


def test_edges_of_clauses_are_not_shuffled(spark):
    """A keyword ties a clause to all equipment of a prefix: 300 clauses and 400 tags have 120,000 edges."""
    tags = spark.range(400).select(F.format_string("UPS-%03d", "id").alias("tag"))
    clauses = spark.range(300).select(F.col("id").alias("clause"), F.concat(F.lit("the uninterruptible unit "), "id").alias("text"))
    edges = []
    shuffled = records_shuffled(spark, lambda: edges.append(graph.clause_edges(tags, clauses).agg(F.count("*")).first()))
    assert edges[0][0] == 120_000 and shuffled < 12_000


def test_edges_of_clauses_come_once(spark):
    """Clauses of several texts, one of them without an id, name tags beside those that their words mean."""
    names = ["UPS-01", "UPS-02", "ups-01", "GEN-1", "XY-1", "XY-2", "XY", "CH-1", "CHWP-1", None]
    texts = [(1, "unit XY-1"), (1, "ups-01 and XY-1"), (2, "UPS-01"), (None, "standby engine GEN-1"), (None, "XY-2, gen-1"), (3, "chilled water pump by CH-1"), (4, None), (2, "ch-1 xy-2"), (5, "battery")]
    tags = spark.createDataFrame([(n,) for n in names + names[:3]], "tag string")
    got = [tuple(r) for r in graph.clause_edges(tags, spark.createDataFrame(texts, "clause int, text string")).collect()]
    holds = lambda t, n: n.upper() in t.upper() or any(k in t.upper() for k in graph.KEYWORDS.get(n.split("-")[0], []))
    want = {(n, c) for c, t in texts if t for n in names if n and holds(t, n)}
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 15
