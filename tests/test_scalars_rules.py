"""Scalar functions and rules: worked values and boundaries."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.functions import rules, scalars


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("1.8 MVA", 1.8), ("  -4ms", -4.0), ("none", None), ("", None), (None, None)])
def test_leading_number(spark, text, want):
    assert value(spark, scalars.leading_number(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("a,b,want", [("kVA", "MVA", 0.001), ("percent", "%", 1.0), ("ms", "min", None), (None, "", 1.0), ("MVA", "MW", None), ("kilovolts", "volts", 1000.0)])
def test_unit_factor(spark, a, b, want):
    assert value(spark, scalars.unit_factor(F.lit(a).cast("string"), F.lit(b))) == want


@pytest.mark.parametrize("text,want", [("±10%", (0.1, True)), ("±2", (2.0, False)), ("± 0.5 %", (0.5 / 100, True))])
def test_tolerance(spark, text, want):
    amount, relative = scalars.tolerance(F.lit(text))
    assert (value(spark, amount), value(spark, relative)) == want


def test_ids(spark):
    text = F.lit("see rfi-0003, NCR-1, ACT-033, UPS-02A, ELEC-4.2.1, GEN-01 and ITP-ABC123")
    got = {k: value(spark, scalars.ids_in(text, k)) for k in scalars.ID_PATTERNS}
    assert got == {"rfi": ["rfi-0003"], "ncr": ["NCR-1"], "activity": ["ACT-033"], "equipment": ["UPS-02A", "GEN-01"], "clause": ["ELEC-4.2.1"], "itp": ["ITP-ABC123"]}
    assert value(spark, scalars.padded_id(F.lit("NCR-1"))) == "NCR-0001"
    assert value(spark, scalars.padded_id(F.lit("NCR-12345"))) == "NCR-12345"
    assert value(spark, scalars.tags_in(F.lit("Deliver UPS-02A and UPS-02A for ACT-12 to GEN-01"))) == ["UPS-02A", "GEN-01"]


def test_texts(spark):
    assert value(spark, scalars.plain_dashes(F.lit("a—b–c"))) == "a-b-c"
    assert value(spark, scalars.safe_name(F.lit("a/b?c.pdf"))) == "a_b_c.pdf"
    assert value(spark, scalars.signed(F.lit(5))) == "+5"
    assert value(spark, scalars.percent(F.lit(0.87))) == "87%"
    assert value(spark, scalars.thousands(F.lit(1700000.0))) == "1,700,000"
    assert value(spark, scalars.clean_cell(F.lit("=A1"))) is None
    assert value(spark, scalars.iso_date(F.lit("2026-08-13 17:00"))) == dt.date(2026, 8, 13)
    assert value(spark, scalars.tolerant_json(F.lit('Here:\n```json\n{"a": 1}\n```'), "a int"))["a"] == 1


def test_workdays_equal_numpy(spark):
    days = [dt.date(2026, 7, 13) + dt.timedelta(days=i) for i in range(16)]
    pairs = spark.createDataFrame([(a, b) for a in days for b in days], "a date, b date")
    for r in pairs.select("a", "b", scalars.workdays_between(F.col("a"), F.col("b")).alias("n"), scalars.workday_offset(F.col("a"), F.datediff("b", "a") + 16).alias("d")).collect():
        assert r["n"] == np.busday_count(r["a"], r["b"])
        assert r["d"] == np.busday_offset(r["a"], (r["b"] - r["a"]).days + 16, roll="forward").item()


@pytest.mark.parametrize("days,severity", [(-1, "CRITICAL"), (0, "HIGH"), (6, "HIGH"), (7, "MEDIUM"), (13, "MEDIUM"), (14, None)])
def test_delivery_severity(spark, days, severity):
    assert value(spark, rules.delivery_severity(F.lit(days))) == severity


def test_worked_risks(spark):
    assert value(spark, rules.delivery_risk(F.lit(1), F.lit(True))) == 0.687
    assert value(spark, rules.deviation_risk(F.lit("CRITICAL"), F.lit(10.0))) == 0.92
    assert value(spark, rules.deviation_risk(F.lit("CRITICAL"), F.lit(50.0))) == 1.0
    assert value(spark, rules.deviation_risk(F.lit("MAJOR"), F.lit(50.0))) == 0.7
    assert value(spark, rules.slip_risk(F.lit(21))) == pytest.approx(0.65)
    assert value(spark, rules.exposure(F.lit(34))) == 1_700_000
    assert [value(spark, rules.risk_band(F.lit(x))) for x in (0.8, 0.79, 0.6, 0.3, 0.29)] == ["critical", "high", "high", "medium", "low"]


def test_accepted(spark):
    none = F.lit(None).cast("double")
    args = lambda **k: [k.get(n, none) for n in ("limit", "least", "most", "allowed")]
    judge = lambda op, reading, expected=None, **k: value(spark, rules.accepted(F.lit(op), F.lit(reading), *args(**k), F.lit(expected).cast("boolean")))
    assert judge("less_equal", "4", limit=F.lit(4.0)) and not judge("greater_equal", "3.9", limit=F.lit(4.0))
    assert judge("range", "5", least=F.lit(5.0), most=F.lit(6.0)) and judge("equal", "10", limit=F.lit(9.0), allowed=F.lit(1.0))
    assert judge("boolean", " Yes ", True) and judge("boolean", "no", False)
    assert judge("less_equal", "text", limit=F.lit(4.0)) is None


def test_completed_requirement(spark):
    rows = spark.createDataFrame([("ELEC-1", None, "power", None, "MAJOR", None), ("X-1", "p", None, False, "MINOR", "Own")], "clause_id string, parameter string, canonical_parameter string, mandatory boolean, criticality string, system string")
    a, b = rows.withColumns(rules.completed_requirement()).orderBy("clause_id").collect()
    assert (a["parameter"], a["mandatory"], a["system"]) == ("power", True, "Electrical")
    assert (b["parameter"], b["mandatory"], b["system"]) == ("p", False, "Own")
