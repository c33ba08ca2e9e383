"""Operators that spread one hot key, one long chain or one large group: against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import graph, maxplus, ncr, quantiles, schedule, segments
from keelson.sources import store


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Segments


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Ranges as they are dealt: else one task would do for so few rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def history(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.5 else r.choice(["a", "b", None]), r.randint(0, 300), i, r.choice([None, "x", "y"])) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "node_id string, tx_time long, seq long, value string").repartition(5)


def test_hot_keys_are_split(spark, history):
    _, df = history
    cold, hot = segments.split_by_heat(df, ["node_id"], 1000)
    assert {r[0] for r in hot.select("node_id").distinct().collect()} == {"hot"} and hot.count() + cold.count() == 3000
    assert segments.split_by_heat(df, ["node_id"], 3000)[1] is None
    dealt = store.in_ranges(hot, "node_id", "tx_time", "seq")
    assert dealt.select("__range").distinct().count() == 4


@pytest.mark.parametrize("hot_rows", [100, 1000, 10**6])
def test_validity_of_a_hot_key(spark, history, hot_rows):
    rows, df = history
    want = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])
        want += [(*r, r[1], n) for r, n in zip(own, [*(r[1] for r in own[1:]), None], strict=True)]
    assert rows_of(graph.with_validity(df, hot_rows=hot_rows)) == sorted(want, key=str)


@pytest.mark.parametrize("hot_rows", [100, 10**6])
def test_as_of_each_of_a_hot_key(spark, history, hot_rows):
    rows, df = history
    asked = [(k, t) for k in ("hot", "a", "b", "none") for t in range(-3, 310, 7)]
    got = graph.as_of_each(df, spark.createDataFrame(asked, "node_id string, at long"), hot_rows=hot_rows)
    want = []
    for k, t in asked:
        before = [r for r in rows if r[0] == k and r[1] <= t]
        if before:
            want.append((k, t, *max(before, key=lambda r: r[1:3])[1:]))
    assert rows_of(got.select("node_id", "at", "tx_time", "seq", "value")) == sorted(want, key=str)


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_states_of_a_report_of_many_actions(spark, hot_rows, monkeypatch):
    monkeypatch.setattr(segments.Transitions, "BLOCK", 16)
    r = random.Random(2)
    log = [("hot" if r.random() < 0.7 else r.choice("abcd"), i, r.choice(["raise", "disposition", "close", "odd", None])) for i in range(2000)]
    want = {}
    for key, _, action in log:
        status, n, refused = want.get(key, ("", 0, 0))
        needs, gives = ncr.TRANSITIONS.get(action, ("never", None))
        fits = (needs or "") == status
        want[key] = (gives if fits else status, n + 1, refused + (not fits))
    df = spark.createDataFrame(log, "ncr_id string, seq long, action string").repartition(5)
    assert rows_of(ncr.states(df, hot_rows=hot_rows)) == sorted(((k, *v) for k, v in want.items()), key=str)


def test_segments_of_nothing(spark, history):
    none = history[1].limit(0)
    assert graph.with_validity(none).count() == 0
    assert ncr.states(none.select(F.col("node_id").alias("ncr_id"), "seq", F.col("value").alias("action"))).count() == 0


# Quantiles


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_quantiles_equal_numpy(spark, by):
    r = random.Random(3)
    rows = [(None if r.random() < 0.1 else r.choice("pq"), r.choice([1, 2]), r.choice([None, 7.0, 7.0, round(r.random() * 100, 2), -1.5])) for _ in range(3000)] + [("one", 1, 4.0), ("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(6)
    shares = {"least": 0.0, "p25": 0.25, "p50": 0.5, "p80": 0.8, "most": 1.0}
    got = {tuple(x[c] for c in by): [x[c] for c in shares] for x in quantiles.quantiles(df, "v", shares, by).collect()}
    groups = {}
    for g, h, v in rows:
        if v is not None:
            groups.setdefault(tuple({"g": g, "h": h}[c] for c in by), []).append(v)
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert np.allclose(got[key], np.quantile(values, list(shares.values())), rtol=1e-12)
    told = {tuple(x[c] for c in by): x["breach"] for x in quantiles.summarised(df, "v", F.lit(7), shares, by).collect()}
    assert all(abs(told[k] - sum(v > 7 for v in vs) / len(vs)) <= 0.0005 for k, vs in groups.items())


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "g int, v double")
    assert [tuple(r) for r in quantiles.quantiles(none, "v", {"p": 0.5}).collect()] == [(None,)]
    assert quantiles.quantiles(none, "v", {"p": 0.5}, ["g"]).count() == 0


def test_quantiles_read_only_the_ranges_of_their_ranks(spark):
    df = spark.range(40_000).selectExpr("cast(id as double) as v").repartition(4)
    assert quantiles.quantiles(df, "v", {"p": 0.1}).first()["p"] == 3999.9


# Longest paths


def longest_by_force(nodes, links):
    value = dict(nodes)
    for _ in nodes:
        for a, b, w in links:
            value[b] = max(value[b], value[a] + w)
    return value


@pytest.mark.parametrize("seed", range(4))
def test_longest_paths_equal_brute_force(spark, seed):
    r = random.Random(seed)
    n = 60
    nodes = [(f"n{i}", float(r.choice([0, 0, 5, 20]))) for i in range(n)]
    pairs = {(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range([40, 90, 200, 500][seed])) if a < b}
    links = [(f"n{a}", f"n{b}", float(r.randint(-3, 9))) for a, b in sorted(pairs)]
    links += links[:3] + [(a, b, w - 1) for a, b, w in links[3:6]]
    got = maxplus.longest(spark.createDataFrame(nodes, "node string, least double"), spark.createDataFrame(links, "src string, dst string, weight double"), rest=5)
    assert {x["node"]: x["value"] for x in got.collect()} == longest_by_force(nodes, links)


def test_a_chain_of_10000_links_takes_few_rounds(spark, monkeypatch):
    rounds = []
    write = maxplus.scratch
    monkeypatch.setattr(maxplus, "scratch", lambda df, name: rounds.append(name) or write(df, name))
    nodes = spark.range(10_001).selectExpr("cast(id as string) as node", "cast(id % 7 = 0 as int) * id as least")
    links = spark.range(10_000).selectExpr("cast(id as string) as src", "cast(id + 1 as string) as dst", "0.5 as weight")
    got = {int(x["node"]): x["value"] for x in maxplus.longest(nodes, links, rest=1000).collect()}
    value, want = 0.0, {}
    for i in range(10_001):
        value = max(value + 0.5 if i else 0.0, i if i % 7 == 0 else 0)
        want[i] = value
    assert got == want and rounds.count("chosen") < 20


def test_cycles_fail(spark):
    for n, rest in ((2, 1000), (40, 3), (1, 1000)):
        nodes = spark.range(n + 5).selectExpr("cast(id as string) as node", "0 as least")
        links = spark.range(n).selectExpr("cast(id as string) as src", f"cast((id + 1) % {n} as string) as dst", "1 as weight")
        with pytest.raises(Exception, match="cycle"):
            maxplus.longest(nodes, links, rest=rest).collect()


def test_passes_of_deep_schedules_agree_with_a_loop(spark):
    r = random.Random(9)
    day = F.lit("2026-07-20").cast("date")
    acts, links = [], []
    for i in range(120):
        status = r.choice(["TK_NotStart"] * 8 + ["TK_Complete", "TK_Active"])
        dates = {"TK_Complete": ("2026-07-06", "2026-07-13"), "TK_Active": ("2026-07-15", None)}.get(status, (None, None))
        acts.append((f"t{i}", float(r.randint(0, 9)), status, *dates, r.choice([None, "2026-08-03"])))
        for j in {i - 1, i - 2, r.randint(-5, i)} - {i}:
            if 0 <= j < i:
                links.append((f"t{j}", f"t{i}", r.choice(["FS", "SS", "FF"]), r.choice([None, 0.0, 2.0, -1.0]), len(links)))
    links.append(("gone", "t5", "FS", 0.0, 999))
    a = spark.createDataFrame(acts, "task_code string, duration double, status string, actual_start string, actual_end string, target_start string").selectExpr("task_code", "duration", "status", *(f"cast({c} as date) {c}" for c in ("actual_start", "actual_end", "target_start")))
    got = {x["task_code"]: (x["start"], x["finish"], x["driver"]) for x in schedule.forward_pass(a, spark.createDataFrame(links, "predecessor string, successor string, link string, lag_days double, seq long"), day).collect()}
    offsets = {None: 0.0, "2026-07-06": -10.0, "2026-07-13": -5.0, "2026-07-15": -3.0, "2026-08-03": 10.0}
    want = {}
    for code, d, status, begun, ended, planned in acts:
        if status == "TK_Complete":
            want[code] = (offsets[begun], offsets[ended], None)
        elif status == "TK_Active":
            want[code] = (offsets[begun], max(offsets[begun], 0.0) + d, None)
        else:
            start, driver = max(0.0, offsets[planned]), None
            for p, s, kind, lag, _ in links:
                if s == code and p in want:
                    cand = {"SS": want[p][0], "FF": want[p][1] - d, "FS": want[p][1]}[kind] + (lag or 0.0)
                    if cand > start:
                        start, driver = cand, p
            want[code] = (start, start + d, driver)
    assert got == want
    assert schedule.forward_pass(a.limit(0), spark.createDataFrame(links, "predecessor string, successor string, link string, lag_days double, seq long"), day).count() == 0


def test_a_schedule_too_large_for_a_row_is_simulated_alike(spark):
    r = random.Random(4)
    day = F.lit("2026-07-20").cast("date")
    acts, links = [], []
    for s in ("x", "y"):
        for i in range(12):
            status = r.choice(["TK_NotStart"] * 5 + ["TK_Complete"]) if i < 11 else "TK_NotStart"
            acts.append((s, f"{s}{i}", r.choice(["Deliver pump", "work", None]), status, float(r.randint(0, 9)), "2026-07-13" if status == "TK_Complete" else None, r.choice([None, "2026-07-27"])))
            links += [(f"{s}{j}", f"{s}{i}", r.choice(["FS", "SS", "FF"]), r.choice([None, 1.0]), i) for j in {i - 1, i - 3} if j >= 0]
    acts = [*acts, ("z", "z0", "done", "TK_Complete", 3.0, "2026-07-14", None)]
    a = spark.createDataFrame(acts, "s string, task_code string, name string, status string, original_duration_days double, actual_end string, target_start string")
    a = a.selectExpr("*", "cast(null as date) early_end", "cast(null as date) target_end").withColumns({c: F.col(c).cast("date") for c in ("actual_end", "target_start")})
    links = spark.createDataFrame(links, "predecessor string, successor string, link string, lag_days double, seq long")
    ends = spark.createDataFrame([("x", "x11"), ("y", "y11"), ("z", "z0")], "s string, milestone string")
    rows = lambda most: {(x.schedule, x.trial): round(x.finish, 9) for x in schedule.simulate_each(a, links, day, ends, "s", trials=20, most_tasks=most).collect()}
    small = rows(100)
    assert len(small) == 60 and rows(5) == small and len({v for (s, _), v in small.items() if s == "x"}) > 10
    assert schedule.simulate_each(a, links, day, ends, "s", trials=0).count() == 0


def test_blocks_of_trials_are_bounded_and_change_nothing(spark, monkeypatch):
    day = F.lit("2026-07-20").cast("date")
    a = spark.range(6).selectExpr("'s' as s", "cast(id as string) as task_code", "'w' as name", "'TK_NotStart' as status", "cast(id + 1 as double) as original_duration_days", "cast(null as date) actual_end", "cast(null as date) target_start", "cast(null as date) early_end", "cast(null as date) target_end")
    links = spark.range(5).selectExpr("cast(id as string) as predecessor", "cast(id + 1 as string) as successor", "'FS' as link", "0.0 as lag_days", "id as seq")
    ends = spark.createDataFrame([("s", "5")], "s string, milestone string")
    rows = lambda: {x.trial: x.finish for x in schedule.simulate_each(a, links, day, ends, "s", trials=30).collect()}
    one = rows()
    monkeypatch.setattr(schedule, "TRIAL_BYTES", 16 * 6 * 7)
    assert rows() == one and sorted(one) == list(range(30))
