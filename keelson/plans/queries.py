"""The registered queries, each with the SQL that gives the same rows.

Every query applies an operator of this library to whole tables. Texts stand
for arrays and maps, so that results compare as plain values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, scalars
from ..operators import commissioning, compliance, convergence, dashboard, delivery, documents, events, graph, ncr, quantiles, questions, retrieval, schedule
from ..session import load
from .analogues import CRITICAL, EVENT_LOG, FORWARD, critical_entities, event_log, turns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


# Convergence

_SCORES = f"""{EVENT_LOG}, {CRITICAL}, sig as (
  select *, row_number() over (partition by entity_id, agent order by risk_score desc, seq) as rn from ev where severity <> 'INFO'
), summed as (
  select entity_id, sum(cast(risk_score as decimal(10,6))) as total, count(*) as n_agents, string_agg(agent, ',' order by agent) as agents from sig where rn = 1 group by 1 having count(*) >= 2
), scored as (
  select s.entity_id, agents, n_agents, c.entity_id is not null as on_critical_path, cast(round(total * case when c.entity_id is not null then 1.5 else 1.0 end, 3) as double) as score
  from summed s left join crit c using (entity_id)
), kept as (select * from scored where score >= 0.65)"""


@query(f"with {_SCORES} select entity_id, agents, n_agents, score, on_critical_path from kept")
def converge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = convergence.convergence_scores(event_log(spark, sf_dir), critical_entities(spark, sf_dir))
    return scores.select("entity_id", F.array_join("agents", ",").alias("agents"), "n_agents", "score", "on_critical_path")


@query(f"with {_SCORES} select count(*) as n_entities, count(*) >= 3 as risk_storm from kept")
def risk_storm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convergence.risk_storm(convergence.convergence_scores(event_log(spark, sf_dir), critical_entities(spark, sf_dir)))


@query(f"with {EVENT_LOG} select entity_id, string_agg(distinct agent, ',' order by agent) as agents from ev group by 1 having count(distinct agent) >= 2")
def converge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convergence.candidates(event_log(spark, sf_dir)).select("entity_id", F.array_join("agents", ",").alias("agents"))


@query(f"with {EVENT_LOG}, s as (select *, row_number() over (partition by entity_id, agent order by risk_score desc, seq) as rn from ev where severity <> 'INFO') select entity_id, agent, seq, severity, risk_score from s where rn = 1")
def strongest_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convergence.strongest_signals(event_log(spark, sf_dir)).select("entity_id", "agent", "seq", "severity", "risk_score")


@query(
    f"""with {_SCORES} select entity_id, score, case when on_critical_path then 1.5 else 1.0 end::double as criticality_weight, 30 as delay_days, 1500000.0::double as exposure,
      entity_id || ' flagged independently by ' || replace(agents, ',', ', ') || ' (score ' || score || ')' as narrative, n_agents as n_signals from kept"""
)
def converge_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = convergence.alerts(event_log(spark, sf_dir), critical_entities(spark, sf_dir), F.lit(30))
    return told.select("entity_id", "score", "criticality_weight", "delay_days", "exposure", "narrative", F.size("agent_signals").cast("long").alias("n_signals"))


# Events


@query(f"with {EVENT_LOG} select seq, agent, entity_id, severity, risk_score from ev where entity_id = '42'")
def events_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.select_events(event_log(spark, sf_dir), entity="42").select("seq", "agent", "entity_id", "severity", "risk_score")


@query(f"with {EVENT_LOG} select seq, agent, entity_id, severity, risk_score from ev where agent = 'error'")
def events_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.select_events(event_log(spark, sf_dir), agent="error").select("seq", "agent", "entity_id", "severity", "risk_score")


@query(f"with {EVENT_LOG} select seq, agent, entity_id, severity from ev order by seq desc limit 100")
def events_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.recent(event_log(spark, sf_dir)).select("seq", "agent", "entity_id", "severity")


@query(f"with {EVENT_LOG} select seq, agent, entity_id from ev where agent not in ('click', 'view')")
def events_without_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.without_agents(event_log(spark, sf_dir), ["click", "view"]).select("seq", "agent", "entity_id")


@query(f"with {EVENT_LOG} select seq, agent, entity_id, severity from ev where not (agent = 'error' and severity = 'LOW')")
def events_remove_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.without_matching(event_log(spark, sf_dir), agent="error", severity="LOW").select("seq", "agent", "entity_id", "severity")


@query(f"with {EVENT_LOG} select agent, severity, count(*) as n, round(max(risk_score), 3) as worst from ev group by 1, 2")
def events_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events.publishable(event_log(spark, sf_dir))
    return log.groupBy("agent", "severity").agg(F.count("*").alias("n"), F.round(F.max("risk_score"), 3).alias("worst"))


# Versions


@query(f"with {EVENT_LOG}, v as (select *, row_number() over (partition by entity_id order by ts desc, seq desc) as rn from ev where ts <= timestamp '2024-01-10 12:00:00') select entity_id, seq, agent, risk_score from v where rn = 1")
def node_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.as_of(event_log(spark, sf_dir), F.lit("2024-01-10 12:00:00").cast("timestamp"), key="entity_id", time="ts").select("entity_id", "seq", "agent", "risk_score")


@query(
    f"""with {EVENT_LOG}, asked as (select distinct cast(user_id as varchar) as entity_id, date_trunc('day', ts) as at from events where event_type = 'error')
    select a.entity_id, strftime(a.at, '%Y-%m-%d') as day, e.seq, e.agent from asked a asof join ev e on a.entity_id = e.entity_id and a.at >= e.ts"""
)
def node_as_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).select("entity_id", "ts", "seq", "agent")
    asked = event_log(spark, sf_dir).where("agent = 'error'").select("entity_id", F.date_trunc("day", "ts").alias("at")).distinct()
    return graph.as_of_each(log, asked, key="entity_id", time="ts").select("entity_id", F.date_format("at", "yyyy-MM-dd").alias("day"), "seq", "agent")


@query(
    f"""with {EVENT_LOG}, v as (select entity_id, seq, ts, lead(ts) over (partition by entity_id order by ts, seq) as nx from ev)
    select entity_id, seq, epoch_us(ts) as tx_from, epoch_us(nx) as tx_to from v"""
)
def node_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = graph.with_validity(event_log(spark, sf_dir), key="entity_id", time="ts")
    return v.select("entity_id", "seq", F.unix_micros("tx_from").alias("tx_from"), F.unix_micros("tx_to").alias("tx_to"))


@query(
    f"""with {EVENT_LOG}, a as (
      select entity_id, ts, seq, 'last_' || agent as name, severity as value from ev union all select entity_id, ts, seq, 'severity', severity from ev
    ), r as (select *, row_number() over (partition by entity_id, name order by ts desc, seq desc) as rn from a)
    select entity_id, string_agg(name || '=' || value, ';' order by name) as attributes from r where rn = 1 group by 1"""
)
def attribute_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).withColumn("attributes", F.create_map(F.concat(F.lit("last_"), "agent"), F.col("severity"), F.lit("severity"), F.col("severity")))
    merged = graph.merged_attributes(log, key="entity_id", time="ts")
    return merged.select("entity_id", F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("attributes"))


@query(f"with {EVENT_LOG}, r as (select *, row_number() over (partition by entity_id, agent order by seq desc) as rn from ev) select entity_id, max(risk_score) as risk_score, count(*) as n_agents from r where rn = 1 group by 1")
def agent_risk_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    risks = graph.agent_risks(event_log(spark, sf_dir).withColumn("score", F.col("risk_score")), key="entity_id")
    return risks.select("entity_id", "risk_score", F.size("agent_risks").cast("long").alias("n_agents"))


# First, last and distinct rows


@query("select user_id, min(event_id) as event_id from events group by 1")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.first_by(load(spark, sf_dir, "events"), ["user_id"], F.col("event_id").asc()).select("user_id", "event_id")


@query("select user_id, max(event_id) as event_id from events group by 1")
def last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.first_by(load(spark, sf_dir, "events"), ["user_id"], F.col("event_id").desc()).select("user_id", "event_id")


@query("select min(doc_id) as doc_id, lang, n_chars from documents group by lang, n_chars")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.without_duplicates(load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), ["lang", "n_chars"], "doc_id")


# Filters and orders


@query("select p_partkey, (p_retailprice - 900) / 100 as risk_score from part where (p_retailprice - 900) / 100 > 0.5")
def risk_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = load(spark, sf_dir, "part").select("p_partkey", F.lit("Equipment").alias("node_type"), ((F.col("p_retailprice") - 900) / 100).alias("risk_score"))
    return graph.at_risk(nodes).select("p_partkey", "risk_score")


@query("select o_orderkey as task_code, strftime(o_orderdate, '%Y-%m-%d') as early_start from orders where o_orderpriority = '1-URGENT' order by early_start, task_code")
def critical_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_code"), F.to_date("o_orderdate").alias("early_start"), (F.col("o_orderpriority") == "1-URGENT").alias("is_critical"))
    return graph.critical_activities(rows).select("task_code", F.date_format("early_start", "yyyy-MM-dd").alias("early_start"))


@query("select p_partkey, p_retailprice, case when p_retailprice / 2000 >= 0.8 then 'critical' when p_retailprice / 2000 >= 0.6 then 'high' when p_retailprice / 2000 >= 0.3 then 'medium' else 'low' end as band from part order by p_retailprice desc, p_partkey limit 50")
def topn_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.lit("Equipment").alias("node_type"), (F.col("p_retailprice") / 2000).alias("risk_score"), "p_retailprice")
    return dashboard.equipment_by_risk(nodes).limit(50).select(F.col("node_id").alias("p_partkey"), "p_retailprice", "band")


@query("select o_orderkey, o_orderstatus from orders where lower(o_orderstatus) = 'o'")
def status_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.of_status(load(spark, sf_dir, "orders"), "O", "o_orderstatus").select("o_orderkey", "o_orderstatus")


@query("select p_partkey, p_brand from part where starts_with(p_brand, 'Brand#2') and not starts_with(p_brand, 'Brand#22')")
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.of_prefix(load(spark, sf_dir, "part"), "Brand#2", "p_brand", but=("Brand#22",)).select("p_partkey", "p_brand")


@query("select doc_id, substr(sha256(text), 1, 12) as version_id, regexp_matches(substr(sha256(text), 1, 12), '^[0-9a-f]{12}$') as ok, regexp_replace(source || '/' || lang, '[^A-Za-z0-9._ -]', '_', 'g') as name from documents")
def id_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = scalars.content_id(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", id_.alias("version_id"), scalars.is_content_id(id_).alias("ok"), scalars.safe_name(F.concat_ws("/", "source", "lang")).alias("name"))


# Graph joins


@query("select l_orderkey, l_partkey from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT') and l_partkey in (select p_partkey from part where p_size < 10)")
def semi_both_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "l_orderkey", "l_partkey")
    nodes = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), "o_orderkey").alias("node_id")).union(load(spark, sf_dir, "part").where("p_size < 10").select(F.concat(F.lit("p"), "p_partkey")))
    return graph.edges_between(links, nodes).select("l_orderkey", "l_partkey")


@query(
    """with e as (select distinct 'S' || l_suppkey as src, 'P' || l_partkey as dst from lineitem), n as (select 'S' || s_suppkey as id, s_name as label from supplier union all select 'P' || p_partkey, p_name from part)
    select src as node_id, dst as neighbour, 'out' as direction, label from e join n on n.id = dst union all select dst, src, 'in', label from e join n on n.id = src"""
)
def neighbors_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), F.lit("SUPPLIES").alias("relationship")).distinct()
    nodes = load(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node_id"), F.col("s_name").alias("label")).union(load(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey"), "p_name"))
    return graph.neighbours(edges, nodes, "SUPPLIES", "both").select("node_id", "neighbour", "direction", F.col("node.label").alias("label"))


@query(
    """with m as (select l_orderkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey) as rn from lineitem)
    select 'C' || c_custkey as item, cast(o_orderkey as varchar) as activity, coalesce('S' || m.l_suppkey, 'critical path') as gates_milestone from customer join orders on c_custkey = o_custkey left join m on m.l_orderkey = o_orderkey and m.rn = 1
    where c_mktsegment = 'BUILDING' and (o_orderpriority = '1-URGENT' or m.l_suppkey is not null)"""
)
def hop3_open_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    items = customers.select(F.concat(F.lit("C"), "c_custkey").alias("item"), F.when(F.col("c_mktsegment") == "BUILDING", "Open").otherwise("Closed").alias("status"))
    links = orders.select(F.concat(F.lit("C"), "o_custkey").alias("item"), F.col("o_orderkey").cast("string").alias("activity"))
    activities = orders.select(F.col("o_orderkey").cast("string").alias("activity"), (F.col("o_orderpriority") == "1-URGENT").alias("is_critical"))
    milestones = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("activity"), F.concat(F.lit("S"), "l_suppkey").alias("milestone"), F.struct("l_linenumber", "l_suppkey").alias("seq"))
    return graph.open_on_critical_path(items, links, activities, milestones).select("item", "activity", "gates_milestone")


@query("select p_partkey, word from part, (values ('ring'), ('gear'), ('hot')) w(word) where contains(p_name, word)")
def keyword_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = spark.createDataFrame([("ring",), ("gear",), ("hot",)], "word string")
    return graph.containing(load(spark, sf_dir, "part"), F.col("p_name"), keywords, F.col("word")).select("p_partkey", "word")


@query(
    """with e as (select 'UPS-' || lpad(cast(p_size as varchar), 2, '0') as tag from part union select 'GEN-' || lpad(cast(p_size as varchar), 2, '0') from part where p_size <= 5),
    c as (select p_partkey, case when p_partkey % 3 = 0 then 'the uninterruptible unit ' || p_name when p_partkey % 3 = 1 then 'standby engine of ' || p_name else 'unit UPS-' || lpad(cast(p_size as varchar), 2, '0') end as t from part)
    select tag, p_partkey from e, c where contains(upper(t), tag) or (starts_with(tag, 'UPS') and contains(upper(t), 'UNINTERRUPTIBLE')) or (starts_with(tag, 'GEN') and contains(upper(t), 'STANDBY ENGINE')) or (starts_with(tag, 'UPS') and contains(upper(t), 'UPS'))"""
)
def clause_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    size = F.lpad(F.col("p_size").cast("string"), 2, "0")
    tags = part.select(F.concat(F.lit("UPS-"), size).alias("tag")).union(part.where("p_size <= 5").select(F.concat(F.lit("GEN-"), size))).distinct()
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("the uninterruptible unit "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("standby engine of "), "p_name")).otherwise(F.concat(F.lit("unit UPS-"), size))
    clauses = part.select(F.col("p_partkey").alias("clause"), text.alias("text"))
    return graph.clause_edges(tags, clauses).select(F.col("src").alias("tag"), F.col("dst").alias("p_partkey"))


@query("with e as (select l_suppkey, l_partkey, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey, l_partkey order by l_orderkey desc, l_linenumber desc) as rn, l_returnflag from lineitem) select l_suppkey, l_partkey, l_orderkey from e where rn = 1")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("SUPPLIES").alias("relationship"), F.struct("l_orderkey", "l_linenumber").alias("seq"), "l_orderkey")
    return graph.latest_edges(edges).select(F.col("src").alias("l_suppkey"), F.col("dst").alias("l_partkey"), "l_orderkey")


# The sales tables as a graph: parts are equipment, orders activities, customers RFIs on their orders, suppliers vendors.
_GRAPH = """eq as (select 'P' || p_partkey as tag, p_brand, p_retailprice / 2000 as risk from part),
act as (select 'A' || o_orderkey as code, o_orderpriority = '1-URGENT' as crit, o_orderstatus from orders),
req as (select distinct 'A' || l_orderkey as src, 'P' || l_partkey as dst from lineitem),
rfi as (select 'R' || c_custkey as id, c_mktsegment = 'BUILDING' as live from customer), lnk as (select 'R' || o_custkey as src, 'A' || o_orderkey as dst from orders),
ncr as (select 'N' || l_orderkey || '-' || l_linenumber as id, min(l_returnflag) as flag from lineitem where l_quantity > 45 group by 1), imp as (select distinct 'N' || l_orderkey || '-' || l_linenumber as src, 'P' || l_partkey as dst from lineitem where l_quantity > 45),
dev as (select distinct 'P' || l_partkey as tag, 'DEV::P' || l_partkey || '::C-' || l_linenumber || '::x' as id from lineitem where l_discount >= 0.09)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, orders, customers, lines = (load(spark, sf_dir, t) for t in ("part", "orders", "customer", "lineitem"))
    id_ = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    report = F.concat(F.lit("N"), "l_orderkey", F.lit("-"), "l_linenumber")
    node = lambda df, id_, kind, risk=None, **more: df.select(id_.alias("node_id"), F.lit(kind).alias("node_type"), F.create_map(*(x for k, v in more.items() for x in (F.lit(k), v))).alias("attributes"), (F.lit(None).cast("double") if risk is None else risk).alias("risk_score"))
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("relationship")).distinct()
    heavy = lines.where("l_quantity > 45")
    reports = heavy.groupBy(report.alias("id")).agg(F.min("l_returnflag").alias("flag"))
    found = lines.where("l_discount >= 0.09").select(F.concat(F.lit("DEV::P"), "l_partkey", F.lit("::C-"), "l_linenumber", F.lit("::x")).alias("id")).distinct()
    nodes = [
        node(part, id_("P", "p_partkey"), "Equipment", F.col("p_retailprice") / 2000, vendor=F.col("p_brand"), submitted_parameters=F.lit("many")),
        node(orders, id_("A", "o_orderkey"), "ScheduleActivity", status=F.col("o_orderstatus"), is_critical=(F.col("o_orderpriority") == "1-URGENT").cast("string")),
        node(customers, id_("R", "c_custkey"), "RFI", status=F.when(F.col("c_mktsegment") == "BUILDING", "Open").otherwise("Closed")),
        node(reports, F.col("id"), "NCR", status=F.when(F.col("flag") == "R", "Closed").otherwise("open"), title=F.col("flag")),
        node(found, F.col("id"), "Deviation", parameter=F.lit("x")),
        node(load(spark, sf_dir, "region"), id_("M", "r_regionkey"), "Milestone", expected_delay_days=F.col("r_regionkey").cast("string")),
    ]
    edges = [
        edge(lines, id_("A", "l_orderkey"), id_("P", "l_partkey"), "REQUIRES"),
        edge(orders, id_("R", "o_custkey"), id_("A", "o_orderkey"), "LINKED_TO"),
        edge(heavy, report, id_("P", "l_partkey"), "IMPACTS"),
        edge(part, id_("P", "p_partkey"), F.col("p_brand"), "PROCURED_FROM"),
    ]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


@query(
    f"""with {_GRAPH}, act_of as (select dst as tag, count(*) as n, bool_or(crit) as crit from req join act on code = src group by 1), ncr_of as (select dst as tag, count(*) as n from imp join ncr on id = src where flag <> 'R' group by 1),
    rfi_of as (select req.dst as tag, count(distinct lnk.src) as n from req join lnk on lnk.dst = req.src join rfi on rfi.id = lnk.src where live group by 1), dev_of as (select tag, count(*) as n from dev group by 1)
    select tag as entity_id, coalesce(act_of.n, 0) as n_activities, coalesce(ncr_of.n, 0) as n_open_ncrs, coalesce(rfi_of.n, 0) as n_open_rfis, coalesce(dev_of.n, 0) as n_deviations, coalesce(act_of.crit, false) as on_critical_path
    from eq left join act_of using (tag) left join ncr_of using (tag) left join rfi_of using (tag) left join dev_of using (tag)"""
)
def entity_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.entity_contexts(*_graph(spark, sf_dir)).select("entity_id", "n_activities", "n_open_ncrs", "n_open_rfis", "n_deviations", "on_critical_path")


def _few(rows: str, more: str = "") -> str:
    """SQL: the first three ids of each tag, with what else is told of them, and how many there are."""
    return f"(select tag, string_agg(id{more}, ',' order by id) filter (where rn <= 3) as ids, count(*) as n from (select *, row_number() over (partition by tag order by id) as rn from ({rows})) group by 1)"


@query(
    f"""with {_GRAPH} select e.tag as entity_id, d.ids as deviations, a.ids as activities, r.ids as open_rfis, n.ids as open_ncrs, coalesce(d.n, 0) as n_deviations, coalesce(a.n, 0) as n_activities, coalesce(r.n, 0) as n_open_rfis, coalesce(n.n, 0) as n_open_ncrs, p_brand as vendor, 'M0=0' as milestone
    from eq e left join {_few("select tag, id from dev")} d using (tag) left join {_few("select req.dst as tag, code as id, crit from req join act on code = src", " || '=' || crit")} a using (tag)
    left join {_few("select distinct req.dst as tag, rfi.id from req join lnk on lnk.dst = req.src join rfi on rfi.id = lnk.src where live")} r using (tag) left join {_few("select dst as tag, id, flag from imp join ncr on id = src where flag <> 'R'", " || '=' || flag")} n using (tag)"""
)
def entity_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    found = questions.entity_bundles(nodes, edges, most=3).where("node_type = 'Equipment'")
    told = lambda name, more=None: F.nullif(F.array_join(F.transform(name, lambda x: F.concat(x["id"], F.lit("="), x[more]) if more else x["id"]), ","), F.lit("")).alias(name)
    numbers = [f"n_{c}" for c in ("deviations", "activities", "open_rfis", "open_ncrs")]
    return found.select("entity_id", told("deviations"), told("activities", "is_critical"), told("open_rfis"), told("open_ncrs", "title"), *numbers, F.col("attributes")["vendor"].alias("vendor"), F.concat("milestone.id", F.lit("="), "milestone.expected_delay_days").alias("milestone"))


@query(
    f"""with {_GRAPH} select 'equipment' as kind, tag as id, null as path from eq where tag = 'P77' union all select 'deviation', id, 'P77 <-derived- ' || id from dev where tag = 'P77' union all select 'activity', src, src || ' -REQUIRES-> P77' from req where dst = 'P77'
    union all select 'vendor', p_brand, 'P77 -PROCURED_FROM-> ' || p_brand from eq where tag = 'P77' and false union all select 'ncr', src, src || ' -IMPACTS-> P77' from imp where dst = 'P77'"""
)
def entity_status_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.equipment_status(*_graph(spark, sf_dir), "P77").select("kind", "id", "path")


@query(
    f"""with {EVENT_LOG}, w as (select entity_id, seq, ts, agent, severity, case when severity = 'CRITICAL' then ts + interval 1 hour end as given from ev),
    h as (select entity_id, first(agent order by ts, seq) as node_type, coalesce(last(given order by ts, seq) filter (given is not null), min(ts)) as v, max(ts) as t from w group by 1),
    a as (select *, row_number() over (partition by entity_id, agent order by ts desc, seq desc) as rn from w)
    select h.entity_id, node_type, epoch_us(v) as valid_time, epoch_us(t) as transaction_time, string_agg(agent || '=' || severity, ';' order by agent) as attributes from h join a on a.entity_id = h.entity_id and rn = 1 group by 1, 2, 3, 4"""
)
def node_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.current_nodes(_writes(spark, sf_dir))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select(F.col("node_id").alias("entity_id"), "node_type", F.unix_micros("valid_time").alias("valid_time"), F.unix_micros("transaction_time").alias("transaction_time"), pairs.alias("attributes"))


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("severity") == "CRITICAL", F.col("ts") + F.expr("interval 1 hour"))
    return event_log(spark, sf_dir).select(F.col("entity_id").alias("node_id"), F.col("agent").alias("node_type"), F.create_map("agent", "severity").alias("attributes"), given.alias("valid_time"), F.col("ts").alias("tx_time"), "seq")


@query(
    f"""with {EVENT_LOG}, w as (select entity_id, seq, ts, agent, case when severity = 'CRITICAL' then ts + interval 1 hour end as given from ev)
    select entity_id, seq, first_value(agent) over k as node_type, epoch_us(coalesce(last_value(given ignore nulls) over (partition by entity_id order by ts, seq rows between unbounded preceding and current row), first_value(ts) over k)) as valid_time,
      epoch_us(lead(ts) over k) as tx_to from w window k as (partition by entity_id order by ts, seq)"""
)
def node_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.node_history(_writes(spark, sf_dir))
    return found.select(F.col("node_id").alias("entity_id"), "seq", "node_type", F.unix_micros("valid_time").alias("valid_time"), F.unix_micros("tx_to").alias("tx_to"))


@query(
    """with a as (select p_partkey as k, p_name, p_size from part where p_partkey % 10 <> 0), b as (select p_partkey as k, p_name, case when p_partkey % 7 = 0 then p_size + 1 else p_size end as p_size from part where p_partkey % 10 <> 1)
    select case when a.k is null then 'added' when b.k is null then 'removed' else 'changed' end as op, coalesce(a.k, b.k) as k, coalesce(b.p_name, a.p_name) as p_name, coalesce(b.p_size, a.p_size) as p_size
    from a full join b on a.k = b.k where a.k is null or b.k is null or a.p_size <> b.p_size"""
)
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_size")
    new = part.where("k % 10 <> 1").withColumn("p_size", F.when(F.col("k") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return graph.changes(part.where("k % 10 <> 0"), new, ["k"])


@query(
    """with e as (select distinct 'UPS-' || lpad(cast(p_size as varchar), 2, '0') as tag from part), c as (select 'SPEC::C' || p_partkey || '::' || p_type as clause, 'unit UPS-' || lpad(cast(p_size as varchar), 2, '0') || ' ' || p_type || ' ' || p_name as t from part where p_partkey % 3 = 0),
    s as (select distinct 'UPS-' || lpad(cast(l_linenumber as varchar), 2, '0') as tag, 'S' || l_suppkey as vendor from lineitem), q as (select tag from e union select tag from s)
    select tag as src, vendor as dst, 'PROCURED_FROM' as relationship from s union select tag, clause, 'SPECIFIED_BY' from q, c where contains(upper(t), tag) or contains(upper(t), 'UPS')
    union select 'R' || o_custkey, 'A' || o_orderkey, 'LINKED_TO' from orders where o_orderstatus = 'O' union select 'T' || r_regionkey, 'UPS-0' || r_regionkey, 'TESTS' from region where 'UPS-0' || r_regionkey in (select tag from q)"""
)
def fact_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, lines, orders, regions = (load(spark, sf_dir, t) for t in ("part", "lineitem", "orders", "region"))
    tag = lambda c: F.concat(F.lit("UPS-"), F.lpad(F.col(c).cast("string"), 2, "0"))
    activity = F.concat(F.lit("A"), "o_orderkey")
    nodes = part.select(tag("p_size").alias("node_id"), F.lit("Equipment").alias("node_type")).distinct().union(orders.where("o_orderstatus = 'O'").select(activity, F.lit("ScheduleActivity")))
    submittals = lines.select(tag("l_linenumber").alias("equipment_tag"), F.concat(F.lit("S"), "l_suppkey").alias("vendor"))
    requirements = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("C"), "p_partkey").alias("clause_id"), F.col("p_type").alias("parameter"), F.lit(None).cast("string").alias("canonical_parameter"), F.concat(F.lit("unit "), tag("p_size")).alias("system"), F.col("p_name").alias("source_text"))
    rfis = orders.select(F.concat(F.lit("R"), "o_custkey").alias("rfi_id"), activity.alias("linked_activity"))
    procedures = regions.select(F.concat(F.lit("T"), "r_regionkey").alias("procedure_id"), F.concat(F.lit("load test of UPS-0"), "r_regionkey").alias("title"))
    return graph.fact_graph(nodes, submittals, requirements, rfis, procedures)[1]


@query(f"with {_GRAPH} select distinct req.dst as entity_id, rfi.id from req join lnk on lnk.dst = req.src join rfi on rfi.id = lnk.src where live")
def open_items_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.open_rfis(*_graph(spark, sf_dir)).select("entity_id", "id")


@query(f"with {_GRAPH} select dst as entity_id, id, flag as title from imp join ncr on id = src where flag <> 'R'")
def open_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.open_reports(*_graph(spark, sf_dir)).select("entity_id", "id", "title")


@query(
    """with t as (select 'UPS-' || lpad(cast(l_partkey % 50 as varchar), 2, '0') as tag, 'A' || l_orderkey as code, min(l_orderkey) as seq from lineitem where l_linenumber = 1 group by 1, 2), r as (select *, row_number() over (partition by tag order by seq, code) as rn from t)
    select tag, count(*) as n_activities, string_agg(code, ',' order by rn) filter (where rn <= 1000) as discovered_in from r group by 1"""
)
def equipment_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.concat(F.lit("UPS-"), F.lpad((F.col("l_partkey") % 50).cast("string"), 2, "0"))
    named = load(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.concat(F.lit("A"), "l_orderkey").alias("task_code"), F.concat(F.lit("Install "), tag, F.lit(" for RFI-01")).alias("name"), F.col("l_orderkey").alias("seq"))
    return graph.discovered(named).select("tag", "n_activities", F.array_join("discovered_in", ",").alias("discovered_in"))


# Deliveries

_BUFFERS = """orders_of as (select l_partkey as tag, min(case when l_linenumber = 1 then l_orderkey end) as delivery from lineitem group by 1),
eta as (select d.tag, d.delivery, min(cast(l_shipdate as date)) as eta, bool_or(o_orderpriority = '1-URGENT') as crit from orders_of d join lineitem l on l.l_partkey = d.tag and l.l_orderkey = d.delivery and l.l_linenumber = 1 join orders on o_orderkey = d.delivery group by 1, 2),
need as (select l_partkey as tag, min(cast(o_orderdate as date)) + 1130 as need, bool_or(o_orderpriority = '1-URGENT') as crit from lineitem join orders on o_orderkey = l_orderkey where l_linenumber <> 1 group by 1),
buf as (select e.tag, delivery, eta, need, date_diff('day', eta, need) as buffer_days, e.crit or n.crit as critical from eta e join need n using (tag))"""


def _buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    joined = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = joined.select(
        F.col("l_partkey").alias("tag"), F.col("l_orderkey").alias("task_code"), (F.col("l_linenumber") == 1).alias("is_delivery"), F.lit("TK_NotStart").alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("is_critical"),
        F.lit(None).cast("date").alias("actual_end"), F.to_date("l_shipdate").alias("early_end"), F.lit(None).cast("date").alias("target_end"),
        F.date_add(F.to_date("o_orderdate"), 1130).alias("early_start"), F.lit(None).cast("date").alias("target_start"), F.struct("l_orderkey", "l_shipdate").alias("seq"),
    )
    return delivery.delivery_buffers(rows)


@query(f"with {_BUFFERS} select tag, delivery as delivery_activity, strftime(eta, '%Y-%m-%d') as revised_eta, strftime(need, '%Y-%m-%d') as required_by, cast(buffer_days as integer) as buffer_days, critical as on_critical_path from buf")
def delivery_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buffers(spark, sf_dir).select("tag", "delivery_activity", F.col("revised_eta").cast("string").alias("revised_eta"), F.col("required_by").cast("string").alias("required_by"), "buffer_days", "on_critical_path")


_SEVERITY = "case when buffer_days < 0 then 'CRITICAL' when buffer_days < 7 then 'HIGH' when buffer_days < 14 then 'MEDIUM' else 'ON_TRACK' end"


@query(f"with {_BUFFERS} select {_SEVERITY} as severity, count(*) as n from buf group by 1")
def delivery_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.delivery_report(_buffers(spark, sf_dir)).groupBy("severity").agg(F.count("*").alias("n"))


@query(
    f"""with {_BUFFERS} select tag, {_SEVERITY} as severity, round(least(0.95::double, (0.15::double + 0.65::double * greatest(0::double, least(1::double, (14 - buffer_days) / 20.0::double))) * case when critical and buffer_days < 14 then 1.2::double else 1::double end), 3) as risk_score from buf"""
)
def delivery_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.delivery_report(_buffers(spark, sf_dir)).select("tag", "severity", "risk_score")


# Compliance

_COMPARED = """cmp as (
  select l_orderkey, l_linenumber, l_partkey, p_size, (case l_linenumber % 3 when 0 then l_quantity when 1 then l_quantity * 1000 * 0.001 else l_quantity end) as compared, cast(p_size as double) as required,
    case l_linenumber % 4 when 0 then 'greater_equal' when 1 then 'less_equal' when 2 then 'equal' else 'range' end as op, case when p_type in ('STANDARD', 'SMALL') then 'CRITICAL' when p_type = 'PROMO' then 'MINOR' else 'MAJOR' end as criticality
  from lineitem join part on p_partkey = l_partkey
), jud as (
  select *, case op when 'greater_equal' then compared >= required when 'less_equal' then compared <= required when 'equal' then abs(compared - required) <= 0.1 * required else compared >= required and compared <= required + 5 end as compliant,
    round(abs(compared - required) / required * 100, 2) as margin_pct from cmp
)"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    k, kind = F.col("l_linenumber") % 3, F.col("l_linenumber") % 4
    whole = F.col("l_quantity").cast("int")
    rows = joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "p_size", F.col("p_size").cast("string").alias("value"), F.when(k == 1, "MVA").otherwise("percent").alias("unit"),
        F.when(kind == 0, "greater_equal").when(kind == 1, "less_equal").when(kind == 2, "equal").otherwise("range").alias("comparison"), (F.col("p_size") + 5).cast("string").alias("value_max"), F.lit("±10%").alias("tolerance"),
        F.when(F.col("p_type").isin("STANDARD", "SMALL"), "CRITICAL").when(F.col("p_type") == "PROMO", "MINOR").otherwise("MAJOR").alias("criticality"),
        F.when(k == 1, F.concat((whole * 1000).cast("string"), F.lit(" kVA"))).otherwise(F.concat(whole.cast("string"), F.lit(" %"))).alias("submitted_value"), F.when(k == 1, "kVA").otherwise("%").alias("submitted_unit"),
    )
    return rules.with_comparison(rows)


@query(f"with {_COMPARED} select l_orderkey, l_linenumber, l_partkey, op as comparison, compliant from jud")
def compare_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "comparison", "compliant")


@query(f"with {_COMPARED} select l_orderkey, l_linenumber, l_partkey, margin_pct from jud")
def margin_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "margin_pct")


_DEVIATION = "round(least(1.0::double, case criticality when 'CRITICAL' then 0.9::double when 'MAJOR' then 0.6::double else 0.3::double end + least(margin_pct, 50) / 500), 3)"


@query(f"with {_COMPARED} select l_orderkey, l_linenumber, l_partkey, criticality as severity, {_DEVIATION} as risk_score from jud where not compliant")
def deviation_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _compared(spark, sf_dir).withColumn("source_text", F.lit(None).cast("string"))
    return compliance.deviations(rows).select("l_orderkey", "l_linenumber", "l_partkey", "severity", "risk_score")


@query(f"with {_COMPARED} select count(*) as n_deviations, round(least(1.0::double, max({_DEVIATION}) + 0.02 * (count(*) - 1)), 3) as overall_risk from jud where not compliant")
def deviation_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.overall(compliance.deviations(_compared(spark, sf_dir).withColumn("source_text", F.lit(None).cast("string"))))


@query(
    """with s as (select distinct l_partkey from lineitem where l_suppkey = 7) select 'C' || p_partkey as clause_id, p_type as parameter, l_partkey is not null as linked from part left join s on l_partkey = p_partkey where l_partkey is not null or contains(upper(p_name), 'RING')"""
)
def governing_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, lines = load(spark, sf_dir, "part"), load(spark, sf_dir, "lineitem")
    requirements = part.select(F.concat(F.lit("C"), "p_partkey").alias("clause_id"), F.col("p_type").alias("parameter"), F.col("p_name").alias("source_text"))
    linked = lines.where("l_suppkey = 7").select("l_partkey").distinct()
    specified = part.join(linked, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(F.concat(F.lit("C"), "p_partkey").alias("clause_id"), F.col("p_type").alias("parameter"))
    found = compliance.governing(requirements, specified, "ring")
    return found.join(specified.select("clause_id", F.lit(True).alias("hit")), "clause_id", "left").select("clause_id", "parameter", F.coalesce("hit", F.lit(False)).alias("linked"))


_MATCH = """req as (select p_partkey as req, p_brand, p_type as canon, p_name as words from part where p_partkey % 2 = 0),
par as (select p_partkey as seq, p_brand, case when p_size < 25 then p_type end as canon, p_name as words, p_size % 3 > 0 as fits from part where p_partkey % 2 = 1),
pairs as (
  select req, seq, coalesce(req.canon = par.canon, false) as canonical, fits, len(list_intersect(list_distinct(regexp_extract_all(lower(req.words), '[a-z]+')), list_distinct(regexp_extract_all(lower(par.words), '[a-z]+')))) as overlap from req join par using (p_brand)
), best as (
  select *, row_number() over (partition by req order by canonical desc, overlap desc, fits desc, seq) as rn from pairs where canonical or overlap >= 2)"""


@query(f"with {_MATCH} select req, seq, canonical, cast(overlap as integer) as overlap, fits from best where rn = 1")
def best_parameter_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    named = [F.col("p_brand"), F.col("p_name").alias("parameter")]
    req = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("req"), *named, F.col("p_type").alias("canonical_parameter"), F.lit("kV").alias("unit"))
    par = part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("seq"), *named, F.when(F.col("p_size") < 25, F.col("p_type")).alias("canonical_parameter"), F.when(F.col("p_size") % 3 > 0, "volts").otherwise("ms").alias("unit"), F.lit("400").alias("value"))
    return compliance.best_matches(req, par, "req", "p_brand")


# Commissioning


def _session(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as sessions: a turn is a step, its text's length the reading."""
    readings = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.lit("P1").alias("procedure_id"), F.col("turn").alias("seq"), F.length("text").cast("string").alias("reading"))
    kinds = [("less_equal", 400.0, None, None, None), ("greater_equal", 20.0, None, None, None), ("range", None, 50.0, 900.0, None), ("equal", 200.0, None, None, 150.0)]
    rows = [("P1", n + 1, f"m{n}", False, n % 2 == 0, "mm", *kinds[n % 4], None) for n in range(8)]
    steps = spark.createDataFrame(rows, "procedure_id string, step_no int, measurement string, hold_point boolean, critical_hold boolean, unit string, operator string, limit double, min double, max double, tolerance double, expected boolean")
    procedures = spark.createDataFrame([("P1", "Load test", None, "UPS-01", "ACT-001")], "procedure_id string, title string, system string, equipment_tag string, linked_activity string")
    return readings, steps, procedures


_READINGS = """rd as (select conv_id as session_id, row_number() over (partition by conv_id order by turn) as step_no, cast(length(text) as double) as v from conversations),
res as (select session_id, step_no, case when (case (step_no - 1) % 4 when 0 then v <= 400 when 1 then v >= 20 when 2 then v between 50 and 900 else abs(v - 200) <= 150 end) then 'PASS' else 'FAIL' end as result from rd where step_no <= 8)"""


@query(f"with {_READINGS} select session_id, cast(step_no as integer) as step_no, result from res")
def acceptance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, steps, _ = _session(spark, sf_dir)
    return commissioning.judged(readings, steps).select("session_id", "step_no", "result")


@query(f"with {_READINGS} select session_id, count(*) as n_done, count(*) filter (where result = 'FAIL') as n_failed, case when count(*) < 8 then 'in_progress' when count(*) filter (where result = 'FAIL') = 0 then 'passed' else 'failed' end as state from res group by 1")
def session_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, steps, _ = _session(spark, sf_dir)
    return commissioning.verdicts(commissioning.judged(readings, steps), steps).drop("procedure_id")


@query(
    f"""with {_READINGS}, f as (select *, row_number() over (order by session_id, step_no) + 7 as n from res where result = 'FAIL')
    select 'RFI-' || case when length(cast(n as varchar)) >= 4 then cast(n as varchar) else lpad(cast(n as varchar), 4, '0') end as rfi_id, 'Load test - step ' || step_no || ' acceptance failure' as subject, case when step_no % 2 = 1 then 'High' else 'Medium' end as priority, 'Commissioning' as discipline from f"""
)
def auto_rfi(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, steps, procedures = _session(spark, sf_dir)
    return commissioning.failure_rfis(commissioning.judged(readings, steps), procedures, 7).select("rfi_id", "subject", "priority", "discipline")


@query("select 'NCR-' || case when max(doc_id) + 1 >= 1000 then cast(max(doc_id) + 1 as varchar) else lpad(cast(max(doc_id) + 1 as varchar), 4, '0') end as next_id from documents")
def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = load(spark, sf_dir, "documents").select(F.concat(F.lit("NCR-"), F.col("doc_id").cast("string")).alias("id"))
    return ids.agg(ncr.highest_number(F.col("id")).alias("last")).select(scalars.next_id(F.col("last"), "NCR").alias("next_id"))


# Field reports


def _report_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("agent") == "signup", "raise").when(F.col("agent") == "purchase", "disposition").when(F.col("agent") == "error", "close")
    return event_log(spark, sf_dir).select(F.col("entity_id").alias("ncr_id"), "seq", action.alias("action")).where("action is not null")


_FOLD = """log as (select cast(user_id as varchar) as id, event_id as seq, case event_type when 'signup' then 'R' when 'purchase' then 'D' when 'error' then 'C' end as a from events where event_type in ('signup', 'purchase', 'error')),
seqd as (select id, a, row_number() over (partition by id order by seq) as n from log),
walk as (
  select id, cast(0 as bigint) as n, '' as st, 0 as refused from (select distinct id from log)
  union all
  select w.id, s.n, case when s.a = 'R' and w.st = '' then 'OPEN' when s.a = 'D' and w.st = 'OPEN' then 'DISPOSITIONED' when s.a = 'C' and w.st = 'DISPOSITIONED' then 'CLOSED' else w.st end,
    w.refused + case when (s.a = 'R' and w.st = '') or (s.a = 'D' and w.st = 'OPEN') or (s.a = 'C' and w.st = 'DISPOSITIONED') then 0 else 1 end
  from walk w join seqd s on s.id = w.id and s.n = w.n + 1
), states as (select id, st as status, n as n_actions, refused as n_refused from walk qualify row_number() over (partition by id order by n desc) = 1)"""


@query(f"with recursive {_FOLD} select id as ncr_id, status, cast(n_actions as integer) as n_actions, n_refused from states")
def ncr_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ncr.states(_report_log(spark, sf_dir))


@query(
    f"""with {EVENT_LOG}, open_r as (select entity_id as tag, max(case severity when 'CRITICAL' then 0.9::double when 'HIGH' then 0.7::double else 0.4::double end) as worst from ev where agent = 'error' and severity <> 'LOW' and seq % 3 <> 0 group by 1)
    select distinct e.entity_id as tag, coalesce(worst, 0.1::double) as field_risk from ev e left join open_r on tag = e.entity_id"""
)
def field_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    severity = F.when(F.col("severity") == "CRITICAL", "CRITICAL").when(F.col("severity") == "HIGH", "MAJOR").otherwise("MINOR")
    reports = log.where("agent = 'error' and severity <> 'LOW'").select(F.col("entity_id").alias("equipment_tag"), severity.alias("severity"), F.when(F.col("seq") % 3 == 0, "closed").otherwise("OPEN").alias("status"))
    return ncr.field_risk(reports, log.select(F.col("entity_id").alias("tag")))


@query(
    f"""with recursive {_FOLD}, r as (select id, 'T' || (cast(id as bigint) % 10) as tag, case cast(id as bigint) % 3 when 0 then 'CRITICAL' when 1 then 'MAJOR' else 'MINOR' end as severity, case when status = '' then 'OPEN' else status end as status from states),
    live as (select * from r where status <> 'CLOSED'), risk as (select tag, max(case severity when 'CRITICAL' then 0.9::double when 'MAJOR' then 0.7::double else 0.4::double end) as worst, count(*) as n from live group by 1)
    select t.tag, coalesce(worst, 0.1::double) as field_risk, coalesce(n, 0) as n_impacts, (select count(*) from live) + 12 as n_nodes from (select 'T' || i as tag from range(12) x(i)) t left join risk using (tag)"""
)
def ncr_in_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _report_log(spark, sf_dir)
    number = F.col("ncr_id").cast("long")
    severity = F.when(number % 3 == 0, "CRITICAL").when(number % 3 == 1, "MAJOR").otherwise("MINOR")
    reports = log.select("ncr_id").distinct().select("ncr_id", F.concat(F.lit("T"), number % 10).alias("equipment_tag"), severity.alias("severity"), F.lit("OPEN").alias("status"))
    tags = spark.range(12).select(F.concat(F.lit("T"), "id").alias("node_id"), F.lit("Equipment").alias("node_type"))
    _, nodes, edges, risks = ncr.in_step(reports, log, tags, tags.select(F.col("node_id").alias("tag")))
    impacts = edges.groupBy(F.col("dst").alias("tag")).agg(F.count("*").alias("n_impacts"))
    return risks.join(impacts, "tag", "left").fillna(0, ["n_impacts"]).join(nodes.agg(F.count("*").alias("n_nodes")))  # one row beside


# Days and schedules


@query(
    """with d as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(o_orderdate as date) as a, cast(l_shipdate as date) as b from lineitem join orders on o_orderkey = l_orderkey),
    i as (select *, date_diff('day', date '1970-01-05', a) as na, date_diff('day', date '1970-01-05', b) as nb from d)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(case when a <= b then (nb // 7) * 5 + least(nb % 7, 5) - (na // 7) * 5 - least(na % 7, 5) else ((nb + 1) // 7) * 5 + least((nb + 1) % 7, 5) - ((na + 1) // 7) * 5 - least((na + 1) % 7, 5) end as bigint) as workdays from i"""
)
def busday_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalars.workdays_between(F.to_date("o_orderdate"), F.to_date("l_shipdate")).alias("workdays"))


@query(
    """with i as (select o_orderkey, date_diff('day', date '1970-01-05', cast(o_orderdate as date)) as n from orders), k as (select o_orderkey, (n // 7) * 5 + least(n % 7, 5) + o_orderkey % 30 as k from i)
    select o_orderkey, strftime(date '1970-01-05' + cast((k // 5) * 7 + k % 5 as integer), '%Y-%m-%d') as day from k"""
)
def busday_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", scalars.workday_offset(F.to_date("o_orderdate"), F.col("o_orderkey") % 30).cast("string").alias("day"))



def _data_date():
    return F.lit("2026-07-20").cast("date")


def _split_code():
    parts = F.split("task_code", "-")
    return [F.substring(parts[0], 2, 20).cast("long").alias("conv_id"), parts[1].cast("long").alias("turn")]


@query(f"with recursive {FORWARD} select conv_id, turn, turn as wave from passed")
def topo_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    activities, links = turns(spark, sf_dir)
    return schedule.waves(activities, links).select(*_split_code(), F.col("wave").cast("long").alias("wave"))


@query(f"with recursive {FORWARD} select conv_id, turn, start, finish from passed")
def cpm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    activities, links = turns(spark, sf_dir)
    return schedule.forward_pass(activities, links, _data_date()).select(*_split_code(), "start", "finish")


@query(
    """with recursive act as (select conv_id, turn, cast(length(text) % 10 as double) as d, case when turn = 0 then 'C' when turn = 1 and conv_id % 3 = 0 then 'A' else 'N' end as st from conversations),
    walk as (
      select conv_id, turn, d, -10::double as s, -5::double as f, null::double as f1, null::bigint as driver from act where turn = 0
      union all select a.conv_id, a.turn, a.d, case when a.st = 'A' then -3 else greatest(0, w.f, coalesce(w.f1 + 1 - a.d, 0)) end, case when a.st = 'A' then a.d else greatest(0, w.f, coalesce(w.f1 + 1 - a.d, 0)) + a.d end, w.f,
        case when a.st = 'N' and greatest(w.f, coalesce(w.f1 + 1 - a.d, w.f)) > 0 then case when w.f >= coalesce(w.f1 + 1 - a.d, w.f) then w.turn else w.turn - 1 end end
      from walk w join act a on a.conv_id = w.conv_id and a.turn = w.turn + 1
    ) select conv_id, turn, s as start, f as finish, driver from walk"""
)
def cpm_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Finished and active turns with actual dates; turn n follows n-1 (FS) and ends a day after n-2 does (FF).
    activities, links = turns(spark, sf_dir)
    done, active = F.col("turn") == 0, (F.col("turn") == 1) & (F.col("conv_id") % 3 == 0)
    day = lambda text: F.lit(text).cast("date")
    activities = activities.withColumns(
        {"status": F.when(done, "TK_Complete").when(active, "TK_Active").otherwise("TK_NotStart"), "actual_start": F.when(done, day("2026-07-06")).when(active, day("2026-07-15")), "actual_end": F.when(done, day("2026-07-13"))}
    )
    ss = F.col("link") == "SS"
    links = links.withColumns({"link": F.when(ss, "FF").otherwise(F.col("link")), "lag_days": F.when(ss, 1.0).otherwise(F.col("lag_days"))})
    passed = schedule.forward_pass(activities, links, _data_date())
    return passed.select(*_split_code(), "start", "finish", F.split("driver", "-")[1].cast("long").alias("driver"))


_DRIVERS = f"""{FORWARD}, cand as (
  select a.conv_id, a.turn, p.turn as who, case when a.turn - p.turn = 1 then p.finish else p.start + 3 end as cand, case when a.turn - p.turn = 1 then 0 else 1 end as kind
  from passed a join passed p on p.conv_id = a.conv_id and a.turn - p.turn in (1, 2)
), drv as (select * from cand where cand > 0 qualify row_number() over (partition by conv_id, turn order by cand desc, kind) = 1),
chain as (
  select conv_id, turn as milestone, turn, 0 as back from (select conv_id, max(turn) as turn from passed group by 1)
  union all select c.conv_id, c.milestone, d.who, c.back + 1 from chain c join drv d on d.conv_id = c.conv_id and d.turn = c.turn)"""


@query(f"with recursive {_DRIVERS} select conv_id, turn, max(back) over (partition by conv_id) - back as pos from chain")
def driving_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    activities, links = turns(spark, sf_dir)
    return _paths(activities, schedule.forward_pass(activities, links, _data_date())).select("conv_id", "turn", "pos")


def _paths(activities: DataFrame, passed: DataFrame) -> DataFrame:
    last = activities.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(F.concat(F.lit("C"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("milestone"))
    path = schedule.driving_path(passed, last.withColumnRenamed("milestone", "task_code"))
    return path.select("milestone", "task_code", *_split_code(), "pos")


@query(f"with recursive {FORWARD} select conv_id, turn, finish - 5 * turn as slip from passed")
def slip_workdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    activities, links = turns(spark, sf_dir)
    return schedule.slips(schedule.forward_pass(activities, links, _data_date()), activities, _data_date()).select(*_split_code(), "slip")


@query(
    f"""with recursive {_DRIVERS}, pos as (select conv_id, turn, max(back) over (partition by conv_id) - back as pos from chain), s as (select p.conv_id, p.turn, pos, finish - 5 * p.turn as slip from pos p join passed using (conv_id, turn))
    select conv_id, turn as origin, slip from s qualify row_number() over (partition by conv_id order by slip > 0 desc, pos) = 1"""
)
def slip_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    activities, links = turns(spark, sf_dir)
    passed = schedule.forward_pass(activities, links, _data_date())
    slipped = schedule.slips(passed, activities, _data_date())
    found = schedule.slip_origin(_paths(activities, passed), slipped).withColumnRenamed("origin", "task_code")
    return found.select(*_split_code(), "slip").withColumnRenamed("turn", "origin")


# Every conversation as a schedule, with durations from its texts; a turn's draws follow from its name and the trial.
_TRIALS = """act as (
  select conv_id, turn, cast(length(text) % 10 + 1 as double) as d, 'C' || conv_id || '-' || turn as code from conversations
), keyed as (
  select *, md5('42|' || conv_id || '|' || code) as h from act
), drawn as (
  select conv_id, turn, trial, d, 0.9 * d as low, 1.2::double * d as high,
    (((1 + ('0x' || h[1:8])::bigint % 2147483646) * trial + ('0x' || h[9:16])::bigint % 2147483647) % 2147483647 + 0.5::double) / 2147483647 as u from keyed, range({0}) t(trial)
), spread as (
  select conv_id, turn, trial, d, greatest(d - 0.1::double * d, 0.5::double * d) as low, d + 2 * (0.1::double * d) as high, u from drawn
), took as (
  select conv_id, turn, trial, case when u * (high - low) < d - low then low + sqrt(u * (high - low) * (d - low)) else high - sqrt((1 - u) * (high - low) * (high - d)) end as x from spread
), walk as (
  select conv_id, trial, 0::bigint as turn, 0::double as s, x as f, null::double as s2 from took where turn = 0
  union all select w.conv_id, w.trial, w.turn + 1, greatest(0, w.f, coalesce(w.s2 + 3, 0)), greatest(0, w.f, coalesce(w.s2 + 3, 0)) + t.x, w.s from walk w join took t on t.conv_id = w.conv_id and t.trial = w.trial and t.turn = w.turn + 1
), fin as (select conv_id, trial, f as finish from walk qualify row_number() over (partition by conv_id, trial order by turn desc) = 1)"""


def _simulated(spark: SparkSession, sf_dir: str, trials: int) -> DataFrame:
    activities, links = turns(spark, sf_dir)
    work = activities.withColumns({"original_duration_days": F.col("duration") + 1, "early_end": F.lit(None).cast("date")})
    last = work.groupBy("conv_id").agg(F.max_by("task_code", "turn").alias("milestone"))
    return schedule.simulate_each(work, links, _data_date(), last, "conv_id", trials=trials)


@query(f"with recursive {_TRIALS.format(50)} select conv_id, trial, round(finish, 6) as finish from fin")
def mc_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simulated(spark, sf_dir, 50).select(F.col("schedule").alias("conv_id"), "trial", F.round("finish", 6).alias("finish"))


@query(
    f"""with recursive {_TRIALS.format(400)}, p as (
      select conv_id, quantile_cont(finish, 0.5) as p50, quantile_cont(finish, 0.8) as p80, quantile_cont(finish, 0.9) as p90, round(avg(cast(finish > 23 as integer)), 3) as breach from fin group by 1
    ), k as (select *, 5 * date_diff('week', date '1970-01-05', date '2026-07-20') as base from p)
    select conv_id, round(p50, 6) as p50, round(p80, 6) as p80, round(p90, 6) as p90, breach,
      {", ".join(f"strftime(date '1970-01-05' + cast(((base + trunc(p{q})::bigint) // 5) * 7 + (base + trunc(p{q})::bigint) % 5 as integer), '%Y-%m-%d') as p{q}_date" for q in (50, 80, 90))} from k"""
)
def mc_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = schedule.simulation_summary(_simulated(spark, sf_dir, 400), _data_date(), F.lit("2026-08-20").cast("date"), by="schedule")
    return told.select(F.col("schedule").alias("conv_id"), *(F.round(f"p{q}", 6).alias(f"p{q}") for q in (50, 80, 90)), "breach", *(F.col(f"p{q}_date").cast("string").alias(f"p{q}_date") for q in (50, 80, 90)))


@query("select quantile_cont(l_extendedprice, 0.5) as p50, quantile_cont(l_extendedprice, 0.8) as p80, quantile_cont(l_extendedprice, 0.9) as p90, round(avg(cast(l_extendedprice > 50000 as integer)), 3) as breach from lineitem")
def percentiles_and_exceedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.summarised(load(spark, sf_dir, "lineitem"), "l_extendedprice", F.lit(50000), {"p50": 0.5, "p80": 0.8, "p90": 0.9})


@query(
    """select l_returnflag, l_suppkey, quantile_cont(l_quantity, 0.05) as p5, quantile_cont(l_quantity, 0.5) as p50, quantile_cont(l_quantity, 0.95) as p95, round(avg(cast(l_quantity > 40 as integer)), 3) as breach
    from lineitem group by 1, 2"""
)
def percentiles_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_quantity")
    return quantiles.summarised(rows, "l_quantity", F.lit(40), {"p5": 0.05, "p50": 0.5, "p95": 0.95}, ["l_returnflag", "l_suppkey"])


# Rules


@query("select o_orderkey, (o_orderkey % 60 - 20) * 50000.0::double as exposure from orders")
def sla_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", rules.exposure(F.col("o_orderkey") % 60 - 20).alias("exposure"))


@query(f"with {EVENT_LOG} select case when risk_score >= 0.8 then 'critical' when risk_score >= 0.6 then 'high' when risk_score >= 0.3 then 'medium' else 'low' end as band, count(*) as n from ev group by 1")
def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).groupBy(rules.risk_band(F.col("risk_score")).alias("band")).agg(F.count("*").alias("n"))


@query(
    """select o_orderkey, round(least(1.0::double, 0.4 + 0.6 * ((o_orderkey % 101) / 100.0::double)), 6) as milestone, case when (o_orderkey % 101) / 100.0::double > 0.5 then 'CRITICAL' else 'HIGH' end as severity,
      round(least(1.0::double, 0.3 + (o_orderkey % 50) / 30.0::double * 0.5), 6) as slip, case when o_orderkey % 50 >= 10 then 'HIGH' else 'MEDIUM' end as slip_severity from orders"""
)
def milestone_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    breach, slip = (F.col("o_orderkey") % 101) / F.lit(100.0), F.col("o_orderkey") % 50
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(rules.milestone_risk(breach), 6).alias("milestone"), rules.milestone_severity(breach).alias("severity"), F.round(rules.slip_risk(slip), 6).alias("slip"), rules.slip_severity(slip).alias("slip_severity")
    )


# Retrieval


@query("with q as (select embedding as q from embeddings where vec_id = 7) select vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), 9) as distance from embeddings, q order by distance, vec_id limit 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 7").select(F.col("embedding").alias("query"))
    return retrieval.nearest_vectors(vectors, asked).select("vec_id", F.round("distance", 9).alias("distance"))


@query(
    """with d as (select doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), lambda w: w not in ('the', 'for', 'ups', 'what', 'spec')) as w from documents),
    q as (select list_distinct(regexp_extract_all(lower((select text from benchmark where item_id = 3)), '[a-z]+')) as q) select doc_id, cast(len(list_intersect(w, q)) as integer) as shared from d, q where len(list_intersect(w, q)) > 0"""
)
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    question = load(spark, sf_dir, "benchmark").where("item_id = 3").select("text").first()["text"]
    return retrieval.sharing_words(load(spark, sf_dir, "documents"), F.col("text"), F.lit(question)).select("doc_id", "shared")


_QUESTIONS = """qs as (select p_partkey, case p_partkey % 8 when 0 then 'Which RFI is on the critical path?' when 1 then 'Any open ncr on site ' || p_name when 2 then 'Status of UPS-' || lpad(cast(p_size as varchar), 2, '0') || 'A' when 3 then 'Where is the lead time for ' || p_name
  when 4 then 'What does the clause require for autonomy' when 5 then 'Tell me about ' || p_name when 6 then 'Deliver the spec details' else 'submittal deviation and eta' end as question from part)"""


@query(
    f"""with {_QUESTIONS}, l as (select *, lower(question) as q from qs), f as (select *, case when contains(q, 'rfi') and (contains(q, 'critical') or contains(q, 'path')) then 'open_rfis_on_critical_path' when contains(q, 'ncr') or contains(q, 'non-conformance') or contains(q, 'nonconformance') then 'open_ncrs'
      when regexp_matches(question, '\\b[A-Z]{{2,4}}-\\d{{2}}[A-Z]\\b|\\b(?:UPS|GEN|SWG|ATS|CH|CRAH|PDU)-\\d{{2}}[A-Z]?\\b') or contains(q, 'status') or contains(q, 'submittal') or contains(q, 'deviation') then 'equipment_status' end as first,
      contains(q, 'deliver') or contains(q, 'eta') or contains(q, 'supply') or contains(q, 'lead time') as del, contains(q, 'spec') or contains(q, 'requirement') or contains(q, 'clause') or contains(q, 'shall') or contains(q, 'autonomy') or contains(q, 'require') as spec from l)
    select p_partkey, coalesce(first, case when del then 'deliveries_at_risk' end, case when spec then 'spec_requirement' end, 'general') as intent, concat_ws(',', first, case when del then 'deliveries_at_risk' end, case when spec then 'spec_requirement' end) as branches from f"""
)
def intent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey") % 8, F.col("p_name")
    question = (
        F.when(k == 0, F.lit("Which RFI is on the critical path?")).when(k == 1, F.concat(F.lit("Any open ncr on site "), name)).when(k == 2, F.concat(F.lit("Status of UPS-"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("A")))
        .when(k == 3, F.concat(F.lit("Where is the lead time for "), name)).when(k == 4, F.lit("What does the clause require for autonomy")).when(k == 5, F.concat(F.lit("Tell me about "), name)).when(k == 6, F.lit("Deliver the spec details")).otherwise(F.lit("submittal deviation and eta"))
    )
    rows = load(spark, sf_dir, "part").select("p_partkey", question.alias("question"))
    return retrieval.routed(rows).select("p_partkey", "intent", F.array_join("branches", ",").alias("branches"))


@query("select p_partkey as id, case when p_partkey % 5 = 0 then 'new' else 'old' end as state from part union all select 1000000 + r_regionkey, 'new' from region")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As in ``retrieval.corpus``, an id says what it is of: a region whose number is also a part's replaces no part.
    of = lambda kind, number: (F.concat_ws("::", F.lit(kind), number.cast("string")).alias("key"), number.cast("long").alias("id"))
    part = load(spark, sf_dir, "part")
    stored = part.select(*of("part", F.col("p_partkey")), F.lit("old").alias("state"), F.lit(0).cast("long").alias("seq"))
    changed = part.where("p_partkey % 5 = 0").select(*of("part", F.col("p_partkey")), F.explode(F.array(F.lit("older"), F.lit("new"))).alias("state")).withColumn("seq", F.when(F.col("state") == "new", 2).otherwise(1).cast("long"))
    added = load(spark, sf_dir, "region").select(*of("region", F.col("r_regionkey") + 1000000), F.lit("new").alias("state"), F.lit(1).cast("long").alias("seq"))
    return retrieval.upserted(stored, changed.union(added), key="key").select("id", "state")


# Dashboard and documents


@query(
    """select (select count(*) from part where p_type = 'STANDARD' and p_retailprice / 2000 > 0.5) as equipment_at_risk, (select count(*) from part where p_type = 'SMALL') as open_deviations, (select count(*) from part where p_type = 'MEDIUM' and p_size < 25) as open_rfis,
      (select count(*) from part where p_type = 'LARGE' and p_size < 25) as open_ncrs, (select count(*) from region) as n_alerts, (select count(*) from events) as n_events, round((select count(*) from part where p_type = 'PROMO') * 5.5 + (select count(*) from part where p_type = 'MEDIUM') * 0.75 + (select count(*) from part where p_type = 'ECONOMY') * 2.5, 1)::double as hours_saved"""
)
def dashboard_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = rules.by_value(F.col("p_type"), {"STANDARD": "Equipment", "SMALL": "Deviation", "MEDIUM": "RFI", "LARGE": "NCR", "PROMO": "Submittal", "ECONOMY": "ITPRecord"})
    nodes = load(spark, sf_dir, "part").select(kind.alias("node_type"), F.when(F.col("p_size") < 25, "Open").otherwise("CLOSED").alias("status"), (F.col("p_retailprice") / 2000).alias("risk_score"))
    return dashboard.counters(nodes, load(spark, sf_dir, "region"), load(spark, sf_dir, "events")).drop("n_submittals", "n_rfis", "n_itps")


@query(
    f"""with {_SCORES}, {_GRAPH}, firsts as (select s.entity_id, min(s.seq) as first_seen from sig s where rn = 1 group by 1)
    select 'metrics' as section, 1 as place, null as id union all select * from (select 'equipment', (row_number() over (order by risk desc, tag))::int as p, tag from eq) where p <= 25
    union all select * from (select 'deviations', (row_number() over (order by id))::int as p, id from dev) where p <= 25 union all select 'milestone', 1, 'M0'
    union all select * from (select 'critical_path', (row_number() over (order by cast(o_orderdate as date), 'A' || o_orderkey))::int as p, 'A' || o_orderkey from orders where o_orderpriority = '1-URGENT') where p <= 25
    union all select * from (select 'alerts', (row_number() over (order by score desc, first_seen))::int as p, k.entity_id from kept k join firsts using (entity_id)) where p <= 25
    union all select * from (select 'recent_events', (row_number() over (order by seq desc))::int as p, seq::varchar from ev) where p <= 25"""
)
def dashboard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _graph(spark, sf_dir)[0].withColumn("status", F.col("attributes")["status"])
    activities = load(spark, sf_dir, "orders").select(F.concat(F.lit("A"), "o_orderkey").alias("task_code"), F.to_date("o_orderdate").alias("early_start"), (F.col("o_orderpriority") == "1-URGENT").alias("is_critical"))
    milestones = load(spark, sf_dir, "region").select(F.concat(F.lit("M"), "r_regionkey").alias("node_id"), F.col("r_regionkey").cast("double").alias("p90"))
    log = event_log(spark, sf_dir)
    alerted = convergence.convergence_scores(log, critical_entities(spark, sf_dir))
    return dashboard.report(nodes, activities, milestones, alerted, log).select("section", "place", "id")


@query("select c_nationkey, round(count(*) * 5.5 + count(*) filter (where c_acctbal > 0) * 0.75 + count(*) filter (where c_acctbal < 0) * 2.5, 1)::double as hours from customer group by 1")
def hours_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("a"), F.count_if(F.col("c_acctbal") > 0).alias("b"), F.count_if(F.col("c_acctbal") < 0).alias("c"))
    return counts.select("c_nationkey", rules.hours_saved(F.col("a"), F.col("b"), F.col("c")).alias("hours"))


@query(
    """with v as (select substr(sha256(text), 1, 12) as version_id, min(doc_id) as first_doc, count(*) as n from documents where text is not null group by 1) select version_id, first_doc, first_doc = 3 as live, first_doc <> 3 as deletable from v"""
)
def content_hash_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.timestamp_seconds("doc_id").alias("ts"))
    hashed = docs.withColumn("version_id", scalars.content_id(F.col("text")))
    versions = documents.retained(docs, "text").select("version_id", F.col("ts").alias("kept_at"))
    log = hashed.select("version_id", "ts", F.lit("user").alias("uploaded_by"), F.col("doc_id").cast("string").alias("original_name"))
    live = hashed.where("doc_id = 3").select("version_id").first()["version_id"]
    listed = documents.version_listing(versions, log, F.lit(live))
    return listed.select("version_id", F.col("original_name").cast("long").alias("first_doc"), "live", "deletable")


@query(
    """with p as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as page from documents where text is not null),
    c as (select doc_id, page, line from p where length(line) > 0), n as (select doc_id, list(length(line) order by page) as ls, list(page order by page) as ps from c group by 1)
    select doc_id, cast(len(ls) as integer) as n_pages, cast(list_sum(ls) as bigint) as chars from n"""
)
def page_chunks_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    chunks = documents.page_chunks(pages, 500)
    sizes = pages.where(F.length("text") > 0).groupBy("doc_id").agg(F.count("*").cast("int").alias("n_pages"))
    return chunks.groupBy("doc_id").agg(F.sum("chars").alias("chars")).join(sizes, "doc_id").select("doc_id", "n_pages", "chars")


@query(
    """with recursive l as (select doc_id, unnest(string_split(text, chr(10))) as line, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as integer) as page from documents where text is not null),
    p as (select doc_id, page, cast(length(line) as integer) as n, row_number() over (partition by doc_id order by page) as rn from l where length(line) > 0),
    w as (
      select doc_id, rn, page, 0 as chunk, page as first_page, n as chars from p where rn = 1
      union all select p.doc_id, p.rn, p.page, w.chunk + (w.chars + p.n > 6000)::integer, case when w.chars + p.n > 6000 then p.page else w.first_page end, case when w.chars + p.n > 6000 then p.n else w.chars + p.n end from w join p on p.doc_id = w.doc_id and p.rn = w.rn + 1
    ) select doc_id, chunk, first_page, max(page) as last_page, max(chars) as chars from w group by 1, 2, 3"""
)
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return documents.page_chunks(pages)


@query(
    """with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
    h as (select doc_id, pos, 'CL-' || (doc_id % 20) || '.' || (pos % 3) as clause_id from l), f as (select * from h qualify row_number() over (partition by clause_id order by doc_id, pos) = 1),
    n as (select doc_id, len(string_split(text, chr(10))) as n from documents where text is not null)
    select clause_id, doc_id as page, trim(array_to_string(list_transform(range(pos, least(pos + 2, n) + 1), lambda p: 'CL-' || (doc_id % 20) || '.' || (p % 3) || ' at ' || p || ' '), ' '))[1:400] as source_text from f join n using (doc_id)"""
)
def clause_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each line is led by the clause id that it stands for.
    lines = load(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("page"), F.split("text", "\n").alias("ls"))
    id_ = lambda i: F.concat(F.lit("CL-"), (F.col("page") % 20).cast("string"), F.lit("."), ((i + 1) % 3).cast("string"))
    pages = lines.select("page", F.array_join(F.transform("ls", lambda x, i: F.concat(id_(i), F.lit(" at "), (i + 1).cast("string"), F.lit(" "))), "\n").alias("text"))
    clauses = spark.range(60).select(F.concat(F.lit("CL-"), F.expr("cast(id div 3 as string)"), F.lit("."), (F.col("id") % 3).cast("string")).alias("clause_id"))
    found = documents.clause_texts(clauses, pages)
    return found.select("clause_id", "page", "source_text")


@query("select p_partkey, case when p_size < 10 then 'reference only' when p_size < 20 then 'on file' when p_size < 30 then 'not parsed yet' when p_partkey % 2 = 1 then case when p_size < 40 then 'changed: derived again on the next run' else 'changed: rebuild to parse again' end else 'parsed' end as status from part")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    parsed = F.when(size >= 30, F.lit(100))
    status = rules.parse_status(size >= 10, size >= 20, F.lit(100) + F.col("p_partkey") % 2, parsed, size < 40)
    return load(spark, sf_dir, "part").select("p_partkey", status.alias("status"))


@query("select source as name, count(*) as n, string_agg(doc_id, ',' order by doc_id desc) as history from documents group by 1")
def upload_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.timestamp_seconds("doc_id").alias("ts"), F.lit("u").alias("uploaded_by"), F.col("doc_id").cast("string").alias("version_id"))
    listed = documents.upload_histories(docs.select("name").distinct(), docs)
    return listed.select("name", F.size("history").cast("long").alias("n"), F.array_join(F.transform("history", lambda h: h["version_id"]), ",").alias("history"))


@query("select o_orderkey, strftime(cast(o_orderdate as date), '%Y-%m-%d') as bar_start, greatest(0, o_orderkey % 20 - 5)::integer as slip_days from orders")
def gantt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    none = F.lit(None).cast("date")
    rows = load(spark, sf_dir, "orders").select("o_orderkey", none.alias("actual_start"), day.alias("early_start"), none.alias("target_start"), none.alias("actual_end"), F.date_add(day, (F.col("o_orderkey") % 20).cast("int")).alias("early_end"), F.date_add(day, 5).alias("target_end"))
    return dashboard.gantt_rows(rows).select("o_orderkey", F.col("bar_start").cast("string").alias("bar_start"), F.col("slip_days").cast("int").alias("slip_days"))


# Listings and state


@query(f"with {EVENT_LOG} select seq, agent, entity_id, count(*) over () as n_total from ev where agent = 'error' order by seq desc limit 100")
def events_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.page(event_log(spark, sf_dir), agent="error").select("seq", "agent", "entity_id", "n_total")


@query(f"with {EVENT_LOG} select count(*) as n_removed from ev where agent = 'error' and severity = 'LOW'")
def removed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.removed_count(event_log(spark, sf_dir), agent="error", severity="LOW")


@query(
    f"""with {_READINGS}, s as (select distinct conv_id as session_id from conversations), d as (select session_id, count(*) as n_done, count(*) filter (where result = 'FAIL') as n_failed from res group by 1),
    j as (select s.session_id, coalesce(n_done, 0) as n_done, coalesce(n_failed, 0) as n_failed from s left join d using (session_id))
    select session_id, n_done, n_failed, least(n_done + 1, 8) as current_step, n_failed > 0 as sign_off_blocked,
      case when session_id % 3 = 0 then case when n_done >= 8 and n_failed = 0 then 'passed' else 'failed' end when n_done >= 8 then 'steps_complete' else 'in_progress' end as state from j"""
)
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, steps, _ = _session(spark, sf_dir)
    completed = F.when(F.col("session_id") % 3 == 0, F.timestamp_seconds("session_id"))
    sessions = readings.select("session_id", "procedure_id").distinct().withColumn("completed_at", completed)
    return commissioning.session_states(sessions, commissioning.judged(readings, steps), steps).drop("procedure_id")


@query(f"with {EVENT_LOG} select seq, 'N' || seq as ncr_id, count(*) filter (where agent <> 'error') over () as n_open from ev where severity = 'CRITICAL'")
def ncr_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = event_log(spark, sf_dir).where("severity = 'CRITICAL'").select("seq", F.concat(F.lit("N"), "seq").alias("ncr_id"), F.when(F.col("agent") == "error", "CLOSED").otherwise("OPEN").alias("status"))
    return ncr.listing(reports).select("seq", "ncr_id", "n_open")


@query("select doc_id, coalesce(substr(text, 1, 90), '') as title, '' as spec_clause, 'MAJOR' as severity from documents")
def ncr_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ncr.drafted(load(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "title", "spec_clause", "severity")


@query(
    """with d as (select distinct 'P' || p_partkey as tag, 'CL-' || p_size as clause from part where p_size % 5 = 0), e as (select distinct 'P' || l_partkey as tag, 'O' || l_orderkey as act, 'SPEC::CL-' || (l_linenumber * 5) || '0::x' as spec from lineitem)
    select distinct 'DEV::' || d.tag || '::' || clause || '::x' as src, spec as dst, 'DEVIATES_FROM' as relationship from d join e using (tag) where contains(spec, clause)
    union select distinct 'DEV::' || d.tag || '::' || clause || '::x', act, 'IMPACTS' from d join e using (tag)"""
)
def deviation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, lines = load(spark, sf_dir, "part"), load(spark, sf_dir, "lineitem")
    tag = F.concat(F.lit("P"), "l_partkey")
    found = part.where("p_size % 5 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("equipment_tag"), F.concat(F.lit("CL-"), "p_size").alias("clause_id"), F.lit("x").alias("parameter"))
    specified = lines.select(tag.alias("src"), F.concat(F.lit("SPEC::CL-"), F.col("l_linenumber") * 5, F.lit("0::x")).alias("dst"), F.lit("SPECIFIED_BY").alias("relationship"))
    required = lines.select(F.concat(F.lit("O"), "l_orderkey").alias("src"), tag.alias("dst"), F.lit("REQUIRES").alias("relationship"))
    return graph.deviation_graph(found, specified.union(required))[1]


@query("select (select count(*) from part) as n_nodes, (select count(*) from lineitem) as n_edges, (select count(*) from embeddings) as n_vectors")
def graph_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sizes(*(load(spark, sf_dir, t) for t in ("part", "lineitem", "embeddings")))


@query("with a as (select sha256(text) as h, min(lang) as revision from documents where text is not null and source is not null group by 1) select doc_id, coalesce(a.revision, 'unknown') as revision from documents left join a on sha256(text) = h")
def active_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.col("text").alias("content"))
    assets = docs.where("text is not null and source is not null").select(F.col("lang").alias("revision"), F.col("text").alias("content"))
    return documents.active_revision(files, assets).select("doc_id", "revision")


@query("select distinct sha256(text)[1:12] as version_id from documents where text is not null")
def seeds_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = documents.retained(load(spark, sf_dir, "documents").where("text is not null").select("text", "lang"), "text").select("version_id", "lang")
    kept = versions.where("lang <> 'en'")
    return documents.with_seeds(kept, versions).select("version_id")


@query(
    """select 'N' || o_orderkey as id, case when l_suppkey is not null then 'N' || o_orderkey || ' -IMPACTS-> S' || l_suppkey end as path
    from orders left join (select distinct l_orderkey, l_suppkey from lineitem) on l_orderkey = o_orderkey where upper(o_orderstatus) <> 'F'"""
)
def open_ncrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(F.lit("status"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise(F.col("o_orderstatus")))
    nodes = load(spark, sf_dir, "orders").select(F.concat(F.lit("N"), "o_orderkey").alias("node_id"), F.lit("NCR").alias("node_type"), status.alias("attributes"), F.lit(0.5).alias("risk_score"))
    edges = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("N"), "l_orderkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"), F.lit("IMPACTS").alias("relationship")).distinct()
    return questions.field_reports(nodes, edges).select("id", "path")
