"""Answers from the graph: facts as rows (a kind, an id and a JSON text) and the paths that lead to them.

``nodes`` (node_id, node_type, attributes map, risk_score) and ``edges`` (src,
dst, relationship). Bundles are unions of typed branches, so each branch reads
what it needs and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import at_risk

_ATTRIBUTE = lambda name: F.col("attributes")[name]


def _fact(rows: DataFrame, kind: str, id_: Column, path: Column, *columns: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), id_.alias("id"), F.to_json(F.struct(*columns)).alias("fact"), path.alias("path"))


def equipment_status(nodes: DataFrame, edges: DataFrame, tag: str) -> DataFrame:
    """Of one tag: itself, its deviations, the activities that need it, its vendor and its field reports."""
    own = nodes.where(F.col("node_id") == tag)
    far = lambda column: nodes.withColumnRenamed("node_id", column)
    into = edges.where(F.col("dst") == tag).join(far("src"), "src")
    out = edges.where((F.col("src") == tag) & (F.col("relationship") == "PROCURED_FROM")).join(far("dst"), "dst")
    arrow = lambda: F.concat_ws("", "src", F.lit(" -"), "relationship", F.lit("-> "), "dst")
    deviations = nodes.where((F.col("node_type") == "Deviation") & (F.element_at(F.split("node_id", "::"), 2) == tag))
    branches = [
        _fact(own, "equipment", F.col("node_id"), F.lit(None).cast("string"), _ATTRIBUTE("vendor").alias("vendor"), _ATTRIBUTE("model").alias("model"), "risk_score"),
        _fact(deviations, "deviation", F.col("node_id"), F.concat(F.lit(f"{tag} <-derived- "), "node_id"), "attributes"),
        _fact(into.where("relationship = 'REQUIRES'"), "activity", F.col("src"), arrow(), _ATTRIBUTE("name").alias("name"), _ATTRIBUTE("status").alias("status"), _ATTRIBUTE("early_end").alias("early_end"), _ATTRIBUTE("is_critical").alias("is_critical")),
        _fact(out, "vendor", F.col("dst"), arrow(), "attributes"),
        _fact(into.where("relationship = 'IMPACTS' and node_type = 'NCR'"), "ncr", F.col("src"), arrow(), _ATTRIBUTE("title").alias("title"), _ATTRIBUTE("severity").alias("severity"), _ATTRIBUTE("status").alias("status")),
    ]
    every = branches[0]
    for more in branches[1:]:
        every = every.unionByName(more)
    return every


def field_reports(nodes: DataFrame, edges: DataFrame, include_closed: bool = False) -> DataFrame:
    """Field reports with the paths to what they impact."""
    reports = nodes.where("node_type = 'NCR'")
    if not include_closed:
        reports = reports.where(F.upper(F.coalesce(_ATTRIBUTE("status"), F.lit(""))) != "CLOSED")
    impacts = edges.where("relationship = 'IMPACTS'").select(F.col("src").alias("node_id"), F.concat_ws("", "src", F.lit(" -IMPACTS-> "), "dst").alias("path"))
    return _fact(reports.join(impacts, "node_id", "left"), "ncr", F.col("node_id"), F.col("path"), "attributes")


def deliveries_at_risk(nodes: DataFrame, risks: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Equipment over a risk threshold that the supply agent has judged (``risks`` node_id, agent, score)."""
    judged = risks.where("agent = 'TRACIS'").select("node_id", F.col("score").alias("delivery_risk"))
    found = at_risk(nodes, threshold).join(judged, "node_id")
    return _fact(found, "delivery", F.col("node_id"), F.concat(F.col("node_id"), F.lit(" (risk "), F.col("risk_score").cast("string"), F.lit(") <- TRACIS")), _ATTRIBUTE("vendor").alias("vendor"), "delivery_risk")


def entity_contexts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row an equipment: how many deviations, activities, open RFIs and open reports touch it, and whether it is critical.

    RFIs reach equipment over the activities that need it.
    """
    kinds = nodes.select(F.col("node_id").alias("src"), "node_type", F.lower(F.coalesce(_ATTRIBUTE("status"), F.lit(""))).alias("status"), (F.coalesce(_ATTRIBUTE("is_critical"), F.lit("false")) == "true").alias("critical"))
    into = edges.where("relationship in ('REQUIRES', 'IMPACTS')").join(kinds, "src").select(F.col("dst").alias("entity_id"), "src", "relationship", "node_type", "status", "critical")
    direct = into.groupBy("entity_id").agg(
        F.count_if(F.col("relationship") == "REQUIRES").alias("n_activities"),
        F.count_if((F.col("node_type") == "NCR") & (F.col("status") != "closed")).alias("n_open_ncrs"),
        F.bool_or((F.col("relationship") == "REQUIRES") & F.col("critical")).alias("on_critical_path"),
    )
    open_rfis = edges.where("relationship = 'LINKED_TO'").join(kinds.where("node_type = 'RFI' and status = 'open'").select("src"), "src", "left_semi").select(F.col("src").alias("rfi"), F.col("dst").alias("src"))
    rfis = into.where("relationship = 'REQUIRES'").select("entity_id", "src").join(open_rfis, "src").groupBy("entity_id").agg(F.count_distinct("rfi").alias("n_open_rfis"))
    deviations = nodes.where("node_type = 'Deviation'").groupBy(F.element_at(F.split("node_id", "::"), 2).alias("entity_id")).agg(F.count("*").alias("n_deviations"))
    equipment = nodes.where("node_type = 'Equipment'").select(F.col("node_id").alias("entity_id"))
    joined = equipment.join(direct, "entity_id", "left").join(rfis, "entity_id", "left").join(deviations, "entity_id", "left")
    return joined.fillna(0, ["n_activities", "n_open_ncrs", "n_open_rfis", "n_deviations"]).fillna(False, ["on_critical_path"])


def evidence(facts: DataFrame, most: int = 5) -> DataFrame:
    """One row: the first facts of an answer as text."""
    first = facts.orderBy("kind", "id", "path").limit(most)  # five rows
    entry = F.struct("kind", "id", "path", "fact")
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda f: F.coalesce(f["fact"], F.lit("null"))), ", ").alias("facts")).select(F.concat(F.lit("Graph evidence: ["), "facts", F.lit("]")).alias("answer"))


# Bundles


def _first_few(rows: DataFrame, name: str, most: int, *fields: str) -> DataFrame:
    """``entity_id``, ``n_<name>``, and ``name``: the first ``most`` rows of an entity by id, cut before they are gathered."""
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy("id"))
    few = rows.withColumn("__rank", rank).where(F.col("__rank") <= most)
    by_id = lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    listed = few.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("id", *fields)), by_id).alias(name))
    return listed.join(rows.groupBy("entity_id").agg(F.count("*").alias(f"n_{name}")), "entity_id")


def first_delay(nodes: DataFrame, order: str = "node_id") -> DataFrame:
    """One row or none: the first milestone that a simulation has judged, with its results."""
    judged = nodes.where(F.col("node_type") == "Milestone").where(F.map_contains_key("attributes", "expected_delay_days"))
    result = [_ATTRIBUTE(k).alias(k) for k in ("mc_p50", "mc_p90", "baseline_finish", "expected_delay_days", "sla_breach_risk")]
    return judged.agg(F.min_by(F.struct(F.col("node_id").alias("id"), *result), order).alias("milestone")).where("milestone is not null")


def _reached(edges: DataFrame, relationship: str) -> DataFrame:
    return edges.where(F.col("relationship") == relationship).select(F.col("src").alias("id"), F.col("dst").alias("entity_id")).distinct()


def _told(nodes: DataFrame, kind: str, *names: str) -> DataFrame:
    """``id``, ``status`` in lower case, and attributes of the nodes of a kind."""
    return nodes.where(F.col("node_type") == kind).select(F.col("node_id").alias("id"), F.lower(F.coalesce(_ATTRIBUTE("status"), F.lit(""))).alias("live"), *(_ATTRIBUTE(n).alias(n) for n in names))


def open_rfis(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``entity_id, id, subject`` of the open RFIs that are linked to an activity which needs the entity, each pair once."""
    linked = _told(nodes, "RFI", "subject").where("live = 'open'").join(_reached(edges, "LINKED_TO").withColumnRenamed("entity_id", "activity"), "id")
    needs = _reached(edges, "REQUIRES").withColumnRenamed("id", "activity")
    return needs.join(linked, "activity").select("entity_id", "id", "subject").distinct()


def open_reports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``entity_id, id, title, severity, raised_by`` of the field reports on an entity that are not closed."""
    return _reached(edges, "IMPACTS").join(_told(nodes, "NCR", "title", "severity", "raised_by").where("live <> 'closed'"), "id").select("entity_id", "id", "title", "severity", "raised_by")


def entity_bundles(nodes: DataFrame, edges: DataFrame, entities: DataFrame | None = None, most: int = 20, order: str = "node_id") -> DataFrame:
    """What is known around each entity, as far as an answer or an alert shows it.

    ``entity_id, node_type, attributes`` (without the long list of submitted
    parameters), and of deviations, activities that need it, open RFIs on those
    and open field reports on it the number (``n_...``) and the first ``most``
    by id; ``milestone`` is the first that a simulation has judged (by ``order``),
    the same for all. ``entities`` (entity_id) are all nodes if not given; those
    that the graph does not know have nulls and empty lists. A deviation belongs
    to the entity that its id names.
    """
    known = nodes.select(F.col("node_id").alias("entity_id"), "node_type", F.map_filter("attributes", lambda k, _: k != "submitted_parameters").alias("attributes"))
    entities = known.select("entity_id") if entities is None else entities.select("entity_id").distinct()
    found = nodes.where("node_type = 'Deviation'").select(F.try_element_at(F.split("node_id", "::"), F.lit(2)).alias("entity_id"), F.col("node_id").alias("id"), "attributes")
    deviations = found.where("entity_id is not null")
    about = nodes.select(F.col("node_id").alias("id"), *(_ATTRIBUTE(n).alias(n) for n in ("name", "status", "is_critical")))
    activities = _reached(edges, "REQUIRES").join(about, "id").select("entity_id", "id", "name", "status", "is_critical")
    rfis, reports = open_rfis(nodes, edges), open_reports(nodes, edges)
    bundle = entities.join(known, "entity_id", "left")
    for rows, name, fields in ((deviations, "deviations", ("attributes",)), (activities, "activities", ("name", "status", "is_critical")), (rfis, "open_rfis", ("subject",)), (reports, "open_ncrs", ("title", "severity", "raised_by"))):
        few = _first_few(rows, name, most, *fields)
        bundle = bundle.join(few, "entity_id", "left").withColumns({f"n_{name}": F.coalesce(f"n_{name}", F.lit(0)), name: F.coalesce(name, F.array().cast(few.schema[name].dataType))})
    return bundle.join(first_delay(nodes, order), how="left")  # one row beside
