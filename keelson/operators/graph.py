"""The property graph as two tables: versions of nodes, and edges.

A node's state at a time is its latest version by then (``tx_time``); attributes
merge from version to version, later keys winning. Edges are keyed by source,
target and relationship; of repeated ones the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import tags_in
from ..sources.store import scratch
from .documents import occurring
from .events import first_by
from .segments import HOT_ROWS, with_last, with_next

# Words that tie a clause to the equipment of a tag's prefix.
KEYWORDS = {
    "UPS": ["UPS", "UNINTERRUPTIBLE"],
    "GEN": ["GENERATOR", "GENSET", "STANDBY ENGINE"],
    "CH": ["CHILLER", "CHILLED WATER PLANT"],
    "CHWP": ["CHILLED WATER PUMP"],
    "CRAH": ["CRAH", "COMPUTER ROOM AIR"],
    "SWG": ["SWITCHGEAR"],
    "ATS": ["AUTOMATIC TRANSFER SWITCH", "TRANSFER SWITCH"],
    "PDU": ["PDU", "POWER DISTRIBUTION UNIT"],
    "BATT": ["BATTERY"],
}
FINAL_MILESTONE = "commissioning complete"
AT_RISK = 0.5
#: Parts that are tested in each text's row at most.
MOST_PARTS = 256


# Versions


def with_validity(versions: DataFrame, key: str = "node_id", time: str = "tx_time", seq: str = "seq", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Versions with ``tx_from`` and ``tx_to``, the time of the next one (null for the current)."""
    return with_next(versions.withColumn("tx_from", F.col(time)), [key], [time, seq], time, "tx_to", hot_rows)


def as_of(versions: DataFrame, at: Column, key: str = "node_id", time: str = "tx_time", seq: str = "seq") -> DataFrame:
    """Each key's latest version at a time; keys without one by then are absent."""
    return first_by(versions.where(F.col(time) <= at), [key], F.col(time).desc(), F.col(seq).desc())


def as_of_each(versions: DataFrame, asked: DataFrame, key: str = "node_id", time: str = "tx_time", at: str = "at", seq: str = "seq", hot_rows: int = HOT_ROWS) -> DataFrame:
    """For each row (key, at) of ``asked``, the latest version by then: one sort of both sides' union, no range join."""
    names = [c for c in versions.columns if c != key]
    state = F.struct(*names)
    left = asked.select(key, F.col(at).alias("__t"), F.lit(1).alias("__asked"), F.lit(None).cast(versions.select(state.alias("s")).schema["s"].dataType).alias("__state"), F.lit(None).cast(versions.schema[seq].dataType).alias("__seq"))
    right = versions.select(key, F.col(time).alias("__t"), F.lit(0).alias("__asked"), state.alias("__state"), F.col(seq).alias("__seq"))
    found = with_last(left.unionByName(right), [key], ["__t", "__asked", "__seq"], "__state", "__last", hot_rows)
    return found.where("__asked = 1 and __last is not null").select(key, F.col("__t").alias(at), "__last.*")


def merged_attributes(versions: DataFrame, key: str = "node_id", attributes: str = "attributes", time: str = "tx_time", seq: str = "seq") -> DataFrame:
    """Each key's attributes, of each the latest version's value: a top-1 per key and attribute, then one map."""
    each = versions.select(key, time, seq, F.explode(attributes).alias("name", "value"))
    latest = first_by(each, [key, "name"], F.col(time).desc(), F.col(seq).desc())
    return latest.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias(attributes))


def current_nodes(writes: DataFrame, key: str = "node_id", time: str = "tx_time", seq: str = "seq") -> DataFrame:
    """``key, node_type, attributes, valid_time, transaction_time`` of each node after all its writes.

    A node keeps the type of its first write, merges attributes, and keeps its
    ``valid_time`` unless a write gives one (without any, it is the time of the
    first write); ``transaction_time`` is the last write's. All are aggregates that
    Spark begins before the shuffle, so a node of many writes is no hot task.
    """
    when = F.struct(time, seq)
    given = F.max_by("valid_time", F.when(F.col("valid_time").isNotNull(), when))
    heads = writes.groupBy(key).agg(F.min_by("node_type", when).alias("node_type"), F.coalesce(given, F.min(time)).alias("valid_time"), F.max(time).alias("transaction_time"))
    merged = merged_attributes(writes, key, "attributes", time, seq)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return heads.join(merged, key, "left").select(key, "node_type", F.coalesce("attributes", none).alias("attributes"), "valid_time", "transaction_time")


def node_history(writes: DataFrame, key: str = "node_id", time: str = "tx_time", seq: str = "seq", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every version of each node in both times: ``node_type`` as first written, the ``valid_time`` that held, and ``tx_from`` to ``tx_to``."""
    first = F.min_by("node_type", F.struct(time, seq)).alias("node_type")
    heads = writes.groupBy(key).agg(first, F.min(time).alias("__first"))
    held = with_last(writes.drop("node_type"), [key], [time, seq], "valid_time", "__valid", hot_rows).join(heads, key)
    return with_validity(held.withColumn("valid_time", F.coalesce("__valid", "__first")).drop("__valid", "__first"), key, time, seq, hot_rows)


def agent_risks(updates: DataFrame, key: str = "node_id", order: str = "seq") -> DataFrame:
    """Each key's risk: the largest of its agents' latest scores, and those by agent."""
    latest = first_by(updates, [key, "agent"], F.col(order).desc())
    return latest.groupBy(key).agg(F.max("score").alias("risk_score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", "score")))).alias("agent_risks"))


# Edges


def latest_edges(edges: DataFrame, by_relationship: bool = True) -> DataFrame:
    """One edge a key, the last written; without ``by_relationship`` one between two nodes whatever its kind."""
    keys = ["src", "dst", "relationship"] if by_relationship else ["src", "dst"]
    return first_by(edges, keys, F.col("seq").desc())


def neighbours(edges: DataFrame, nodes: DataFrame, relationship: str | None = None, direction: str = "out") -> DataFrame:
    """``node_id, neighbour, relationship, direction`` and the neighbour's columns as a struct."""
    if relationship is not None:
        edges = edges.where(F.col("relationship") == relationship)
    ways = []
    for way, here, there in (("out", "src", "dst"), ("in", "dst", "src")):
        if direction in (way, "both"):
            ways.append(edges.select(F.col(here).alias("node_id"), F.col(there).alias("neighbour"), "relationship", F.lit(way).alias("direction")))
    both = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])
    far = nodes.select(F.col("node_id").alias("neighbour"), F.struct(*[c for c in nodes.columns if c != "node_id"]).alias("node"))
    return both.join(far, "neighbour").select("node_id", "neighbour", "relationship", "direction", "node")


def edges_between(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges of which both ends are nodes."""
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", src), src, "left_semi").join(ids.withColumnRenamed("node_id", dst), dst, "left_semi")


def clause_edges(equipment: DataFrame, clauses: DataFrame) -> DataFrame:
    """``src`` (tag), ``dst`` (clause) where a clause's text, in upper case, contains the tag or a keyword of the tag's prefix.

    ``equipment`` has ``tag``, ``clauses`` has ``clause`` and ``text``. Keywords
    are few and tested in the text's row; tags are looked up by ``occurring``.
    What is made unique are clauses with prefixes, and the tags named beyond those:
    so the edges, which are many times as many, are so as they come, and no task
    holds or sorts them.
    """
    tags = scratch(equipment.select("tag").where("tag is not null").distinct().withColumn("prefix", F.split("tag", "-")[0]), "tags")
    upper = clauses.select("clause", F.upper("text").alias("text"))
    prefixes = [F.when(F.coalesce(F.exists(F.array(*map(F.lit, phrases)), lambda k: F.contains(F.col("text"), k)), F.lit(False)), F.lit(prefix)) for prefix, phrases in KEYWORDS.items()]
    meant = scratch(upper.select("clause", F.explode(F.array_compact(F.array(*prefixes))).alias("prefix")).distinct(), "meant")
    named = occurring(upper, "text", tags.withColumn("name", F.upper("tag")), "name").select("tag", "clause", "prefix")
    covered = meant.select(F.col("clause").alias("__clause"), F.col("prefix").alias("__prefix"))
    beyond = named.join(covered, F.col("clause").eqNullSafe(F.col("__clause")) & (F.col("prefix") == F.col("__prefix")), "left_anti")
    pairs = meant.join(tags, "prefix").select("tag", "clause").union(beyond.select("tag", "clause").distinct())
    return pairs.select(F.col("tag").alias("src"), F.col("clause").alias("dst"))


def containing(left: DataFrame, text: Column, right: DataFrame, part: Column) -> DataFrame:
    """Rows of both sides where ``text`` contains ``part``.

    Up to ``MOST_PARTS`` parts are broadcast and tested in each row; more are
    looked up by ``occurring``, a join by equality.
    """
    if right.limit(MOST_PARTS + 1).count() <= MOST_PARTS:
        return left.join(F.broadcast(right), text.contains(part))
    return occurring(left.withColumn("__text", text), "__text", right.withColumn("__part", part), "__part").drop("__text", "__part")


def deviation_graph(deviations: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of deviations (equipment_tag, clause_id, parameter).

    A deviation deviates from those specifications of its tag whose id contains
    its clause's id, and impacts the activities that require its tag.
    """
    found = deviations.withColumn("dev", F.concat_ws("::", F.lit("DEV"), "equipment_tag", "clause_id", "parameter"))
    nodes = found.select(F.col("dev").alias("node_id"), F.lit("Deviation").alias("node_type")).distinct()
    specified = edges.where("relationship = 'SPECIFIED_BY'").select(F.col("src").alias("equipment_tag"), "dst")
    required = edges.where("relationship = 'REQUIRES'").select(F.col("dst").alias("equipment_tag"), F.col("src").alias("dst"))
    from_ = found.join(specified, "equipment_tag").where(F.contains("dst", "clause_id")).select(F.col("dev").alias("src"), "dst", F.lit("DEVIATES_FROM").alias("relationship"))
    to = found.select("equipment_tag", "dev").join(required, "equipment_tag").select(F.col("dev").alias("src"), "dst", F.lit("IMPACTS").alias("relationship"))
    return nodes, from_.union(to).distinct()


def sizes(nodes: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: how many nodes, edges and vectors there are."""
    return nodes.agg(F.count("*").alias("n_nodes")).join(edges.agg(F.count("*").alias("n_edges"))).join(vectors.agg(F.count("*").alias("n_vectors")))  # one row each


# Building the graph from facts


def schedule_graph(activities: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a schedule: activities, their links, the critical path, and the equipment that names mention."""
    kind = F.when(F.col("is_milestone"), "Milestone").otherwise("ScheduleActivity")
    nodes = activities.select(F.col("task_code").alias("node_id"), kind.alias("node_type"))
    tagged = activities.select("task_code", F.explode(tags_in(F.col("name"))).alias("tag"))
    equipment = tagged.select(F.col("tag").alias("node_id"), F.lit("Equipment").alias("node_type")).distinct()
    edge = lambda df, src, dst, kind: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("relationship"))
    final = final_milestone(activities)
    critical = activities.where("is_critical").select("task_code").join(F.broadcast(final.select(F.col("task_code").alias("final"))), F.col("task_code") != F.col("final"))
    edges = edge(links, "predecessor", "successor", "BLOCKS").unionByName(edge(critical, "task_code", "final", "ON_CRITICAL_PATH")).unionByName(edge(tagged, "task_code", "tag", "REQUIRES"))
    return nodes.unionByName(equipment), edges


def discovered(activities: DataFrame, order: str = "seq", most: int = 1000) -> DataFrame:
    """``tag, n_activities, discovered_in`` of the equipment that activities' names mention.

    ``discovered_in`` has the activities' codes, each once, in the order that
    they come; of a tag that more than ``most`` mention it is the first of them,
    and ``n_activities`` counts all.
    """
    each = activities.select("task_code", F.col(order).alias("__order"), F.explode(tags_in(F.col("name"))).alias("tag")).groupBy("tag", "task_code").agg(F.min("__order").alias("__order"))
    place = F.row_number().over(Window.partitionBy("tag").orderBy("__order", "task_code"))
    few = each.withColumn("__place", place).where(F.col("__place") <= most)
    listed = few.groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("__place", "task_code"))), lambda x: x["task_code"]).alias("discovered_in"))
    return each.groupBy("tag").agg(F.count("*").alias("n_activities")).join(listed, "tag")


def final_milestone(activities: DataFrame) -> DataFrame:
    """One row: the milestone named so, or else the one of the latest early end."""
    named = F.lower("name").contains(FINAL_MILESTONE)
    return activities.where("is_milestone").orderBy(named.desc(), F.col("early_end").desc_nulls_last(), "task_code").limit(1)


def fact_graph(nodes: DataFrame, submittals: DataFrame, requirements: DataFrame, rfis: DataFrame, procedures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What submittals, requirements, RFIs and procedures add to a schedule's nodes and edges."""
    node = lambda df, key, kind: df.select(key.alias("node_id"), F.lit(kind).alias("node_type")).where("node_id is not null").distinct()
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("relationship")).where("src is not null and dst is not null").distinct()
    param = F.coalesce(F.nullif("parameter", F.lit("")), F.nullif("canonical_parameter", F.lit("")), F.lit("param"))
    clauses = requirements.withColumn("clause", F.concat(F.lit("SPEC::"), "clause_id", F.lit("::"), param))
    equipment = nodes.where("node_type = 'Equipment'").select(F.col("node_id").alias("tag")).union(submittals.select("equipment_tag")).distinct()
    texts = clauses.select("clause", F.concat_ws(" ", "system", "parameter", "source_text").alias("text"))
    tests = procedures.select("procedure_id", F.explode(tags_in(F.to_json(F.struct("*")))).alias("tag"))
    added = [
        node(submittals, F.col("equipment_tag"), "Equipment"),
        node(submittals, F.col("vendor"), "Vendor"),
        node(clauses, F.col("clause"), "Specification"),
        node(rfis, F.col("rfi_id"), "RFI"),
        node(procedures, F.col("procedure_id"), "TestProcedure"),
    ]
    every = nodes
    for more in added:
        every = every.unionByName(more)
    every = every.distinct()
    ids = every.select("node_id")
    linked = edge(rfis, F.col("rfi_id"), F.col("linked_activity"), "LINKED_TO").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    tested = edge(tests, F.col("procedure_id"), F.col("tag"), "TESTS").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    specified = clause_edges(equipment, texts).withColumn("relationship", F.lit("SPECIFIED_BY"))
    procured = edge(submittals, F.col("equipment_tag"), F.col("vendor"), "PROCURED_FROM")
    names = ("src", "dst", "relationship")
    return every, procured.select(*names).union(specified.select(*names)).union(linked.select(*names)).union(tested.select(*names))


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``op`` (added, changed or removed) and the columns of ``old`` (keys unique): what makes ``new`` of it.

    Rows are compared by a hash of the columns beside the keys; equal rows are left
    out, and of a removed row the old columns are given.
    """
    rest = [c for c in old.columns if c not in keys]
    plain = lambda c, kind: F.to_json(F.struct(F.array_sort(F.map_entries(c)).alias("m"))) if kind.startswith("map") else F.to_json(F.struct(F.col(c).alias("v")))
    digest = F.sha2(F.concat_ws("|", F.lit(""), *(plain(c, kind) for c, kind in old.dtypes if c in rest)), 256)
    side = lambda df, name: df.select(*(F.col(k).alias(k) for k in keys), F.struct(digest.alias("digest"), *rest).alias(name))
    both = side(old, "__old").join(side(new.select(*old.columns), "__new"), keys, "full")
    op = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old.digest") != F.col("__new.digest"), "changed")
    return both.withColumn("op", op).where("op is not null").select("op", *keys, *(F.coalesce(f"__new.{c}", F.when(F.col("op") == "removed", F.col(f"__old.{c}"))).alias(c) for c in rest))


def applied(old: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` after ``changes``: untouched rows as they are, without those changed or removed, and the new ones."""
    untouched = old.join(changed.select(*keys), keys, "left_anti")
    return untouched.select(*old.columns).unionByName(changed.where("op <> 'removed'").select(*old.columns))


def replaced(rows: DataFrame, stale: Column, fresh: DataFrame) -> DataFrame:
    """``rows`` without the stale ones, and the fresh ones: a derivation replaces the one before."""
    return rows.where(~F.coalesce(stale, F.lit(False))).unionByName(fresh, allowMissingColumns=True)


# Questions


def of_status(rows: DataFrame, status: str, column: str = "status") -> DataFrame:
    """Rows of a status, written in any case; a null is no status."""
    return rows.where(F.lower(F.coalesce(column, F.lit(""))) == status.lower())


def of_prefix(nodes: DataFrame, prefix: str, key: str = "node_id", but: tuple[str, ...] = ()) -> DataFrame:
    """Nodes whose id begins with ``prefix`` but with none of ``but``: pushed down to the scan."""
    test = F.col(key).startswith(prefix)
    for other in but:
        test = test & ~F.col(key).startswith(other)
    return nodes.where(test)


def at_risk(nodes: DataFrame, threshold: float = AT_RISK) -> DataFrame:
    """Equipment of a risk over the threshold (not at it)."""
    return nodes.where((F.col("node_type") == "Equipment") & (F.col("risk_score") > threshold))


def critical_activities(activities: DataFrame) -> DataFrame:
    """Critical activities by early start, those without one first."""
    return activities.where("is_critical").orderBy(F.col("early_start").asc_nulls_first(), "task_code")


def open_on_critical_path(items: DataFrame, links: DataFrame, activities: DataFrame, milestones: DataFrame) -> DataFrame:
    """Open items linked to an activity that is critical or leads to a milestone.

    ``items`` (item, status), ``links`` (item, activity), ``activities``
    (activity, is_critical), ``milestones`` (activity, milestone, seq).
    """
    live = of_status(items, "open")
    first = first_by(milestones, ["activity"], F.col("seq").asc()).select("activity", "milestone")
    hops = live.join(links, "item").join(activities, "activity").join(first, "activity", "left")
    kept = hops.where(F.coalesce("is_critical", F.lit(False)) | F.col("milestone").isNotNull())
    gate = F.coalesce("milestone", F.lit("critical path"))
    path = F.concat(F.col("item"), F.lit(" -LINKED_TO-> "), F.col("activity"), F.lit(" -ON_CRITICAL_PATH-> "), gate)
    return kept.select("item", "activity", gate.alias("gates_milestone"), path.alias("path"))


def path_text() -> Column:
    """An edge as text: ``src -RELATIONSHIP-> dst``."""
    return F.concat(F.col("src"), F.lit(" -"), F.col("relationship"), F.lit("-> "), F.col("dst"))
