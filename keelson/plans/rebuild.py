"""The five steps that derive everything from a project's sources, and what they leave as stores.

Each step replaces its store as a whole; the graph is brought to the new facts by
their differences, so nodes and edges that stay are not written again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import completed_requirement
from ..functions.scalars import plain_dashes
from ..operators import documents, graph, retrieval
from ..schemas import ACTIVITY, LINK, PARAMETER, REQUIREMENT, RFI, SUBMITTAL
from ..sources import tables, workbook, xer
from ..sources.store import KeyedStore, Store, scratch
from .run_all import timed

_TABLES = {
    "requirements": REQUIREMENT, "submittals": SUBMITTAL, "parameters": PARAMETER, "projects": "project_name string, data_date date", "activities": ACTIVITY, "links": LINK, "rfis": RFI,
    "corpus": "id string, document string, metadata map<string,string>",
}
_NODES, _EDGES = ["node_id", "node_type"], ["src", "dst", "relationship"]


@dataclass
class Sources:
    """Where a project's facts are: pages as a table (doc_id, page, text), the others as files."""

    pages: DataFrame
    requirements: str
    submittals: str
    procedures: str
    export: str
    register: str


class Project:
    """The stores under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.tables = {name: Store(spark, f"{root}/{name}", schema) for name, schema in _TABLES.items()}
        self.nodes = KeyedStore(spark, f"{root}/nodes", "node_id string, node_type string", ["node_id"])
        self.edges = KeyedStore(spark, f"{root}/edges", "src string, dst string, relationship string", _EDGES, by=["src"])

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def reset(self) -> None:
        """Empty every store, as before the first rebuild; a reader under way keeps what it began with."""
        for store in self.tables.values():
            store.clear()
        for store in (self.nodes, self.edges):
            store.remove(store.read())
            store.compact(always=True)


def _specification(project: Project, sources: Sources) -> DataFrame:
    """Requirements, completed, with texts from the pages where they were left out."""
    rows = tables.without_answers(tables.read_json(project.spark, sources.requirements, REQUIREMENT), "specification").withColumns(completed_requirement())
    bare = rows.where(F.trim(F.coalesce("source_text", F.lit(""))) == "").select("clause_id").where("clause_id is not null")
    pages = sources.pages.select("page", plain_dashes(F.col("text")).alias("text"))
    found = documents.clause_texts(bare, pages).select("clause_id", F.col("page").alias("__page"), F.col("source_text").alias("__text"))
    filled = rows.join(found, "clause_id", "left").withColumns({"source_text": F.coalesce(F.nullif(F.trim("source_text"), F.lit("")), "__text"), "page": F.coalesce("page", "__page")})
    return project.tables["requirements"].replace(filled.drop("__page", "__text"))


def _submittals(project: Project, sources: Sources) -> DataFrame:
    """Submittals and their parameters in order; a source with answers in it is refused."""
    rows = tables.read_json(project.spark, sources.submittals, f"{SUBMITTAL}, parameters array<struct<parameter string, canonical_parameter string, value string, unit string, page int, source_text string>>")
    tables.without_answers(rows, "submittal")
    project.tables["submittals"].replace(rows.drop("parameters"))
    each = rows.select("equipment_tag", F.posexplode("parameters").alias("seq", "p")).select("equipment_tag", "p.*", F.col("seq").cast("long").alias("seq"))
    return project.tables["parameters"].replace(each)


def _schedule(project: Project, sources: Sources) -> DataFrame:
    projects, activities, links = xer.read_schedule(project.spark, sources.export)
    project.tables["projects"].replace(projects.select("project_name", "data_date"))
    project.tables["links"].replace(links.drop("file"))
    return project.tables["activities"].replace(activities.drop("file"))


def _index(project: Project, sources: Sources) -> DataFrame:
    """The graph, brought to the facts by what changed, and the texts that are searched."""
    spark = project.spark
    nodes, edges = graph.schedule_graph(project.read("activities"), project.read("links"))
    procedures = tables.read_procedures(spark, sources.procedures)
    more, linked = graph.fact_graph(nodes, project.read("submittals"), project.read("requirements"), project.read("rfis"), procedures)
    first = more.groupBy("node_id").agg(F.min("node_type").alias("node_type"))
    for store, now, keys in ((project.nodes, first, ["node_id"]), (project.edges, edges.select(*_EDGES).union(linked).distinct(), _EDGES)):
        now = scratch(now.withColumn("__same", F.lit(1)), "facts")
        changed = graph.changes(store.read().withColumn("__same", F.lit(1)), now, keys).drop("__same")
        store.apply(scratch(changed, "changes"))
        store.compact()
    texts = retrieval.corpus(project.read("requirements"), project.read("rfis"), sources.pages)
    return project.tables["corpus"].replace(texts)


def rebuild(spark: SparkSession, sources: Sources, root: str) -> tuple[Project, DataFrame]:
    """Run the five steps in order: the project's stores, and ``stage, rows, seconds`` of each."""
    project = Project(spark, root)
    steps = {
        "specification": lambda: _specification(project, sources),
        "submittals": lambda: _submittals(project, sources),
        "schedule": lambda: _schedule(project, sources),
        "register": lambda: project.tables["rfis"].replace(workbook.read_register(spark, sources.register)),
        "index": lambda: _index(project, sources),
    }
    counted = {name: (lambda step=step: step().agg(F.count("*").alias("rows"))) for name, step in steps.items()}
    results, times = timed(counted)
    rows = [df.select(F.lit(name).alias("stage"), "rows") for name, df in results.items()]
    every = rows[0]
    for one in rows[1:]:
        every = every.union(one)
    return project, every.join(times, "stage")  # a row a step
