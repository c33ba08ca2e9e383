"""Readers of registers, caches, procedure catalogues and folders of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clean_cell
from ..schemas import PROCEDURES, RFI_FIELDS

# What a register's headings contain, by column.
HEADINGS = {
    "rfi_id": "rfi no", "subject": "subject", "discipline": "discipline", "status": "status", "priority": "priority", "raised_by": "raised by", "ball_in_court": "ball in court",
    "date_raised": "date raised", "date_required": "required", "date_responded": "responded", "linked_activity": "activity", "linked_spec": "spec", "equipment_tag": "equipment",
    "question": "question", "response": "response", "cost_impact": "cost", "schedule_impact": "schedule impact",
}

# Names of fields that a cache of source facts must not have.
FORBIDDEN_KEYS = ("deviation", "deviations", "compliant", "compliance", "violation", "risk_score", "severity", "delay_days")


def register(cells: DataFrame) -> DataFrame:
    """RFIs out of a sheet's rows (``file, row, cells array<string>``), whatever stands above its heading.

    The heading is the first row with a cell that contains the id's heading;
    columns are found by what their headings contain. Rows without an id are
    left out, blank cells and formulas are null, columns that are missing too.
    """
    low = F.transform("cells", lambda c: F.lower(F.coalesce(c, F.lit(""))))
    rows = cells.withColumn("low", low)
    heads = rows.where(F.exists("low", lambda c: c.contains(HEADINGS["rfi_id"]))).groupBy("file").agg(F.min(F.struct("row", "low")).alias("head"))
    placed = rows.join(heads, "file").where(F.col("row") > F.col("head.row"))
    column = lambda text: clean_cell(F.get("cells", F.array_position(F.transform("head.low", lambda c: c.contains(text)), True).cast("int") - 1))
    at = lambda text: F.array_position(F.transform("head.low", lambda c: c.contains(text)), True) > 0
    found = placed.select("file", "row", *(F.when(at(HEADINGS[f]), column(HEADINGS[f])).alias(f) for f in RFI_FIELDS))
    return found.where("rfi_id is not null")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files (an object or an array each); what can't be parsed gives no row."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    got = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path, multiLine=True)
    return got.where("_corrupt_record is null").drop("_corrupt_record") if names else got


def read_procedures(spark: SparkSession, path: str) -> DataFrame:
    """Procedures of a catalogue, which is an object with ``procedures`` or an array of them."""
    text = spark.read.text(path, wholetext=True)
    either = F.coalesce(F.from_json("value", PROCEDURES)["procedures"], F.from_json("value", PROCEDURES.removeprefix("procedures ")))
    return text.select(F.explode(either).alias("p")).select("p.*")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """``name, path, modified, bytes`` of the files of a folder, hidden ones left out; their content isn't read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(~F.col("name").startswith(".")).select("name", "path", "modified", "bytes").orderBy("name")


def is_stale(sources: DataFrame, caches: DataFrame) -> DataFrame:
    """``name, stale``: whether a source (name, modified) is newer than what was derived from it, or nothing was."""
    derived = caches.groupBy("name").agg(F.min("modified").alias("derived"))
    return sources.join(derived, "name", "left").select("name", (F.col("derived").isNull() | (F.col("modified") > F.col("derived"))).alias("stale"))


def forbidden_keys(rows: DataFrame) -> list[str]:
    """Paths of fields, at any depth, whose names give an answer away (``FORBIDDEN_KEYS``, in any case); read off the schema."""
    found: list[str] = []

    def walk(kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                inner = f"{path}.{field.name}".lstrip(".")
                if field.name.lower() in FORBIDDEN_KEYS:
                    found.append(inner)
                walk(field.dataType, inner)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, path)
        elif isinstance(kind, T.MapType):
            walk(kind.valueType, path)

    walk(rows.schema, "")
    return found


def without_answers(rows: DataFrame, source: str) -> DataFrame:
    """``rows``, or an error if they have forbidden keys."""
    if bad := forbidden_keys(rows):
        raise ValueError(f"{source} has answers in {', '.join(sorted(bad))}")
    return rows
