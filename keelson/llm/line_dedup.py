"""Line dedup: drop the lines that too large a share of a site's pages has.

Native: DataFrame functions only. Lines travel as 64-bit hashes, never as text:
per host, pages holding a line are counted (partial sums before the shuffle, so
that a host with a third of all pages is no hot task), divided by the host's
pages, and what exceeds the ratio becomes one short array per host. A host with
L distinct lines a page on average has at most L / ratio such lines, so the
arrays stay short however many pages there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

#: Share of a host's pages above which a line is boilerplate, and pages that must have it at least.
BOILERPLATE_RATIO = 0.08
MIN_PAGES = 5
#: The hosts' arrays are broadcast up to so many hashes (16 MB), and else joined with salted keys.
BROADCAST_HASHES = 1 << 21
SALTS = 64


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float, min_pages: int, copies_once: bool = False) -> DataFrame:
    """``host, bad``: of each host with boilerplate, the hashes of its boilerplate lines."""
    pages = docs.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("text"))
    line = F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), line_hash))).alias("line")
    if copies_once:  # equal texts of a host are one page; partial sums come before each shuffle
        lines = pages.select("host", F.xxhash64("text").alias("page"), line).distinct()
        pages = pages.select("host", F.xxhash64("text").alias("page")).distinct()
    else:
        lines = pages.select("host", line)
    common = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    over = common.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("total"))
    return over.groupBy("host").agg(F.collect_set("line").alias("bad"))


def _beside(docs: DataFrame, bad: DataFrame, host: str, text: str) -> DataFrame:
    """``docs`` with the arrays of their host, null where it has none."""
    if (bad.agg(F.sum(F.size("__bad") + F.size("__whole"))).first()[0] or 0) <= BROADCAST_HASHES:
        return docs.join(F.broadcast(bad), F.col(host) == F.col("__host"), "left")
    salted = bad.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = docs.withColumn("__key", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
    return left.join(salted, (F.col(host) == F.col("__host")) & (F.col("__key") == F.col("__salt")), "left").drop("__salt", "__key")


def _filled(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.trim(x) != "")


def _length(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.length(x))


def whole_pages(docs: DataFrame, bad: DataFrame, host: str, text: str) -> DataFrame:
    """``host, whole``: hashes of texts that stay as they are, at most one for each boilerplate line.

    Of the pages that would lose more than half of their characters, as copies
    do, one that has the line: so no line goes from all of them.
    """
    filled = _filled(F.split(text, "\n"))
    cut = F.filter(filled, lambda x: F.array_contains("__bad", line_hash(x)))
    pages = _beside(docs.select(host, text), bad, host, text).where(F.col("__bad").isNotNull()).where(2 * _length(cut) > _length(filled))
    lines = pages.select("__host", F.explode(F.array_distinct(F.transform(cut, line_hash))).alias("line"), F.xxhash64(text).alias("page"))
    first = lines.groupBy("__host", "line").agg(F.min("page").alias("page"))
    return first.groupBy(F.col("__host").alias("host")).agg(F.collect_set("page").alias("whole"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = BOILERPLATE_RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and ``n_lines``, ``n_dropped``.

    A page's lines are what newlines part; they are compared trimmed of spaces,
    and blank ones are neither counted nor dropped. A line goes when more than
    ``ratio`` of its host's pages, and at least ``min_pages``, have it (however
    often a page does). No page goes: one may be left with an empty text. A null
    text stays null and counts as a page without lines; pages of a null host
    stay as they are. Repeated rows count as pages each.

    With ``copies_once`` the equal texts of a host count as one page, a page
    never loses all its lines, and of pages that are mostly boilerplate (near
    copies) some stay whole, so that each line of theirs is still in one.
    """
    bad = scratch(boilerplate(docs, host, text, ratio, min_pages, copies_once), "boilerplate").withColumnsRenamed({"host": "__host", "bad": "__bad"})
    none = F.array().cast("array<bigint>")
    bad = bad.withColumn("__whole", none)
    if copies_once:
        whole = scratch(whole_pages(docs, bad, host, text), "whole")
        bad = bad.drop("__whole").join(whole, F.col("__host") == F.col("host"), "left").select("__host", "__bad", F.coalesce("whole", none).alias("__whole"))
    joined = _beside(docs, bad, host, text)
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("__bad", line_hash(x)))
    stays = F.col("__bad").isNull()
    if copies_once:
        stays |= F.array_contains("__whole", F.xxhash64(text)) | (F.size(_filled(kept)) == 0)
    kept = F.when(stays, lines).otherwise(kept)
    return (
        joined.withColumn("__kept", kept)
        .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.col("n_lines") - F.coalesce(F.size("__kept"), F.lit(0)))
        .withColumn(text, F.array_join("__kept", "\n"))
        .drop("__host", "__bad", "__whole", "__kept")
    )


ORACLE_SQL = f"""
with lines as (
  select doc_id, source, unnest(list_distinct(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x)))) as line
  from documents where source is not null
), bad as (
  select source, list(line) as bad from (
    select l.source, line from lines l join (select source, count(*) as total from documents group by source) t using (source)
    group by l.source, line, total having count(*) >= {MIN_PAGES} and count(*) > {BOILERPLATE_RATIO} * total
  ) group by source
), cut as (
  select doc_id, text, string_split(text, chr(10)) as lines,
    list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' or not list_contains(coalesce(bad, []), trim(x))) as kept
  from documents left join bad using (source)
)
select doc_id, case when text is not null then array_to_string(kept, chr(10)) end as text,
  coalesce(len(lines), 0)::bigint as n_lines, (coalesce(len(lines), 0) - coalesce(len(kept), 0))::bigint as n_dropped
from cut
"""
