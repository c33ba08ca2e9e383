"""Merkle manifest of a dataset: a digest a row, a tree a language, one root, and a proof a row.

Every row is a leaf. A language's leaves are in order of their ids, eight
consecutive nodes have one parent, and the languages' roots are the leaves of the
last tree. A tree is held as *parents*: one row a node, with its children pivoted
into ``FANOUT`` columns by conditional aggregates over their slot. Joining the
columns hashes the node; joining them without one slot's column gives that
child's siblings, those to the left of it and those to the right.

Going up, a level is one aggregation, and holds an eighth of the rows below it.
Going down, a node hands its own siblings and those of all above it to its
children, so that the paths of all rows cost one join with the lowest parents.
Nothing is gathered by language: rows are placed by ranges of the order.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, scratch

FANOUT = 8
#: What a row's digest covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose id's crc32 this divides are tampered with, to show that their proofs fail.
TAMPERED = 3
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE_SQL = f"""
with recursive docs as (
  select *, case when text is null then null else translate(text, '{_UPPER}', '{_UPPER.lower()}') end as low,
    list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)),
      lambda a, c: list_reduce(list_concat([xor(a, c)], [1::bigint, 1, 1, 1, 1, 1, 1, 1]), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as crc
  from documents
), head as (
  select *, {" || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')" for c in FIELDS[:-1])} as h, coalesce(xor(crc, 4294967295) % {TAMPERED} = 0, false) as bad from docs
), leaves as (
  select doc_id, coalesce('=' || lang, '') as k, sha256(h || coalesce(strlen(text) || ':' || text, '-')) as leaf, case when bad then sha256(h || coalesce(strlen(low) || ':' || low, '-')) end as other from head
), placed as (
  select *, row_number() over (order by k, doc_id nulls first, leaf, other) as id, row_number() over (partition by k order by doc_id nulls first, leaf, other) - 1 as pos, count(*) over (partition by k) as n from leaves
), up as (
  select 0 as lvl, k, pos, n, leaf as d from placed
  union all select lvl + 1, k, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(d, '' order by pos)) from up where n > 1 group by lvl, k, pos // {FANOUT}, n
), subroots as (select k, d, row_number() over (order by k) - 1 as pos, count(*) over () as n from up where n = 1),
top as (
  select 0 as lvl, pos, n, d from subroots
  union all select lvl + 1, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(d, '' order by pos)) from top where n > 1 group by lvl, pos // {FANOUT}, n
), every as (select lvl, k, pos, n, d from up union all select lvl, null, pos, n, d from top),
beside as (
  select a.lvl, a.k, a.pos, coalesce(string_agg(b.d, '' order by b.pos) filter (b.pos < a.pos), '') as l, coalesce(string_agg(b.d, '' order by b.pos) filter (b.pos > a.pos), '') as r
  from every a join every b on a.lvl = b.lvl and a.k is not distinct from b.k and a.pos // {FANOUT} = b.pos // {FANOUT} where a.n > 1 group by all
), low_fold as (
  select id, k, 0 as lvl, pos, n, coalesce(other, leaf) as d, '' as proof from placed
  union all select f.id, f.k, f.lvl + 1, f.pos // {FANOUT}, (f.n + {FANOUT - 1}) // {FANOUT}, sha256(s.l || f.d || s.r), f.proof || s.l || s.r from low_fold f join beside s on s.lvl = f.lvl and s.k = f.k and s.pos = f.pos where f.n > 1
), high_fold as (
  select f.id, s.d as subroot, 0 as lvl, s.pos, s.n, f.d, f.proof from low_fold f join subroots s using (k) where f.n = 1
  union all select f.id, f.subroot, f.lvl + 1, f.pos // {FANOUT}, (f.n + {FANOUT - 1}) // {FANOUT}, sha256(s.l || f.d || s.r), f.proof || s.l || s.r from high_fold f join beside s on s.lvl = f.lvl and s.k is null and s.pos = f.pos where f.n > 1
)
select p.doc_id, p.leaf, h.subroot, t.d as root, sha256(h.proof) as proof_sha256, h.d as folded_root, h.d = t.d as verified
from placed p join high_fold h on p.id = h.id and h.n = 1, (select d from top where n = 1) t
"""


def row_digest(*fields: Column) -> Column:
    """The sha256 of fields, each with its length in bytes before it, so that no two rows spell alike; ``-`` is null."""
    spelled = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*spelled).cast("binary"), 256)


def _digest(*hexes: Column) -> Column:
    return F.sha2(F.concat(*hexes).cast("binary"), 256)


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (``tree``, ...) with ``pos``, the number of a row in its tree from 0 on, and ``n``, the rows of its tree.

    Rows are dealt by ranges of ``tree, order``. A range's rows of a tree begin
    where those of the ranges before it end, so a tree of any size is spread.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = scratch(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "leaves")
    runs = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("many"))  # ranges + trees rows
    tree, so_far = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("part")
    runs = scratch(runs.select("tree", "part", (F.sum("many").over(so_far) - F.col("many") - F.col("first")).alias("shift"), F.sum("many").over(tree).alias("n")), "runs")
    return dealt.join(runs, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _joined(slots: Iterable[int]) -> str:
    """SQL of the digests of some slots, joined."""
    return ", ".join(["concat(''", *(f"coalesce(s{i}.digest, '')" for i in slots)]) + ")"


def _parents(nodes: DataFrame) -> DataFrame:
    """``tree, pos, n, digest, s0 .. s7`` of each parent of ``nodes`` (``tree, pos, n, node``) in trees of several.

    ``n`` is the number of the parents in the tree. A slot without a child is null.
    """
    pivoted = [F.expr(f"max(case when pmod(pos, {FANOUT}) = {i} then node end) as s{i}") for i in range(FANOUT)]
    grouped = nodes.where("n > 1").groupBy("tree", F.expr(f"pos div {FANOUT}").alias("pos")).agg(F.expr(f"min((n + {FANOUT - 1}) div {FANOUT}) as n"), *pivoted)
    return grouped.withColumn("digest", F.expr(f"sha2({_joined(range(FANOUT))}, 256)"))


def _grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The parents of each level, the lowest first, and ``tree, height, digest`` of each tree's root."""
    most = nodes.agg(F.max("n")).first()[0] or 0  # one number
    root = lambda df, height: df.where("n = 1").select("tree", F.lit(height).alias("height"), F.col("digest"))
    levels, roots = [], [root(nodes.select("tree", "n", F.col("node.digest").alias("digest")), 0)]
    while most > 1:
        parents = scratch(_parents(nodes), "parents")
        levels.append(parents)
        roots.append(root(parents, len(levels)))
        nodes = parents.select("tree", "pos", "n", F.struct("digest").alias("node"))
        most = -(-most // FANOUT)
    return levels, reduce(DataFrame.union, roots)


def _paths(nodes: DataFrame, levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """``node, path`` and what else ``roots`` (``tree, height, path, ...``) has, of each of the lowest nodes.

    ``path`` has ``left`` and ``right``, the digests beside a node, of the node
    itself and of all above it but the root. No join is wider than an eighth of
    the nodes but that of trees of a single one.
    """
    more = [c for c in roots.columns if c not in ("tree", "height", "path")]
    at = lambda height: roots.where(F.col("height") == height).drop("height").withColumn("pos", F.lit(0).cast("long"))
    above = at(len(levels))
    child = "struct({0}L as slot, s{0} as node, struct({1} as left, {2} as right) as step)"
    children = ", ".join(child.format(i, _joined(range(i)), _joined(range(i + 1, FANOUT))) for i in range(FANOUT))
    for k in reversed(range(len(levels))):
        joined = levels[k].drop("n", "digest").join(above, ["tree", "pos"])
        each = joined.select("tree", "pos", "path", *more, F.expr(f"explode(filter(array({children}), c -> c.node is not null)) as child"))
        below = each.selectExpr("tree", f"pos * {FANOUT} + child.slot as pos", "child.node as node", "concat(array(child.step), path) as path", *more)
        above = below.drop("node").unionByName(at(k)) if k else below
    if not levels:
        return nodes.where("n = 1").join(roots.drop("height"), "tree").select("node", "path", *more)
    alone = nodes.where("n = 1").join(roots.where("height = 0"), "tree").select("node", "path", *more)
    return above.select("node", "path", *more).unionByName(alone)


def manifest(rows: DataFrame, tree: str, *order: str, payload: tuple[str, ...] = ()) -> DataFrame:
    """``order``, ``payload``, ``leaf``, ``subroot``, ``root`` and ``path`` of each row.

    ``rows`` have their digests as ``leaf``. Trees (a null one is a tree like
    any other, and the first) are in order of their names' bytes, leaves by
    ``order`` (nulls first) and then by digest, so repeated rows are leaves each.
    ``path``, from a leaf's own siblings to those of its subroot, is what
    ``folded`` and ``proof_digest`` take. No rows give no rows.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    kept = tuple(dict.fromkeys((*order, *payload)))
    fields = {c: f"p{i}" for i, c in enumerate(kept)}
    leaves = rows.select(named.alias("tree"), F.col("leaf").alias("digest"), *(F.col(c).alias(p) for c, p in fields.items()))
    nodes = _placed(leaves, *(fields[c] for c in order), "digest", *(fields[c] for c in payload)).select("tree", "pos", "n", F.struct("digest", *fields.values()).alias("node"))
    nodes = scratch(nodes, "placed")
    levels, subroots = _grown(nodes)
    tops = _placed(scratch(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "height", "digest"), "subroots"), "name")
    tops = scratch(tops.select("tree", "pos", "n", F.struct("digest", "name", "height").alias("node")), "placed")
    high, roots = _grown(tops)
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    proved = _paths(tops, high, roots.select("tree", "height", no_path.alias("path"), F.col("digest").alias("root")))
    starts = proved.select(F.col("node.name").alias("tree"), F.col("node.height").alias("height"), "path", F.col("node.digest").alias("subroot"), "root")
    found = _paths(nodes, levels, scratch(starts, "starts"))
    return found.select(*(F.col(f"node.{p}").alias(c) for c, p in fields.items()), F.col("node.digest").alias("leaf"), "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, leaf, lambda d, step: _digest(step["left"], d, step["right"]))


def proof_digest(path: Column) -> Column:
    """The sha256 of a path's siblings, level by level."""
    return _digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def verify_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each document.

    Before verifying, documents chosen by their ids' crc32 have the letters A-Z
    of their texts lower-cased; a null id or text, or a text without such
    letters, stays as it is and verifies. Digests are of hexadecimal digits.
    """
    low = F.translate("text", _UPPER, _UPPER.lower())
    other = F.when(bucket_of("doc_id", TAMPERED) == 0, row_digest(*map(F.col, FIELDS[:-1]), low))
    leaves = docs.select("doc_id", "lang", row_digest(*map(F.col, FIELDS)).alias("leaf"), other.alias("other"))
    proved = manifest(leaves, "lang", "doc_id", payload=("other",))
    back = folded(F.coalesce("other", "leaf"), F.col("path"))
    return proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
