"""Longest paths over links: a max-plus system, solved in rounds that grow with the logarithm of its depth.

Each node has a least value, and a link carries a node's value, plus the link's
weight, to its successor, which takes the largest of what it gets. A round
eliminates nodes of which no two are linked: what went through one goes on by
links past it, from each predecessor to each successor (parallel ones merge to
the larger). A chain loses a third of its nodes a round, so do ladders and other
thin networks, whatever their depth. When few links are left the rest is solved
in one task; then the rounds are gone through backwards, each eliminated node
taking its value from its predecessors of the time.

A node is eliminated if that adds few links (predecessors times successors
against their sum). First and last nodes always can be, so dense networks, which
are as wide as they are dense, advance by their layers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import scratch

#: Links that one task solves: some MB.
REST = 20_000
#: Links past a node that its elimination may add, for each link that it has.
FILL = 2


def _solve_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of the nodes that are left, in the order of their links, null on a cycle or behind one; ``node, least`` rows and ``node, source, weight`` rows come together."""
    least: dict[str, float] = {}
    out: dict[str, list[tuple[str, float]]] = {}
    waits: dict[str, int] = {}
    for batch in batches:
        for node, value, source, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if source is None:
                least[node] = value
            else:
                out.setdefault(source, []).append((node, weight))
                waits[node] = waits.get(node, 0) + 1
    ready, solved = [n for n in least if n not in waits], {}
    while ready:
        node = ready.pop()
        solved[node] = least[node]
        for successor, weight in out.get(node, ()):
            least[successor] = max(least[successor], least[node] + weight)
            waits[successor] -= 1
            if not waits[successor]:
                ready.append(successor)
    yield pa.RecordBatch.from_pydict({"node": pa.array(least, pa.string()), "value": pa.array([solved.get(n) for n in least], pa.float64())})


def longest(nodes: DataFrame, links: DataFrame, rest: int = REST, fill: int = FILL) -> DataFrame:
    """``node, value``: the least values of ``nodes`` (``node, least``) that also meet ``links`` (``src, dst, weight``).

    Nodes are unique and not null, and links are between nodes. No nodes give no
    rows; repeated links count once, and a cycle fails.
    """
    nodes = scratch(nodes.select("node", F.col("least").cast("double").alias("least")), "nodes")
    links = scratch(links.groupBy("src", "dst").agg(F.max(F.col("weight").cast("double")).alias("weight")), "links")
    if not links.where("src = dst").isEmpty():
        raise ValueError("the links have a cycle")
    gone: list[tuple[DataFrame, DataFrame]] = []
    while links.count() > rest:
        ends = links.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(links.select("dst", F.lit(1), F.lit(0)))
        degrees = ends.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        able = degrees.where(F.col("i") * F.col("o") <= fill * (F.col("i") + F.col("o"))).select("node", F.struct(F.xxhash64(F.lit(len(gone)), "node"), "node").alias("rank"))
        able = scratch(able, "able")
        pairs = links.join(able.select(F.col("node").alias("src"), F.col("rank").alias("a")), "src").join(able.select(F.col("node").alias("dst"), F.col("rank").alias("b")), "dst")
        beaten = pairs.select(F.when(F.col("a") < F.col("b"), F.col("dst")).otherwise(F.col("src")).alias("node")).distinct()
        chosen = scratch(able.join(beaten, "node", "left_anti").select("node"), "chosen")
        if chosen.isEmpty():
            raise ValueError("the links have a cycle")  # else a node without predecessors could go
        own = scratch(nodes.join(chosen, "node", "left_semi"), "own")
        into = scratch(links.join(chosen.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("before"), F.col("weight").alias("w")), "into")
        out_of = scratch(links.join(chosen.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("after"), F.col("weight").alias("x")), "out")
        gone.append((own, into))
        kept = links.join(chosen.withColumnRenamed("node", "src"), "src", "left_anti").join(chosen.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst", "weight")
        past = into.join(out_of, "node").select(F.col("before").alias("src"), F.col("after").alias("dst"), (F.col("w") + F.col("x")).alias("weight"))
        links = scratch(kept.unionAll(past).groupBy("src", "dst").agg(F.max("weight").alias("weight")), "links")
        if not links.where("src = dst").isEmpty():
            raise ValueError("the links have a cycle")
        raised = own.join(out_of, "node").select(F.col("after").alias("node"), (F.col("least") + F.col("x")).alias("least"))
        nodes = scratch(nodes.join(chosen, "node", "left_anti").unionAll(raised).groupBy("node").agg(F.max("least").alias("least")), "nodes")
    linked = links.select(F.col("src").alias("node")).unionAll(links.select("dst")).distinct()
    alone = nodes.join(linked, "node", "left_anti").select("node", F.col("least").alias("value"))
    left = nodes.join(linked, "node", "left_semi").select("node", "least", F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("weight"))
    left = left.unionAll(links.select("dst", F.lit(None).cast("double"), "src", "weight"))  # at most ``rest`` links
    solved = scratch(alone.unionAll(left.coalesce(1).mapInArrow(_solve_rest, "node string, value double")), "solved")
    if not solved.where("value is null").isEmpty():
        raise ValueError("the links have a cycle")
    for own, into in reversed(gone):
        best = into.join(solved.select(F.col("node").alias("before"), "value"), "before").groupBy("node").agg(F.max(F.col("value") + F.col("w")).alias("got"))
        level = own.join(best, "node", "left").select("node", F.greatest("least", "got").alias("value"))
        solved = solved.unionAll(scratch(level, "solved"))
    return solved
