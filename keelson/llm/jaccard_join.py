"""N-gram Jaccard join: exact links of documents by their sets of word shingles.

Two documents link when the Jaccard similarity of their shingle sets is 3/4 or
more. The join is exact and returns one row a document: its set's size and the
component of the link graph that it belongs to.

Method: prefix lists with set-relation skipping.

* Equal sets are one class (``cid``, a 64-bit hash of the set; N distinct sets
  collide with probability N^2 / 2^65). Only classes are joined.
* Each class lists the first ``n - ceil(3n/4) + 1`` of its shingles in one global
  order: linked sets share one of them. The order is by hash, but shingles that
  tasks meet repeatedly come last (the more frequent, the later), so that shared
  passages stay out of the lists. A task meets a shingle twice among ``CHUNK`` once
  about ``sqrt(2 N / CHUNK)`` of all N are equal to it, so what is missed grows
  slower than the input. The order is only a matter of speed.
* Index skipping by position: lists are parted in blocks by set size. An entry is
  met with the blocks that its size and its position (how many shingles are left
  from there on) leave possible; the others are skipped whole, and entries of
  which no block is left are dropped.
* Answer skipping: each list's first class (its pivot) is compared with the
  others, which finds groups of alike sets in linear work. From a set's overlap
  with a pivot, its overlap with the pivot's other partners is bounded both ways;
  what the bounds decide is not compared again. Classes that are connected
  already need no comparison at all, as the result is components.
* What is left, pairs of a list that lie in different components, is compared
  exhaustively. Nothing is capped: skipped pairs are decided or connected.

Overlaps are computed from whole sets of 64-bit hashes, after a bound from small
histograms of the sets has ruled most pairs out. Sets are not stored: those that
are compared are computed again from their texts. Two shingles of one document
collide with probability n^2 / 2^65 (1e-11 for a text of 20,000 words).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT_ROWS, arrow_schema, binaries, frugal, rows_to_batches, scratch, small_batches

WORDS = 5
#: Links hold where OVER * overlap >= UNDER * (sum of sizes): a similarity of 3/4 or more.
OVER, UNDER = 7, 3
#: Histograms have about as many cells as the set has shingles, at least and at most so many.
LEAST_CELLS, MOST_CELLS = 64, 1 << 14
#: Shingles that come last in the order: at most so many, each met ``REPEATS`` times in some task's chunk of ``CHUNK``.
FREQUENT = 1 << 19
REPEATS = 2
CHUNK = 1 << 20
#: Tables of classes up to this size are broadcast.
BROADCAST_ROWS = 1 << 19
MAX_ROUNDS = 60
#: Further rounds of pivots before what is left is compared exhaustively; a set asks two of its lists in each.
PIVOTS = 1
_PLACE = "(at & 4294967295) / shiftright(at, 32)"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; one for a text of fewer words, none without words."""
    found = (text or b"").lower().split()  # of bytes: A-Z, and at ASCII white space
    n = len(found)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=n)], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    rolled = hashed[: n - words + 1].copy()
    for k in range(1, words):
        rolled *= _MULTIPLIER
        rolled += hashed[k : n - words + 1 + k]
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(32)
    return np.unique(rolled)


def class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def sketch(shingles: np.ndarray) -> bytes:
    """A set's histogram: counts of its hashes by their low bits."""
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (len(shingles).bit_length() - 1)))
    return np.minimum(np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def largest_overlap(left: bytes, right: bytes) -> int | None:
    """The most that two sets can have in common by their histograms; None if a full cell leaves it open."""
    a, b = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    if a.max() == 255 or b.max() == 255:
        return None
    if len(a) != len(b):  # the finer one in the cells of the coarser
        few = min(len(a), len(b))
        a, b = a.reshape(-1, few).sum(axis=0, dtype=np.int64), b.reshape(-1, few).sum(axis=0, dtype=np.int64)
    return int(np.minimum(a, b).sum(dtype=np.int64))


_SETS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("token", T.LongType()), T.StructField("times", T.LongType())]
)


def _distinct_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(class, set) of the texts in column 0, each class once a task."""
    seen: set[int] = set()
    for batch in batches:
        for text in binaries(batch.column(0)):
            found = shingle_set(text, words)
            if len(found) and (cid := class_of(found)) not in seen:
                seen.add(cid)
                yield cid, found


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _sets(words: int):
    """A row a document (``n``, ``cid``; a histogram once a class and task), and of shingles met several times how often (``token``, ``times``), chunk by chunk."""
    wanted = arrow_schema(_SETS)

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        token, times = np.unique(np.concatenate(held), return_counts=True)
        often = times >= REPEATS
        columns = [_signed(token[often]), pa.array(times[often].astype(np.int64))]
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(columns[0]), f.type) for f in list(wanted)[:4]), *columns], schema=wanted)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, TEXT_ROWS):
                part = batch.slice(start, TEXT_ROWS)
                sizes, cids, sketches = [], [], []
                for text in binaries(part.column(1)):
                    found = shingle_set(text, words)
                    cid = class_of(found) if len(found) else None
                    sizes.append(len(found))
                    cids.append(cid)
                    if cid is None or cid in seen:
                        sketches.append(None)
                        continue
                    seen.add(cid)
                    sketches.append(sketch(found))
                    held.append(found)
                    size += len(found)
                    if size >= CHUNK:
                        yield repeated(held)
                        held, size = [], 0
                none = pa.nulls(len(sizes), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(cids, pa.int64()), pa.array(sketches, pa.binary()), none, none], schema=wanted)
        if held:
            yield repeated(held)

    return build


def frequent_shingles(counted: DataFrame, limit: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """At most ``limit`` of the most frequent shingles (``token``, ``times``), sorted, and a level (log2 of the count) for each."""
    counts = scratch(counted.groupBy("token").agg(F.floor(F.log2(F.sum("times"))).cast("int").alias("level")), "frequent")
    held, lowest = 0, 64
    for row in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        if held + row["count"] > limit:
            break
        held, lowest = held + row["count"], row["level"]
    got = counts.where(F.col("level") >= lowest).toArrow()  # `limit` rows at most
    token, level = got["token"].to_numpy().view(np.uint64), got["level"].to_numpy().astype(np.uint8)
    order = np.argsort(token)
    return token[order], level[order]


_ENTRIES = T.StructType([T.StructField("token", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("at", T.LongType())])


def prefix(shingles: np.ndarray, frequent: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Of a sorted set, the shingles that it lists: the first by (level, hash) of which a linked set has one."""
    k = len(shingles) - -(-3 * len(shingles) // 4) + 1
    if len(frequent):
        near = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        often = frequent[near] == shingles
        if often.any():
            return shingles[np.argsort(np.where(often, levels[near], 0), kind="stable")[:k]]
    return shingles[:k]


def _prefixes(shared, words: int):
    wanted = arrow_schema(_ENTRIES)

    def list_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, levels = shared.value
        held, size = [], 0

        def entries() -> pa.RecordBatch:
            tokens, cids, at = (np.concatenate([h[k] for h in held]) for k in range(3))
            return pa.RecordBatch.from_arrays([_signed(tokens), pa.array(cids), pa.array(at)], schema=wanted)

        for cid, one in _distinct_sets(batches, words):
            listed = prefix(one, frequent, levels)
            held.append((listed, np.full(len(listed), cid, np.int64), np.arange(len(listed), dtype=np.int64) | (len(one) << 32)))
            size += len(listed)
            if size >= 1 << 16:
                yield entries()
                held, size = [], 0
        if held:
            yield entries()

    return list_prefixes


def _blobs(words: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows_to_batches(((cid, found.astype("<u8").tobytes()) for cid, found in _distinct_sets(batches, words)), pa.schema([("cid", pa.int64()), ("blob", pa.binary())]), lambda row: len(row[1]))

    return build


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _bounded(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose histograms allow a link."""
    for batch in _slices(pairs):
        most = [largest_overlap(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        sizes = (batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist()
        kept = [m is None or OVER * m >= UNDER * n for m, n in zip(most, sizes, strict=True)]
        yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "na", "nb"]).filter(pa.array(kept, pa.bool_()))


def _overlaps(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(pairs):
        common = [len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(common, pa.int64())], names=["a", "b", "na", "nb", "common"])


_PAIR = "a long, b long, na long, nb long"


def _small(table: DataFrame) -> DataFrame:
    """A scratch table, with a broadcast hint where its checked size allows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


class Sets:
    """The corpus as sets: ``rows`` (doc_id, text), and ``sets`` (doc_id, n, cid, sketch) made from them."""

    def __init__(self, rows: DataFrame, sets: DataFrame, words: int):
        self.rows, self.sets, self.words = rows, sets, words
        self.owners = scratch(sets.where("sketch is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id")), "owners")

    def _wanted(self, pairs: DataFrame) -> DataFrame:
        return scratch(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(self.owners, "cid"), "wanted")

    def _both(self, pairs: DataFrame, have: DataFrame, column: str) -> DataFrame:
        """``pairs`` with what both classes have; ``have`` is of the wanted classes alone."""
        with_b = pairs.join(have.select(F.col("cid").alias("b"), F.col(column).alias("right")), "b")
        return with_b.join(have.select(F.col("cid").alias("a"), F.col(column).alias("left")), "a").select("a", "b", "na", "nb", "left", "right")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b, na, nb) that may link, with ``common``, the size of their intersection.

        Only texts of compared classes are made sets again: a class is looked up by its
        owner's id. A null id fits all rows of null ids, whose classes then tell.
        """
        wanted = _small(self._wanted(pairs))
        sketches = self.sets.where("sketch is not null").join(wanted.select("cid"), "cid", "left_semi").groupBy("cid").agg(F.first("sketch").alias("sketch"))
        near = scratch(self._both(pairs, sketches, "sketch").mapInArrow(frugal(_bounded), _PAIR), "near")
        wanted = _small(self._wanted(near))
        ids = wanted.select(F.col("doc_id").alias("id")).distinct()
        texts = self.rows.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
        blobs = texts.mapInArrow(frugal(_blobs(self.words)), "cid long, blob binary").join(wanted.select("cid"), "cid", "left_semi")
        blobs = scratch(blobs.groupBy("cid").agg(F.first("blob").alias("blob")), "blobs")
        return scratch(self._both(near, blobs, "blob").mapInArrow(frugal(_overlaps), _PAIR + ", common long"), "compared")


def _linked(common: Column) -> Column:
    return OVER * common >= UNDER * (F.col("na") + F.col("nb"))


def components(edges: DataFrame) -> DataFrame:
    """``cid, comp``: of every node of ``edges`` (a, b), the smallest node it is connected with.

    Alternates the large-star and small-star steps until nothing changes.
    """
    edges = scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = scratch(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        edges = scratch(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("cid"), F.col("v").alias("comp"))


def _may_link(x: str, y: str) -> Column:
    """By size, and by what is left from each one's position on."""
    nx, ny = F.shiftright(x, 32), F.shiftright(y, 32)
    ix, iy = F.col(x).bitwiseAND(0xFFFFFFFF), F.col(y).bitwiseAND(0xFFFFFFFF)
    need = UNDER * (nx + ny)
    return (4 * F.least(nx, ny) >= 3 * F.greatest(nx, ny)) & (OVER * (nx - ix) >= need) & (OVER * (ny - iy) >= need)


def _pairs(rows: DataFrame, x: str, at_x: str, y: str, at_y: str) -> DataFrame:
    swap = F.col(x) > F.col(y)
    a, b = F.least(x, y), F.greatest(x, y)
    na, nb = F.when(swap, F.shiftright(at_y, 32)).otherwise(F.shiftright(at_x, 32)), F.when(swap, F.shiftright(at_x, 32)).otherwise(F.shiftright(at_y, 32))
    return rows.where((F.col(x) != F.col(y)) & _may_link(at_x, at_y)).select(a.alias("a"), b.alias("b"), na.alias("na"), nb.alias("nb")).distinct()


def _derived(pairs: DataFrame, related: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links that overlaps with a common pivot prove, pairs that they leave open)."""
    hint = _small(related)
    of = lambda side: hint.select(F.col("cid").alias(side), F.col("pivot").alias(f"pivot_{side}"), F.col("common").alias(f"common_{side}"), F.col("n_pivot").alias(f"n_pivot_{side}"))
    known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    same = F.coalesce(F.col("pivot_a") == F.col("pivot_b"), F.lit(False))
    lowest = F.col("common_a") + F.col("common_b") - F.col("n_pivot_a")
    highest = F.least("common_a", "common_b") + F.least(F.col("na") - F.col("common_a"), F.col("nb") - F.col("common_b"))
    known = known.select("a", "b", "na", "nb", (same & _linked(lowest)).alias("yes"), (same & ~_linked(highest)).alias("no"))
    known = scratch(known, "derived")
    return known.where("yes").select("a", "b"), known.where("not yes and not no").select("a", "b", "na", "nb")


def _related(compared: DataFrame) -> DataFrame:
    """``cid, common, pivot, n_pivot``: of each set, its largest overlap with a pivot (either set of a pair)."""
    ways = [compared.select(F.col(x).alias("cid"), "common", F.col(y).alias("pivot"), F.col(f"n{y}").alias("n_pivot")) for x, y in ("ab", "ba")]
    best = ways[0].union(ways[1]).groupBy("cid").agg(F.max(F.struct("common", "pivot", "n_pivot")).alias("best"))
    return scratch(best.select("cid", "best.*"), "related")


def _open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of lists with several components; ``is_main`` for those of a list's largest one."""
    labelled = lists.select("token", "cid", "at").join(_small(labels), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    bounds = labelled.withColumns({"low": F.expr("min(comp) over (partition by token)"), "high": F.expr("max(comp) over (partition by token)")}).where("low < high")
    sized = bounds.withColumn("size", F.expr("count(*) over (partition by token, comp)")).withColumn("main", F.expr("max(struct(size, comp)) over (partition by token)"))
    return sized.select("token", "cid", "at", "comp", (F.col("comp") == F.col("main.comp")).alias("is_main"))


def jaccard_components(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Null and empty texts have no shingles and are linked with nothing: their
    component is their own id. Repeated rows are one set. Where a component has
    rows of null ids only, its id is null. Other columns are not looked at; an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = scratch(rows.mapInArrow(frugal(_sets(words)), _SETS), "sets")
    sets = made.where("n is not null").select("doc_id", "n", "cid", "sketch")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(made.where("token is not null")))  # FREQUENT entries at most: 5 MB
    corpus = Sets(rows, sets, words)

    entries = rows.select("text").mapInArrow(frugal(_prefixes(frequent, words)), _ENTRIES)
    ends = {"first": F.expr("min(cid) over (partition by token)"), "last": F.expr("max(cid) over (partition by token)")}
    met = entries.withColumns(ends | {"smallest": F.expr("min(shiftright(at, 32)) over (partition by token)")}).where("first < last")
    # Entries that are too far back for a partner of the list's smallest size are skipped, and lists of one set then.
    n, left = F.shiftright("at", 32), F.shiftright("at", 32) - F.col("at").bitwiseAND(0xFFFFFFFF)
    met = met.where((OVER * left >= UNDER * (n + F.col("smallest"))) & (4 * left >= 3 * n)).withColumns(ends).where("first < last")
    lists = scratch(met.select("token", "cid", "at"), "lists")

    # Each list's first pivot: the set for which the shingle comes earliest, as it has the fewest shingles of its own.
    first = lists.withColumn("pivot", F.expr(f"min(struct({_PLACE}, cid, at)) over (partition by token)"))
    first = first.select("token", "cid", "at", F.col("pivot.cid").alias("pivot"), F.col("pivot.at").alias("pivot_at"))
    asked = scratch(_pairs(first, "pivot", "pivot_at", "cid", "at"), "pairs")
    compared = corpus.compare(asked)
    links = compared.where(_linked(F.col("common"))).select("a", "b")
    related = _related(compared)
    labels = scratch(components(links), "labels")

    # Further pivots of lists that lie in several components, from the list's largest, for a few of each set's lists.
    for turn in range(PIVOTS):
        lists = scratch(_open_lists(lists, labels), "lists")
        among = lists.withColumn("pivot", F.expr(f"min(case when is_main then struct(xxhash64(cid, {turn}), cid, at) end) over (partition by token)"))
        outside = among.where("not is_main").select("cid", F.struct(F.xxhash64("token", F.lit(turn)), "at", F.col("pivot.cid").alias("pivot"), F.col("pivot.at").alias("pivot_at")).alias("ask"))
        outside = outside.where(_may_link("ask.at", "ask.pivot_at")).groupBy("cid").agg(F.array(F.min("ask"), F.max("ask")).alias("asks")).select("cid", F.explode("asks").alias("ask"))
        again = _pairs(outside.select("cid", "ask.at", "ask.pivot", "ask.pivot_at"), "pivot", "pivot_at", "cid", "at")
        again = scratch(again.join(asked.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        if again.isEmpty():
            break
        proved, unsure = _derived(again, related)
        links = links.union(proved).union(corpus.compare(unsure).where(_linked(F.col("common"))).select("a", "b"))
        labels = scratch(components(links), "labels")
        asked = asked.union(again)

    # What is left: all pairs of a list in different components, one of them not the list's largest.
    lists = scratch(_open_lists(lists, labels), "lists")
    rest = _pairs(_open_pairs(lists), "x", "at_x", "cid", "at").join(asked.select("a", "b"), ["a", "b"], "left_anti")
    proved, unsure = _derived(scratch(rest, "pairs"), related)
    links = links.union(proved).union(corpus.compare(unsure).where(_linked(F.col("common"))).select("a", "b"))
    labels = scratch(components(links), "labels")

    classes = sets.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("first"))
    classes = classes.join(_small(labels), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    classes = scratch(classes, "classes")
    firsts = classes.groupBy("comp").agg(F.min("first").alias("component"))
    by_class = classes.join(firsts, "comp").select("cid", "component")
    return sets.select("doc_id", "n", "cid").join(by_class, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def _block(size: Column) -> Column:
    """Sets that link have sizes in one block or in neighbouring ones."""
    return F.floor(F.log(size) / F.lit(math.log(4 / 3))).cast("int")


def _open_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of lists' entries in different components, one of them not of the list's largest, that size and position leave possible."""
    n, left = F.shiftright("at", 32), F.shiftright("at", 32) - F.col("at").bitwiseAND(0xFFFFFFFF)
    largest = F.least(F.floor(4 * n / 3), F.floor(OVER * left / UNDER) - n)  # of the partners that the position leaves
    smallest = F.ceil(3 * n / 4)
    one = lists.where("not is_main").where(largest >= smallest)
    one = one.select(F.col("token").alias("listed"), F.col("cid").alias("x"), F.col("at").alias("at_x"), F.col("comp").alias("comp_x"), F.explode(F.sequence(_block(smallest), _block(largest))).alias("of_size"))
    lists = lists.withColumn("block", _block(F.shiftright("at", 32)))
    return one.join(lists, (F.col("listed") == F.col("token")) & (F.col("of_size") == F.col("block")) & (F.col("comp_x") != F.col("comp")) & (F.col("is_main") | (F.col("x") < F.col("cid"))) & _may_link("at_x", "at"))


ORACLE_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as shingle from d
), n as (
  select d.doc_id, coalesce(c, 0) as n from d left join (select doc_id, count(*) as c from s group by 1) using (doc_id)
), p as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2
), e as (
  select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 75 * (nx.n + ny.n - c)
), r as (
  select doc_id, doc_id as reached from n union select r.doc_id, e.y from r join e on e.x = r.reached
)
select n.doc_id, cast(n.n as bigint) as n_shingles, min(reached) as component_id from n join r using (doc_id) group by 1, 2
"""
