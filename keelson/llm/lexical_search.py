"""Ranked lexical search: documents by an integer BM25, with accumulators of short lists inside a skipping walk.

Documents are indexed in *shards* by the partitions that hold them: a shard has
its documents' ids and lengths, and a posting list a term. The corpus' counts are
sums over shards. A term's lists meet the items that ask for it by a join on the
term, and each shard answers the items of a block in one task, by both plans at
once:

* short lists are taken term at a time: their contributions are summed into one
  accumulator list, which from then on is one more list with a bound;
* that list and the long ones are walked document at a time, in windows of
  documents. A window whose bounds sum to less than the score of the last of the
  best found so far is skipped; within one, lists are read whole only while those
  left could reach that score alone, and the others are looked up for the
  documents that still can.

Bounds are exact maxima, so no document is lost. A shard gives its best for each
item, and a window over their union cuts them to the best of all.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, binaries, frugal, rows_to_batches, scratch, small_batches

BEST = 50
#: A shard ends at so many documents or (document, term) occurrences.
SHARD_DOCS, SHARD_WORDS = 1 << 16, 5_000_000
#: Items that a task answers at a time.
BLOCK = 1000
#: Terms of items up to which an index is limited to them, as the list goes to every task; beyond it all terms are indexed.
MOST_TERMS = 500_000
#: A list of at most this share of a shard's documents is short.
SHORT = 1 / 64
#: Documents of a window.
WINDOW = 2048

#: Letters, digits and what is not ASCII stay, A-Z as a-z; all else parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

INDEX = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("term", T.StringType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_terms", T.LongType()),
        T.StructField("a", T.BinaryType()),
        T.StructField("b", T.BinaryType()),
        T.StructField("c", T.BinaryType()),
    ]
)
_RANKED = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE_SQL = f"""
with words as (
  select rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) as term from (select *, row_number() over () as rid from documents)
), asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) as term from benchmark
), lengths as (select rid, doc_id, count(*) as n from words group by 1, 2), corpus as (select count(*) as n_docs, sum(n)::bigint as n_all from lengths),
counts as (select rid, term, count(*) as tf from words where term in (select term from asked) group by 1, 2),
weights as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from counts, corpus group by term, n_docs),
scored as (
  select item_id, rid, l.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_all))))::bigint as score
  from asked join counts using (term) join weights using (term) join lengths l using (rid), corpus group by 1, 2, 3
), ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls first)::int as rank, doc_id, score from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= {BEST}
"""


def terms_of(text: bytes | None) -> list[bytes]:
    """A text's terms in order, of its UTF-8 bytes."""
    return (text or b"").translate(_TERM_BYTES).split()


class _Shard:
    """A shard that is being gathered."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths, self.words, self.counts = array("i"), array("i"), array("i")

    def rows(self, number: int, terms: list[bytes]) -> Iterator[tuple]:
        """The documents' row, of a null term, and a row a list: positions in the shard and occurrences."""
        lengths = np.frombuffer(self.lengths, np.int32)
        missing = np.array([i is None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        yield number, None, int((lengths > 0).sum()), int(lengths.sum(dtype=np.int64)), ids.tobytes(), lengths.tobytes(), missing.tobytes()
        if not self.words:
            return
        words = np.frombuffer(self.words, np.int32)
        where = np.repeat(np.arange(len(self.ids), dtype=np.int64), np.frombuffer(self.counts, np.int32))
        keys, tfs = np.unique((words.astype(np.int64) << 32) | where, return_counts=True)
        lists, begins = np.unique(keys >> 32, return_index=True)
        docs, tfs = (keys & 0xFFFFFFFF).astype(np.int32), tfs.astype(np.int32)
        for term, begin, end in zip(lists.tolist(), begins.tolist(), [*begins[1:].tolist(), len(keys)], strict=True):
            yield number, terms[term].decode(), end - begin, int(tfs[begin:end].sum(dtype=np.int64)), docs[begin:end].tobytes(), tfs[begin:end].tobytes(), None


def index(docs: DataFrame, text: str = "text", terms: list[str] | None = None, shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The shards' documents and posting lists (``INDEX``) of ``docs`` (``doc_id`` and ``text``), of ``terms`` only if given.

    Every row is a document, also a repeated one or one of a null id; a null or
    empty text has no terms. Other columns are not looked at. No task holds more
    than a shard and one text.
    """
    small_batches(docs.sparkSession)
    wanted, numbers = arrow_schema(INDEX), None if terms is None else {t.encode(): i for i, t in enumerate(terms)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        own: dict[bytes, int] = {}
        shard = _Shard()
        for batch in batches:
            for doc_id, source in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), strict=True):
                words = terms_of(source)
                if numbers is None:
                    found = [own.setdefault(w, len(own)) for w in words]
                else:
                    found = [numbers[w] for w in words if w in numbers]
                shard.ids.append(doc_id)
                shard.lengths.append(len(words))
                shard.counts.append(len(found))
                shard.words.extend(found)
                if len(shard.ids) >= shard_docs or len(shard.words) >= shard_words:
                    yield from shard.rows(number, list(own if numbers is None else numbers))
                    shard, own, number = _Shard(), {}, number + 1
        if shard.ids:
            yield from shard.rows(number, list(own if numbers is None else numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows_to_batches(rows(batches), wanted, lambda r: len(r[4]) + len(r[5]))

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(frugal(run), INDEX)


class _List:
    """Postings in order of documents, with their contributions and the largest of each window."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray, borders: np.ndarray):
        self.docs, self.scores = docs, scores
        self.at = np.searchsorted(docs, borders)
        self.bounds = np.zeros(len(borders) - 1, np.int64)
        full = np.flatnonzero(self.at[1:] > self.at[:-1])
        if len(full):
            self.bounds[full] = np.maximum.reduceat(scores, self.at[full])

    def kth(self, k: int) -> int:
        """The score that at least ``k`` documents have."""
        return int(np.partition(self.scores, -k)[-k]) if len(self.scores) >= k else 0


def _summed(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: the documents of some lists in order, and the sums of their contributions."""
    docs, scores = (np.concatenate(x) for x in zip(*lists, strict=True))
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    begins = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    return docs[begins], np.add.reduceat(scores[order], begins)


class ShardSearch:
    """One shard's lists, for many items. ``skipped`` and ``read`` count windows."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, short: float = SHORT, window: int = WINDOW):
        self.n, self.window = len(ids), window
        self.order = np.lexsort((ids, missing == 0))  # nulls first
        self.place = np.empty(self.n, np.int64)
        self.place[self.order] = np.arange(self.n)
        self.borders = np.arange(0, self.n + window, window)
        self.most_short = self.n * short
        self.short: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.long: dict[str, _List] = {}
        self.kths: dict[tuple[str, int], int] = {}
        self.skipped = self.read = 0

    def add(self, term: str, docs: np.ndarray, scores: np.ndarray) -> None:
        docs, scores = docs[scores > 0], scores[scores > 0]
        if len(docs) <= self.most_short:
            self.short[term] = docs, scores
        else:
            self.long[term] = _List(docs, scores, self.borders)

    def _kth(self, term: str, k: int) -> int:
        if (term, k) not in self.kths:
            self.kths[term, k] = self.long[term].kth(k)
        return self.kths[term, k]

    def best(self, terms: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the ``k`` best documents: higher scores, then smaller ids."""
        lists = [self.long[t] for t in terms if t in self.long]
        floor = max((self._kth(t, k) for t in terms if t in self.long), default=0)
        short = [self.short[t] for t in terms if t in self.short and len(self.short[t][0])]
        if short:
            summed = _List(*_summed(short), self.borders)
            lists.append(summed)
            floor = max(floor, summed.kth(k))
        floor = max(floor, 1)
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bounds = np.stack([one.bounds for one in lists])
        could = bounds.sum(axis=0)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for w in range(len(could)):
            if could[w] < floor:
                self.skipped += 1
                continue
            self.read += 1
            found, got = self._window(lists, bounds[:, w], w, floor)
            if len(found):
                docs, scores = np.concatenate([docs, found]), np.concatenate([scores, got])
            if len(docs) >= k:
                kept = np.lexsort((self.place[docs], -scores))[:k]
                docs, scores = docs[kept], scores[kept]
                floor = max(floor, int(scores[-1]))
        return docs, scores

    def _window(self, lists: list[_List], bounds: np.ndarray, w: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a window, and their scores, that have ``floor`` at least."""
        first = self.borders[w]
        sums = np.zeros(self.window, np.int64)
        order = np.argsort(-bounds, kind="stable")
        left = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
        at = 0
        while at < len(order) and left[at] >= floor:
            one = lists[order[at]]
            begin, end = one.at[w], one.at[w + 1]
            sums[one.docs[begin:end] - first] += one.scores[begin:end]
            at += 1
        docs = np.flatnonzero((sums > 0) & (sums + left[at] >= floor))
        scores = sums[docs]
        for j in range(at, len(order)):
            if not len(docs) or not bounds[order[j]]:
                break
            one = lists[order[j]]
            own = one.docs[one.at[w] : one.at[w + 1]]
            place = np.minimum(np.searchsorted(own, docs + first), len(own) - 1)
            scores = scores + np.where(own[place] == docs + first, one.scores[one.at[w] : one.at[w + 1]][place], 0)
            alive = scores + left[j + 1] >= floor
            docs, scores = docs[alive], scores[alive]
        reached = scores >= floor
        return docs[reached] + first, scores[reached]


def _answer(n_docs: int, n_all: int, k: int):
    """A group of one shard's lists, with their items, to the shard's best of each item."""
    wanted = arrow_schema(_RANKED)

    def run(group: pa.Table) -> pa.Table:
        terms, a, b, c = (group.column(x).to_pylist() for x in ("term", "a", "b", "c"))
        own = terms.index(None)
        ids, lengths = np.frombuffer(a[own], np.int64), np.frombuffer(b[own], np.int32).astype(np.int64)
        missing = np.frombuffer(c[own], np.uint8)
        measure = 50 + (50 * lengths * n_docs) // n_all
        shard = ShardSearch(ids, missing)
        asked: dict[int | None, list[str]] = {}
        for term, docs, tfs, weight, items in zip(terms, a, b, group.column("w").to_pylist(), group.column("items").to_pylist(), strict=True):
            if term is not None:
                docs, tfs = np.frombuffer(docs, np.int32).astype(np.int64), np.frombuffer(tfs, np.int32).astype(np.int64)
                shard.add(term, docs, weight * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * measure[docs])))
                for item in items:
                    asked.setdefault(item, []).append(term)
        out: list[tuple] = []
        for item, wants in asked.items():
            docs, scores = shard.best(sorted(wants), k)
            out += [(item, None if missing[d] else int(ids[d]), s) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, wanted, strict=True)], schema=wanted)

    return run


def _asked(items: DataFrame, text: str) -> DataFrame:
    """``item_id, term`` of items, each pair once."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(low, F.lit(_TERM), F.lit(0))).alias("term")).distinct()


def search(docs: DataFrame, items: DataFrame, text: str = "text", k: int = BEST, block: int = BLOCK, **sizes: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``k`` best documents, by the README's integer formula.

    Rows of ``items`` that share an ``item_id`` (also a null one) are one item
    with the terms of all. Items and documents without terms, and items whose
    terms no document has, have no rows. Equal scores go by ``doc_id``, null
    ids first; rows that repeat an id are ranked each. Items are answered in blocks
    by every shard, so both tables may grow.
    """
    asked = scratch(_asked(items, text), "asked")
    if asked.select("term").distinct().count() <= MOST_TERMS:
        terms = [r[0] for r in asked.select("term").distinct().collect()]  # bounded by the line above
    else:
        terms = None
    shards = scratch(index(docs, text, terms, **sizes), "shards")
    of_docs = shards.where("term is null")
    n_docs, n_all = of_docs.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    n_blocks = -(-asked.select("item_id").distinct().count() // block) or 1
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.sum("n_docs") + 1).cast("double"))).cast("long")
    weights = shards.where("term is not null").groupBy("term").agg(weight.alias("w"))
    wants = asked.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).alias("block"), "term").agg(F.collect_list(F.struct("item_id")).alias("items"))
    wants = scratch(wants.join(weights, "term").select("block", "term", "w", F.col("items.item_id").alias("items")), "wants")
    lists = shards.where("term is not null").join(wants, "term").select("shard", "block", "term", "a", "b", "c", "w", "items")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>"))
    whole = of_docs.select("shard", every.alias("block"), "term", "a", "b", "c", F.lit(None).cast("long").alias("w"), F.lit(None).cast("array<long>").alias("items"))
    answered = lists.unionByName(whole).groupBy("shard", "block").applyInArrow(_answer(n_docs, n_all, k), _RANKED)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc()))
    return answered.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
