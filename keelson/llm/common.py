"""Helpers shared by the operators: scratch tables, Arrow batches, word caches.

``scratch`` writes an intermediate table to the folder that every executor and
the driver share (``spark.checkpoint.dir``), which cuts lineage: if an executor
is lost later, its tasks reread the table instead of recomputing the past.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that Python functions return at a time, and bytes after which they return earlier.
BATCH_ROWS = 4096
BATCH_BYTES = 8 << 20
#: Rows that Spark hands Python functions at a time at most: texts are long rows.
TEXT_ROWS = 512


def scratch_root(spark: SparkSession) -> str:
    """The shared folder. Only a session of one process (``local``) may go without; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="keelson-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column: str, n: int):
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Lower the session's Arrow batches to ``rows``.

    It lasts, as what an operator returns is run later; a lower setting stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


#: What this worker keeps between tasks, and whose tasks it keeps it for.
_KEPT: dict[tuple[str, str], object] = {}
_OWNER = [""]


def kept(make: Callable[[str], object], path: str):
    """``make(path)``, which a Python worker keeps until it gets a task of another owner."""
    key = (make.__qualname__, path)
    if key not in _KEPT:
        _KEPT[key] = make(path)
    return _KEPT[key]


def let_go(owner: str) -> None:
    """A task of ``owner`` begins: what the worker kept for another one goes."""
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        if _KEPT:
            _KEPT.clear()
            give_back()


def give_back() -> None:
    """Return unused memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def frugal(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function``, which gives a task's memory back to the system at its end: Python workers are kept for later stages.

    What they ``kept`` for an ``owner`` (the function's module) other than this one goes at its start.
    """
    owner = owner or function.__module__

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(owner)
        yield from function(batches)
        give_back()

    return run


def in_groups(texts: Iterable[bytes | None], most_bytes: int = 1 << 20) -> Iterator[list[bytes | None]]:
    """Runs of texts of about ``most_bytes`` in all."""
    group, held = [], 0
    for one in texts:
        group.append(one)
        held += len(one or b"")
        if held >= most_bytes:
            yield group
            group, held = [], 0
    if group:
        yield group


class WordMemo:
    """Numbers of words, computed once a task: ``compute`` gives a row of ``width`` for each of a list of words.

    At most ``most_words`` of ``most_bytes`` in all are remembered, besides the words of one text.
    """

    def __init__(self, width: int, compute: Callable[[list[bytes]], np.ndarray], most_words: int = 100_000, most_bytes: int = 16 << 20):
        self.compute, self.most_words, self.most_bytes = compute, most_words, most_bytes
        self.number: dict[bytes, int] = {}
        self.held, self.table = 0, np.zeros((1024, width))

    def learn(self, texts: list[list[bytes]]) -> None:
        """Compute what is not yet known of several texts' words, at once."""
        words = set().union(*texts)
        new = [w for w in words if w not in self.number]
        if new:
            if len(self.number) + len(new) > self.most_words or self.held > self.most_bytes:
                self.number, self.held, new = {}, 0, list(words)
            first = len(self.number)
            if first + len(new) > len(self.table):
                self.table = np.concatenate([self.table[:first], np.zeros((max(first, 1024) + len(new), self.table.shape[1]))])
            self.table[first : first + len(new)] = self.compute(new)
            self.number.update(zip(new, range(first, first + len(new)), strict=True))
            self.held += sum(map(len, new))

    def of(self, words: list[bytes]) -> np.ndarray:
        """A row for each of ``words``."""
        self.learn([words])
        return self.table[np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))]


def binaries(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def rows_to_batches(rows: Iterable[tuple], schema: pa.Schema, weigh: Callable[[tuple], int] = lambda row: 0) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from an iterator of tuples."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if len(held) >= BATCH_ROWS or weight >= BATCH_BYTES:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
