"""Stores: tables in folders, replaced as a whole or appended to, and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.events import publishable


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder that the cluster shares (``spark.checkpoint.dir``) and read back: this cuts lineage."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="keelson-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` dealt by ranges of an order and written, with ``__range`` (ascending) and ``__at``, a row's place in it."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch(dealt.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranges")


def numbered(df: DataFrame, name: str, *order: str, first: int = 1) -> DataFrame:
    """``df`` with ``name``: the rows' numbers in an order, from ``first`` on, without a gap.

    Rows are dealt in ranges of the order; a range begins where the counts of
    those before it end, so no task sees more than its range.
    """
    dealt = in_ranges(df, *order)
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("n"))  # a row a partition
    before = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))
    return dealt.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__at") + first).drop("__range", "__at", "__before")


class Store:
    """A table under a folder, changed by versions: folders ``v1, v2, ...``, each a replacement or an addition.

    The table is the last replacement and what was added since. A version is
    written aside and renamed to the next free number, which fails where another
    writer took it; so versions are seen whole, and none is lost or overwritten.
    It asks for a file system that renames folders atomically.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        root = self._path(self.path)
        names = [s.getPath().getName() for s in self._files.listStatus(root)] if self._files.exists(root) else []
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def _current(self, versions: list[int]) -> list[str]:
        """The folders that make up the table, the oldest first."""
        parts: list[str] = []
        for n in reversed(versions):
            parts.insert(0, f"{self.path}/v{n}")
            if self._files.exists(self._path(f"{self.path}/v{n}/_replaces")):
                break
        return parts

    def read(self) -> DataFrame:
        """The table as it is now; empty if there is none."""
        parts = self._current(self._versions())
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*parts)

    def _write(self, rows: DataFrame, replaces: bool) -> str:
        """``rows`` in a folder of their own, not yet part of the table."""
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        empty = self.spark.createDataFrame([], self.schema)
        empty.unionByName(rows, allowMissingColumns=True).select(*empty.columns).write.parquet(aside)
        if replaces:
            self._files.create(self._path(f"{aside}/_replaces"), False).close()
        return aside

    def _commit(self, aside: str, version: int) -> bool:
        """Make a folder the version of that number; false if there is one."""
        target = self._path(f"{self.path}/v{version}")
        if self._files.exists(target):
            return False
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(self._path(aside), target, options)
        except Py4JJavaError:
            if self._files.exists(target) and self._files.exists(self._path(aside)):
                return False
            raise
        return True

    def _next(self) -> int:
        return (self._versions() or [0])[-1] + 1

    def _publish(self, rows: DataFrame, replaces: bool) -> DataFrame:
        aside = self._write(rows, replaces)
        while not self._commit(aside, self._next()):
            pass  # each turn another writer got on
        return self.read()

    def replace(self, rows: DataFrame) -> DataFrame:
        """Readers see the old table or the new one, never a mixture."""
        return self._publish(rows, True)

    def append(self, rows: DataFrame) -> DataFrame:
        """Added as one: all rows or none become visible together with the old ones."""
        return self._publish(rows, False)

    def change(self, rows: Callable[[DataFrame], DataFrame], replaces: bool = False) -> DataFrame:
        """Add (or put in place) what ``rows`` makes of the table; made again if another writer changed it meanwhile."""
        while True:
            versions = self._versions()
            parts = self._current(versions)
            now = self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)
            if self._commit(self._write(rows(now), replaces), (versions or [0])[-1] + 1):
                return self.read()

    def read_or_build(self, build: Callable[[], DataFrame]) -> DataFrame:
        """The table, built if there is none yet; of writers that build at once, the first one's counts for all."""
        if not self._versions():
            self._commit(self._write(build(), True), 1)
        return self.read()

    def clear(self) -> DataFrame:
        return self.replace(self.spark.createDataFrame([], self.schema))


class KeyedStore(Store):
    """A table of unique keys, changed row by row: a change writes what it changes, and reading merges.

    Every version is dealt into ``buckets`` folders by a hash of the columns ``by``
    (the key, or some of it), so that a look-up of these reads their buckets only. Of a key the row of the newest version
    counts; a removal is a row too. ``compact`` replaces the versions by what they
    amount to once changes outweigh ``SHARE`` of the rows, and ``reap`` deletes what
    no reader needs any more.
    """

    SHARE = 0.25

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 16, by: list[str] | None = None):
        super().__init__(spark, path, f"{schema}, __removed boolean, __bucket int")
        self.keys, self.buckets, self.by = keys, buckets, by or keys
        self.columns = [c for c in self.spark.createDataFrame([], self.schema).columns if not c.startswith("__")]

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, replaces: bool) -> str:
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        empty = self.spark.createDataFrame([], self.schema)
        whole = empty.unionByName(rows, allowMissingColumns=True).select(*empty.columns).withColumn("__bucket", self._bucket())
        whole.repartition(self.buckets, "__bucket").write.partitionBy("__bucket").parquet(aside)
        if replaces:
            self._files.create(self._path(f"{aside}/_replaces"), False).close()
        return aside

    def _rows(self, parts: list[str]) -> DataFrame:
        """All rows of some versions, each with the number of its version."""
        if not parts:
            return self.spark.createDataFrame([], f"{self.schema}, __version int")
        each = [self.spark.read.schema(self.schema).parquet(p).withColumn("__version", F.lit(int(p.rsplit("/v", 1)[1]))) for p in parts]
        return reduce(DataFrame.unionByName, each)

    def _merged(self, rows: DataFrame) -> DataFrame:
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct("__removed", *(c for c in self.columns if c not in self.keys)), "__version").alias("row"))
        return newest.where(~F.coalesce("row.__removed", F.lit(False))).select(*(F.col(c) if c in self.keys else F.col(f"row.{c}").alias(c) for c in self.columns))

    def read(self) -> DataFrame:
        return self._merged(self._rows(self._current(self._versions())))

    def get(self, wanted: DataFrame) -> DataFrame:
        """The rows that have the ``by`` columns of ``wanted``: only their buckets are read."""
        keys = wanted.select(*self.by).distinct()
        buckets = [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # at most ``buckets``
        rows = self._rows(self._current(self._versions())).where(F.col("__bucket").isin(buckets) if buckets else F.lit(False))
        return self._merged(rows.join(keys, self.by, "left_semi"))

    def put(self, rows: DataFrame, order: str | None = None) -> None:
        """Add rows or put them in place of those of their keys; of rows of one key the last by ``order`` counts (else any)."""
        rest = [c for c in self.columns if c not in self.keys]
        one = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*self.keys, "row.*") if order else rows.dropDuplicates(self.keys)
        self._add(one.select(*self.columns).withColumn("__removed", F.lit(False)))

    def remove(self, keys: DataFrame) -> None:
        self._add(keys.select(*self.keys).distinct().withColumn("__removed", F.lit(True)))

    def apply(self, changes: DataFrame) -> None:
        """``graph.changes`` as one version: readers see all of them or none."""
        self._add(changes.select(*self.columns, (F.col("op") == "removed").alias("__removed")))

    def _add(self, rows: DataFrame) -> None:
        aside = self._write(rows, False)
        while not self._commit(aside, self._next()):
            pass

    def compact(self, always: bool = False) -> bool:
        """Put one version in place of all, if what was changed since the last is much; false if it is left, also to another writer."""
        versions = self._versions()
        parts = self._current(versions)
        if len(parts) < 2:
            return False
        sizes = self._rows(parts).groupBy("__version").count().orderBy("__version").collect()  # a row a version
        if not always and sum(r["count"] for r in sizes[1:]) <= self.SHARE * sizes[0]["count"]:
            return False
        return self._commit(self._write(self._merged(self._rows(parts)), True), versions[-1] + 1)

    def reap(self, keep: int = 1) -> int:
        """Delete the versions that the newest replacement made void, but for the last ``keep`` of them, for readers under way."""
        versions = self._versions()
        void = [n for n in versions if f"{self.path}/v{n}" not in self._current(versions)]
        gone = void[: len(void) - keep] if keep else void
        for n in gone:
            self._files.delete(self._path(f"{self.path}/v{n}"), True)
        return len(gone)


def publish(store: Store, events: DataFrame) -> DataFrame:
    """Append events after checking them; their numbers continue the log's, also when several writers publish at once."""
    checked = scratch(publishable(events), "published")

    def fresh(log: DataFrame) -> DataFrame:
        last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))  # one row
        return numbered(checked, "n", "ts", "agent", "entity_id").join(F.broadcast(last)).withColumn("seq", (F.col("last") + F.col("n")).cast("long")).drop("n", "last")

    return store.change(fresh)
