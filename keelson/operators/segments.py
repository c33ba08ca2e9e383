"""Scans along an order that no single task has to see whole.

Rows of a key usually fit a task, and a window over the key is the best plan. A
key of more than ``HOT_ROWS`` rows is cut into ranges of the order instead: each
range is scanned by itself, and what a range hands to others of its key (its
first or last value) is carried over by a window over the ranges, of which there
are few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import in_ranges, scratch

HOT_ROWS = 1_000_000


def split_by_heat(rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys (null is one) of up to ``hot_rows`` rows, and those of the others, if there are any."""
    found = scratch(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows).select(*(F.col(k).alias(f"__hot{i}") for i, k in enumerate(keys))), "hot")
    if found.isEmpty():
        return rows, None
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__hot{i}")) for i, k in enumerate(keys)))
    found = F.broadcast(found)  # a row for hot_rows rows at least
    return rows.join(found, same, "left_anti"), rows.join(found, same, "left_semi")


def _carried(dealt: DataFrame, keys: list[str], summary: Column, take) -> DataFrame:
    """``dealt`` with ``__carry``: what ``take`` makes of the summaries of a key's ranges."""
    ranges = dealt.groupBy(*keys, "__range").agg(summary.alias("__own"))
    ranges = ranges.withColumn("__carry", take("__own", Window.partitionBy(*keys).orderBy("__range")))
    here = scratch(ranges.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__range").alias("__r"), "__carry"), "carry")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.col("__range") == F.col("__r"))
    return dealt.join(here, same).drop("__r", *(f"__k{i}" for i in range(len(keys))))


def with_next(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with ``name``: ``value`` of the next row of the key; null for the last."""
    following = lambda *by: F.lead(value).over(Window.partitionBy(*by).orderBy(*order))
    cold, hot = split_by_heat(rows, keys, hot_rows)
    found = cold.withColumn(name, following(*keys))
    if hot is None:
        return found
    dealt = in_ranges(hot, *keys, *order)
    first = F.min_by(F.struct(value), F.struct(*order))
    dealt = _carried(dealt, keys, first, lambda own, ranges: F.lead(own).over(ranges))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order)
    last = F.lead(F.lit(1)).over(inside).isNull()
    own = F.when(last, F.col("__carry")[value]).otherwise(F.lead(value).over(inside))
    return found.unionByName(dealt.withColumn(name, own).select(*rows.columns, name))


def with_last(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with ``name``: the last ``value`` that is not null, of the row itself and those before it of its key."""
    cold, hot = split_by_heat(rows, keys, hot_rows)
    so_far = lambda *by: F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = cold.withColumn(name, so_far(*keys))
    if hot is None:
        return found
    dealt = in_ranges(hot, *keys, *order)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    dealt = _carried(dealt, keys, last, lambda own, ranges: F.last(own, ignorenulls=True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)))
    return found.unionByName(dealt.withColumn(name, F.coalesce(so_far(*keys, "__range"), F.col("__carry"))).select(*rows.columns, name))


# Automata: folds of actions that a table of transitions describes


class Transitions:
    """A state machine whose runs compose: a run of actions is, for each state to begin with, the state after it and the actions refused.

    ``table`` has the state that each action needs and the one that it gives. An
    action in any other state is refused and changes nothing.
    """

    #: Actions that are gathered in one array at most.
    BLOCK = 1024

    def __init__(self, states: list[str], table: dict[str, tuple[str, str]]):
        self.states, self.table = states, table

    def _after(self, at: Column, action: Column) -> Column:
        """The state's number after an action; null if it is refused."""
        number = self.states.index
        tests = [((action == a) & (at == number(needs)), F.lit(number(gives))) for a, (needs, gives) in self.table.items()]
        found = reduce(lambda case, one: case.when(*one), tests[1:], F.when(*tests[0]))
        return found.otherwise(F.lit(None).cast("int"))

    def _none(self) -> Column:
        """The run of no actions."""
        n = len(self.states)
        return F.struct(F.array(*map(F.lit, range(n))).alias("to"), F.array(*[F.lit(0).cast("long")] * n).alias("refused"))

    def of_actions(self, actions: Column) -> Column:
        """The run of an array of actions in order."""

        def add(run: Column, action: Column) -> Column:
            to = F.transform(run["to"], lambda at: F.coalesce(self._after(at, action), at))
            refused = F.transform(run["to"], lambda at, i: F.get(run["refused"], i) + self._after(at, action).isNull().cast("long"))
            return F.struct(to.alias("to"), refused.alias("refused"))

        return F.aggregate(actions, self._none(), add)

    def composed(self, runs: Column) -> Column:
        """The run of an array of runs in order."""

        def add(run: Column, then: Column) -> Column:
            to = F.transform(run["to"], lambda at: F.get(then["to"], at))
            refused = F.transform(run["to"], lambda at, i: F.get(run["refused"], i) + F.get(then["refused"], at))
            return F.struct(to.alias("to"), refused.alias("refused"))

        return F.aggregate(runs, self._none(), add)

    def runs(self, log: DataFrame, keys: list[str], order: str, action: str, hot_rows: int = 100_000) -> DataFrame:
        """``keys``, ``run`` and ``n_actions`` of each key.

        A hot key's actions are folded in blocks of ``BLOCK``, then by ranges of
        the order, then by key, so no array grows with it.
        """
        part = F.struct(F.col(order).alias("o"), F.col(action).alias("a"))
        ordered = lambda entry: F.array_sort(F.collect_list(entry))
        cold, hot = split_by_heat(log.select(*keys, order, action), keys, hot_rows)
        found = cold.groupBy(*keys).agg(ordered(part).alias("all")).select(*keys, self.of_actions(F.transform("all", lambda x: x["a"])).alias("run"), F.size("all").cast("long").alias("n_actions"))
        if hot is None:
            return found
        dealt = in_ranges(hot, *keys, order)
        blocks = dealt.groupBy(*keys, "__range", F.expr(f"__at div {self.BLOCK}").alias("__block")).agg(ordered(part).alias("all"))
        blocks = blocks.select(*keys, "__range", "__block", self.of_actions(F.transform("all", lambda x: x["a"])).alias("run"), F.size("all").cast("long").alias("n"))
        for place in ("__block", "__range"):
            by = [*keys, "__range"] if place == "__block" else keys
            level = blocks.groupBy(*by).agg(ordered(F.struct(F.col(place).alias("o"), "run")).alias("all"), F.sum("n").alias("n"))
            blocks = level.select(*by, self.composed(F.transform("all", lambda x: x["run"])).alias("run"), "n")
        return found.unionByName(blocks.withColumnRenamed("n", "n_actions"))
