"""Exact quantiles and shares beyond a limit, of values that no task holds all of.

Values are counted, the distinct ones dealt by ranges, and the counts of ranges
tell in which of them a quantile's ranks lie; only those ranges are read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import in_ranges, scratch


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """``by`` and a column for each of ``shares``: the quantile, interpolated between the ranks beside it.

    Null values are left out, and NaN is the largest; a group without a value has
    no row, but without ``by`` there is one row, of nulls then. A range may hold
    parts of several groups, and a group many ranges.
    """
    by = list(by or [])
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    dealt = in_ranges(counted, *by, "__v").drop("__at")
    group = Window.partitionBy(*by)
    sizes = dealt.groupBy("__range", *by).agg(F.sum("__n").alias("__many"))  # ranges + groups rows
    sizes = sizes.withColumns({"__all": F.sum("__many").over(group), "__end": F.sum("__many").over(group.orderBy("__range"))})
    place = lambda q: (F.col("__all") - 1) * F.lit(float(q))
    ranks = F.array(*(F.struct(F.lit(i).alias("q"), F.lit(side).alias("side"), rank(place(q)).cast("long").alias("rank"), (place(q) - F.floor(place(q))).alias("part")) for i, q in enumerate(shares.values()) for side, rank in (("low", F.floor), ("high", F.ceil))))
    inside = lambda r: (r["rank"] >= F.col("__end") - F.col("__many")) & (r["rank"] < F.col("__end"))
    wanted = sizes.withColumn("__ranks", F.filter(ranks, inside)).where(F.size("__ranks") > 0)
    wanted = scratch(wanted.select(F.col("__range").alias("__r"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(by)), (F.col("__end") - F.col("__many")).alias("__before"), "__ranks"), "ranks")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)), F.col("__range") == F.col("__r"))
    end = F.col("__before") + F.sum("__n").over(Window.partitionBy("__range", *by).orderBy("__v"))
    hit = dealt.join(wanted, same).withColumn("__to", end).select(*by, "__v", F.explode(F.filter("__ranks", lambda r: (r["rank"] < F.col("__to")) & (r["rank"] >= F.col("__to") - F.col("__n")))).alias("r"))
    at = lambda i, side: F.max(F.when((F.col("r.q") == i) & (F.col("r.side") == side), F.col("__v")))
    part = lambda i: F.max(F.when(F.col("r.q") == i, F.col("r.part")))
    between = lambda i: F.when(at(i, "low") == at(i, "high"), at(i, "low")).otherwise(at(i, "low") + (at(i, "high") - at(i, "low")) * part(i))
    return hit.groupBy(*by).agg(*(between(i).alias(name) for i, name in enumerate(shares)))


def summarised(rows: DataFrame, value: str, limit: Column, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """``quantiles``, and ``breach``: the share of values over ``limit``, to three places."""
    by = list(by or [])
    breach = rows.groupBy(*by).agg(F.round(F.avg((F.col(value) > limit).cast("int")), 3).alias("breach"))
    found = quantiles(rows, value, shares, by)
    if not by:
        return found.join(breach)  # one row each
    known = breach.select(*(F.col(k).alias(f"__b{i}") for i, k in enumerate(by)), "breach")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__b{i}")) for i, k in enumerate(by)))
    return found.join(known, same).select(*by, *shares, "breach")
