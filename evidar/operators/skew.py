"""Joins and order statistics that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidar.tables import durable


def lookup(big: DataFrame, small: DataFrame, keys: list[str], rows: str, share: int = 1000, least: int = 10_000) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row per key and in ``rows`` how many rows of ``big`` the key has.

    Keys that hold at least 1/``share`` of all rows (and ``least`` rows) number at
    most ``share``; they are broadcast, so their rows aren't shuffled.  The rest is
    joined by key, where no key is large any more.  Null keys match null keys.
    The result has the columns of ``big`` and those of ``small`` without keys and ``rows``.
    """
    renamed = small.select(*[F.col(k).alias(f"{k}__key") for k in keys], F.col(rows).alias("__rows"), *[c for c in small.columns if c not in (*keys, rows)])
    total = small.agg(F.sum(rows)).first()[0] or 0
    limit = max(least, total // share)
    hot, rest = renamed.where(F.col("__rows") >= limit), renamed.where(F.col("__rows") < limit)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__key")) for k in keys])
    drop = [f"{k}__key" for k in keys] + ["__rows"]
    if total <= least:  # then no key can be hot
        return big.join(renamed, on).drop(*drop)
    marked = big.join(F.broadcast(hot), on, "left")
    own = [c for c in renamed.columns if c not in drop]
    of_hot = marked.where("__rows is not null").drop(*drop)
    of_rest = marked.where("__rows is null").drop(*drop, *own).join(rest, on).drop(*drop)
    return of_hot.unionByName(of_rest)


def greater_counts(df: DataFrame, keys: list[str], value: str, large: int = 50_000, weight: str | None = None) -> DataFrame:
    """For every distinct non-null ``value`` of a group: how often it comes and how many rows of the group are greater.

    Columns: keys, ``value``, ``ties`` and ``greater``, both bigint; null keys are a
    group.  With ``weight`` a row stands for that many rows.  Equal rows are counted
    before anything is shuffled.  A group with more
    than ``large`` distinct values is cut into cells at its approximate quantiles
    (1,024 of them, from a sketch of fixed size), so that no task gets a whole
    large group.
    """
    counts = durable(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("ties")))
    sizes = durable(counts.groupBy(*keys).agg(F.count("*").alias("__n")))
    below = F.coalesce(F.sum("ties").over(Window.partitionBy(*keys).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if (sizes.agg(F.max("__n")).first()[0] or 0) <= large:  # every group fits a task
        return counts.select(*keys, value, "ties", below.alias("greater"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__key")) for k in keys])

    def renamed(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(k).alias(f"{k}__key") for k in keys], *[c for c in rows.columns if c not in keys])

    cuts = ", ".join(str(i / 1024) for i in range(1, 1024))
    # groups of more than ``large`` rows: few, but their number grows with the data, so it's left to the planner how to join
    big = counts.join(renamed(sizes.where(F.col("__n") > large)), on, "left_semi")
    edges = durable(big.groupBy(*keys).agg(F.expr(f"percentile_approx(`{value}`, array({cuts}), 5000)").alias("__edges")))
    placed = counts.join(renamed(edges), on, "left").withColumn("__cell", F.coalesce(F.size(F.filter("__edges", lambda e: e <= F.col(value))), F.lit(0)))
    placed = durable(placed.select(*keys, value, "ties", "__cell"))
    cells = placed.groupBy(*keys, "__cell").agg(F.sum("ties").alias("__sum"))
    above = Window.partitionBy(*keys).orderBy(F.desc("__cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = renamed(cells.select(*keys, F.col("__cell").alias("__c"), F.coalesce(F.sum("__sum").over(above), F.lit(0)).alias("__above")))
    inside = Window.partitionBy(*keys, "__cell").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("__inside", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
        .join(cells, on & (F.col("__cell") == F.col("__c")))
        .select(*keys, value, "ties", (F.col("__above") + F.col("__inside")).alias("greater"))
    )


def medians(counted: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Exact medians per group from the result of ``greater_counts``."""
    n = counted.groupBy(*keys).agg(F.sum("ties").alias("__n"))
    n = n.select(*[F.col(k).alias(f"{k}__key") for k in keys], "__n")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__key")) for k in keys])
    return counted.join(n, on).groupBy(*keys).agg(median_of(value, "__n").alias(out))


def median_of(value: str, total: str) -> Column:
    """The median as an aggregate over distinct values with ``ties`` and ``greater``; ``total`` is their number with repeats."""

    def holds(position):
        return (F.col("greater") <= position) & (position < F.col("greater") + F.col("ties"))

    lower, upper = F.expr(f"({total} - 1) div 2"), F.expr(f"{total} div 2")
    return (F.max(F.when(holds(lower), F.col(value))) + F.max(F.when(holds(upper), F.col(value)))) / 2
