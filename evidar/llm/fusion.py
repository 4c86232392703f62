"""One ranking from several differently scaled scores (problem 6).

Each score is standardised by the median and the median absolute deviation of its
group (report and section), squashed by the logistic function, and the bounded
values of a candidate are combined by a weighted geometric mean.  Order goes by the
unrounded logarithm of that mean; where values are so far out that the logistic
function can't tell them apart, by the weighted sum of the standardised scores.

Groups of ordinary size meet in one task, once.  A group that may hold a large part
of all rows is cut into cells (``operators.skew``), with the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidar.operators.skew import greater_counts, lookup, median_of
from evidar.tables import durable

#: the scores of each section and their weights
WEIGHTS = {"doc": {"bm25": 1.0, "cos": 1.0}, "code": {"bm25": 1.0, "cos": 1.0, "fused_score": 1.0}}
#: makes the median absolute deviation comparable with a standard deviation (fixed value)
_NORMAL = 1.4826
#: rows of a group beyond which it doesn't meet in one task
LARGE = 100_000


def fused(cand: DataFrame, weights: dict[str, dict[str, float]] | None = None, large: int = LARGE) -> DataFrame:
    """One row per distinct candidate: n, section, id, the scores, ``combined``, ``log_combined``, ``beyond`` and ``best_tenth``.

    Repeated rows count once; rows that differ in a score are candidates of their
    own.  A null score is left out of the mean; a candidate without any score has a
    null ``combined``.  Where the deviation is 0 (more than half of the group equal)
    the scale is the mean absolute deviation, and 1 if that is 0 too.
    ``log_combined`` is the logarithm of ``combined``, unrounded, ``beyond`` the
    weighted mean of the standardised scores, which breaks its ties.

    ``best_tenth`` says whether fewer than ceil(m / 10) of the m candidates of the
    same n and section have a greater value, for every score of the section; with a
    null among them it is false.  It is taken from the squashed values, which keep
    the order of the scores; values so far out that they are squashed alike are told
    apart by the scores themselves.

    Candidates of a section without weights are dropped; NaN counts as null.
    """
    weights = weights or WEIGHTS
    names = list(dict.fromkeys(s for w in weights.values() for s in w))
    rows = cand.where(F.col("section").isin(*weights)).select(
        "n", "section", "id", *[F.when(~F.isnan(c), F.col(c).cast("double")).alias(c) for c in names]
    )
    sizes = rows.groupBy("n", "section").agg(F.count("*").alias("rows")).where(F.col("rows") > large)
    hot = durable(sizes)
    if hot.isEmpty():
        return _combined(_placed(rows.distinct(), names), weights, names)
    # at most 1/large of the number of all rows are groups of that size
    on = F.col("n").eqNullSafe(F.col("n__key")) & (F.col("section") == F.col("section__key"))
    marks = hot.select(F.col("n").alias("n__key"), F.col("section").alias("section__key"))
    usual = rows.join(marks, on, "left_anti").distinct()
    return _combined(_placed(usual, names).unionByName(_placed_by_cells(rows.join(marks, on, "left_semi").distinct(), weights, names)), weights, names)


def _placed(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds of every score its median, both deviations and how many of the group are greater; a group meets in one task."""
    group = Window.partitionBy("n", "section")
    full = rows.withColumn("m", F.count("*").over(group))
    for c in names:
        full = full.withColumn(f"median_{c}", F.median(c).over(group))
    for c in names:
        off = F.abs(F.col(c) - F.col(f"median_{c}"))
        full = full.withColumn(f"mad_{c}", F.median(off).over(group)).withColumn(f"mean_{c}", F.avg(off).over(group))
    for c in names:
        full = full.withColumn(f"above_{c}", F.rank().over(group.orderBy(F.desc_nulls_last(c))) - 1)
    return full


def _placed_by_cells(rows: DataFrame, weights: dict[str, dict[str, float]], names: list[str]) -> DataFrame:
    """The same for groups too large for a task."""
    rows = durable(rows)
    used = reduce(lambda a, b: a.unionByName(b), [rows.select("n", "section", F.lit(name).alias("name"), F.col(name).alias("value")) for name in names])
    keys = ["n", "section", "name"]
    counted = durable(greater_counts(used, keys, "value"))
    totals = durable(counted.groupBy(*keys).agg(F.sum("ties").alias("total"), F.count("*").alias("values")))
    placed = lookup(counted, totals, keys, "values")
    middle = durable(placed.groupBy(*keys).agg(median_of("value", "total").alias("median"), F.max("total").alias("total"), F.count("*").alias("values")))
    off = lookup(counted, middle, keys, "values").select(*keys, F.abs(F.col("value") - F.col("median")).alias("off"), "ties")
    spread = durable(greater_counts(off, keys, "off", weight="ties"))
    again = durable(_beside(spread.groupBy(*keys).agg(F.count("*").alias("values")), middle.select(*keys, "total"), keys))
    spread = lookup(spread, again, keys, "values").groupBy(*keys).agg(median_of("off", "total").alias("mad"), (F.sum(F.col("off") * F.col("ties")) / F.sum("ties")).alias("mean"))
    stats = _beside(middle.select(*keys, "median"), spread, keys)
    wide = stats.groupBy("n", "section").agg(*[F.max(F.when(F.col("name") == c, F.col(k))).alias(f"{k}_{c}") for c in names for k in ("median", "mad", "mean")])
    size = durable(rows.groupBy("n", "section").agg(F.count("*").alias("rows"), F.count("*").alias("m")))
    full = lookup(rows, durable(_beside(size, wide, ["n", "section"])), ["n", "section"], "rows")
    for c in names:
        above = counted.where(F.col("name") == c).select("n", "section", F.col("value").alias(c), "ties", F.col("greater").alias(f"above_{c}"))
        full = durable(lookup(full.where(F.col(c).isNotNull()), above, ["n", "section", c], "ties").unionByName(full.where(F.col(c).isNull()).withColumn(f"above_{c}", F.lit(None).cast("bigint"))))
    return full


def _combined(full: DataFrame, weights: dict[str, dict[str, float]], names: list[str]) -> DataFrame:
    def weight(name) -> Column:
        w = F.lit(0.0)
        for section, of in weights.items():
            w = F.when(F.col("section") == section, F.lit(float(of.get(name, 0.0)))).otherwise(w)
        return F.when(F.col(name).isNotNull(), w).otherwise(0.0)

    for c in names:
        scale = F.when(F.col(f"mad_{c}") > 0, F.col(f"mad_{c}") * _NORMAL).when(F.col(f"mean_{c}") > 0, F.col(f"mean_{c}") * 1.2533).otherwise(F.lit(1.0))
        full = full.withColumn(f"z_{c}", (F.col(c) - F.col(f"median_{c}")) / scale)
        # the logarithm of the logistic function, without overflow on either side
        z = F.col(f"z_{c}")
        full = full.withColumn(f"log_{c}", F.when(z >= 0, -F.log1p(F.exp(-z))).otherwise(z - F.log1p(F.exp(z))))
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    whole = add([weight(c) for c in names])
    mean = lambda kind: F.when(whole > 0, add([F.when(weight(c) > 0, weight(c) * F.col(f"{kind}_{c}")).otherwise(0.0) for c in names]) / whole)
    best = F.lit(False)
    for section, of in weights.items():
        # how many are greater by the squashed value is no more than by the score
        inside = lambda c: F.col(f"log_{c}").isNotNull() & (F.col(f"above_{c}") < F.ceil(F.col("m") / 10))
        best = F.when(F.col("section") == section, reduce(lambda a, b: a & b, [inside(c) for c in of])).otherwise(best)
    return full.select("n", "section", "id", *names, F.exp(mean("log")).alias("combined"), mean("log").alias("log_combined"), mean("z").alias("beyond"), F.coalesce(best, F.lit(False)).alias("best_tenth"))


def ranked(full: DataFrame, large: int = LARGE) -> DataFrame:
    """Adds ``rank`` in the report to the result of ``fused``: 1 for the best; equal ones share a rank, candidates without any score are last."""
    order = Window.partitionBy("n").orderBy(F.desc_nulls_last("log_combined"), F.desc_nulls_last("beyond"))
    hot = durable(full.groupBy("n").agg(F.count("*").alias("rows")).where(F.col("rows") > large))
    if hot.isEmpty():
        return full.withColumn("rank", F.rank().over(order).cast("bigint"))
    marks, on = hot.select(F.col("n").alias("n__key")), F.col("n").eqNullSafe(F.col("n__key"))
    usual = full.join(marks, on, "left_anti").withColumn("rank", F.rank().over(order).cast("bigint"))
    rest = durable(full.join(marks, on, "left_semi"))
    # first how many have a greater mean, then how many of those with the same mean are further out
    means = greater_counts(rest, ["n"], "log_combined").select("n", "log_combined", "ties", "greater")
    outer = greater_counts(rest.where("log_combined is not null"), ["n", "log_combined"], "beyond")
    count = rest.groupBy("n").agg(F.count("log_combined").alias("scored"))
    place = _beside(outer.select("n", "log_combined", "beyond", F.col("ties").alias("rows"), F.col("greater").alias("further")), means.drop("ties"), ["n", "log_combined"])
    place = durable(place.select("n", "log_combined", "beyond", "rows", (F.col("greater") + F.col("further") + 1).cast("bigint").alias("rank")))
    told = lookup(rest.where("log_combined is not null"), place, ["n", "log_combined", "beyond"], "rows")
    return usual.unionByName(told).unionByName(_beside(rest.where("log_combined is null"), count.select("n", (F.col("scored") + 1).alias("rank")), ["n"]))


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys of which some may be null; both sides have one row per key, or the right has."""
    other = right.select(*[F.col(k).alias(f"{k}__key") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__key")) for k in keys])
    return left.join(other, on, "left").drop(*[f"{k}__key" for k in keys])
