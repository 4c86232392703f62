"""Running totals and positions within keys of which one may hold a third of all rows.

A window partitioned by such a key would put that third into one task.  Here every
key is cut into cells by the leading bits of an ordering hash; a cell is small, the
totals of the cells are summed first, and only the rows of a cell meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, key: str, order: Column, amount: Column, total: str, cells: int = 1024, tie: list[str] | None = None) -> DataFrame:
    """Adds ``total``: the sum of ``amount`` over the rows of the same key that come before the row.

    ``order`` must be a non-negative bigint spread evenly over 0..2^62-1 (a hash);
    rows are ordered by it and then by ``tie``.  ``cells`` is the number of cells a
    key is cut into and must grow with the data so that a cell fits a task.
    A null amount counts as 0; a null key is a key of its own; an empty input
    gives an empty output.
    """
    width = (1 << 62) // cells
    rows = (
        df.withColumn("__at", order.cast("bigint"))
        .withColumn("__cell", F.least(F.floor(F.col("__at") / F.lit(width)), F.lit(cells - 1)).cast("int"))
        .withColumn("__amount", F.coalesce(amount.cast("bigint"), F.lit(0)))
    )
    sums = rows.groupBy(F.col(key).alias("__key"), "__cell").agg(F.sum("__amount").alias("__sum"))
    # at most ``cells`` rows for a key
    before = sums.withColumn(
        "__before",
        F.coalesce(F.sum("__sum").over(Window.partitionBy("__key").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select("__key", F.col("__cell").alias("__c"), "__before")
    within = Window.partitionBy(key, "__cell").orderBy("__at", *(tie or [])).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("__within", F.coalesce(F.sum("__amount").over(within), F.lit(0)))
        .join(before, (F.col(key).eqNullSafe(F.col("__key"))) & (F.col("__cell") == F.col("__c")))
        .withColumn(total, (F.col("__before") + F.col("__within")).cast("bigint"))
        .drop("__at", "__cell", "__amount", "__within", "__before", "__key", "__c")
    )
