"""Ranking metrics, paired tests and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def precision_recall(predicted: DataFrame, gold: DataFrame, group: str, key: str) -> DataFrame:
    """(group, tp, precision, recall, f1): list lengths are the denominators, so repeats count; empty lists give 0."""
    p = predicted.groupBy(group).agg(F.count("*").alias("np"))
    g = gold.groupBy(group).agg(F.count("*").alias("ng"))
    t = predicted.select(group, key).distinct().join(gold.select(group, key).distinct(), [group, key]).groupBy(group).agg(F.count("*").alias("tp"))
    zero = F.lit(0).cast("bigint")
    rows = p.join(g, group, "full").join(t, group, "left").select(group, F.coalesce("tp", zero).alias("tp"), F.coalesce("np", zero).alias("np"), F.coalesce("ng", zero).alias("ng"))
    rows = rows.withColumn("precision", F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0)).withColumn("recall", F.when(F.col("ng") > 0, F.col("tp") / F.col("ng")).otherwise(0.0))
    total = F.col("precision") + F.col("recall")
    return rows.select(group, "tp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0), 6).alias("f1"))


def list_metrics(lists: DataFrame, gold: DataFrame, keys: list[str], cuts: tuple[int, ...] = (1, 5, 10), depth: int = 500) -> DataFrame:
    """Per system and instance: top@k (any gold within k), acc@k (all of them), mrr, map, best.

    ``lists`` has (system, keys, key, rank), ``gold`` (keys, key).  Gold beyond
    ``depth`` counts as not found; an instance without gold has no row.
    """
    wanted = gold.select(*keys, "key").distinct()
    systems = lists.select("system", *keys).distinct()
    placed = systems.join(wanted, keys).join(lists.where(F.col("rank") <= depth).select("system", *keys, "key", "rank"), ["system", *keys, "key"], "left")
    nth = F.row_number().over(Window.partitionBy("system", *keys).orderBy(F.asc_nulls_last("rank"), "key"))
    placed = placed.withColumn("hit", F.when(F.col("rank").isNotNull(), nth / F.col("rank")).otherwise(0.0))
    out = [F.count("*").alias("gold"), F.coalesce(F.min("rank"), F.lit(depth + 1)).cast("bigint").alias("best"), F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("mrr"), F.round(F.sum("hit") / F.count("*"), 6).alias("map")]
    for k in cuts:
        inside = F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))
        out += [F.max(inside).alias(f"top{k}"), F.min(inside).alias(f"acc{k}")]
    return placed.groupBy("system", *keys).agg(*out)


def system_means(metrics: DataFrame, repo: str = "repo") -> DataFrame:
    """(repo, system, n, top10, mrr, map): means per system, and per repository and system; repo is null for all."""
    sets = metrics.groupingSets([["system"], [repo, "system"]], repo, "system")
    return sets.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("top10", "mrr", "map")])


def discordant(metrics: DataFrame, left: str, right: str, keys: list[str], measure: str = "top10") -> DataFrame:
    """(b, c): instances that only the left, or only the right system gets; the counts of McNemar's test."""
    a = metrics.where(F.col("system") == left).select(*keys, F.col(measure).alias("x"))
    b = metrics.where(F.col("system") == right).select(*keys, F.col(measure).alias("y"))
    return a.join(b, keys).agg(F.coalesce(F.sum(((F.col("x") == 1) & (F.col("y") == 0)).cast("bigint")), F.lit(0)).alias("b"), F.coalesce(F.sum(((F.col("x") == 0) & (F.col("y") == 1)).cast("bigint")), F.lit(0)).alias("c"))


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided p of McNemar's test."""
    from math import comb

    n = b + c
    return min(1.0, 2 * sum(comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0


def win_loss(metrics: DataFrame, left: str, right: str, keys: list[str]) -> DataFrame:
    """(bucket, wins, losses, ties) by best rank, for easy (to 10), middle (to 100), hard instances of the left system, and all."""
    a = metrics.where(F.col("system") == left).select(*keys, F.col("best").alias("x"))
    b = metrics.where(F.col("system") == right).select(*keys, F.col("best").alias("y"))
    bucket = F.when(F.col("x") <= 10, "1-10").when(F.col("x") <= 100, "11-100").otherwise("101-")
    both = a.join(b, keys).withColumn("bucket", F.explode(F.array(bucket, F.lit("all"))))
    count = lambda c: F.sum(c.cast("bigint"))
    return both.groupBy("bucket").agg(count(F.col("x") > F.col("y")).alias("wins"), count(F.col("x") < F.col("y")).alias("losses"), count(F.col("x") == F.col("y")).alias("ties"))


def holm(tests: DataFrame, name: str = "test", p: str = "p") -> DataFrame:
    """(test, p, adjusted): Holm's step-down correction; null p are no tests."""
    rows = tests.where(F.col(p).isNotNull())
    count = rows.count()
    # the tests of one study: a window over all of them is small
    order = Window.orderBy(p, name)
    step = rows.withColumn("raised", (F.lit(count) - F.row_number().over(order) + 1) * F.col(p))
    return step.select(name, p, F.round(F.least(F.lit(1.0), F.max("raised").over(order.rowsBetween(Window.unboundedPreceding, 0))), 9).alias("adjusted"))


def kappa(judged: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, kappa, weighted): agreement of two judges, Cohen's kappa, and with quadratic weights."""
    cells = judged.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    # cells of a scale of judgements: a handful
    rows = cells.withColumn("all", F.sum("n").over(Window.partitionBy())).withColumn("ra", F.sum("n").over(Window.partitionBy("a"))).withColumn("rb", F.sum("n").over(Window.partitionBy("b")))
    n = F.max("all")
    square = lambda x, y: (x - y) * (x - y)
    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    observed = F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)) / F.sum("n")
    left = rows.groupBy("a").agg(F.max("ra").alias("ra"))
    right = rows.groupBy("b").agg(F.max("rb").alias("rb"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("ra") * F.col("rb")), F.lit(0)).alias("x")).first()[0]
    got = rows.agg(n.alias("n"), observed.alias("o"), mean(square(F.col("a"), F.col("b"))).alias("d"), mean(F.col("a")).alias("ma"), mean(F.col("b")).alias("mb"), mean(F.col("a") * F.col("a")).alias("sa"), mean(F.col("b") * F.col("b")).alias("sb"))
    pe = F.lit(float(chance)) / (F.col("n") * F.col("n"))
    expected = F.col("sa") + F.col("sb") - 2 * F.col("ma") * F.col("mb")
    return got.select(F.col("n").cast("bigint").alias("n"), F.round("o", 6).alias("agreement"), F.round(F.when(pe < 1, (F.col("o") - pe) / (1 - pe)), 6).alias("kappa"), F.round(F.when(expected > 0, 1 - F.col("d") / expected), 6).alias("weighted"))


def sample(df: DataFrame, group: str, key: str, size: int) -> DataFrame:
    """(group, key, place): the first ``size`` keys of every group by their SHA-1, the same in every run."""
    window = Window.partitionBy(group).orderBy(F.sha1(F.col(key).cast("string")), key)
    return df.select(group, key).distinct().withColumn("place", F.row_number().over(window)).where(F.col("place") <= size)


def sign_flips(differences, rounds: int = 10_000, seed: int = 20261021) -> float:
    """Two-sided p of a paired permutation test on a list of differences: (hits + 1) / (rounds + 1)."""
    import numpy as np

    d = np.asarray(differences, float)
    d = d[d != 0]
    if not len(d):
        return 1.0
    signs = np.random.default_rng(seed).choice((-1.0, 1.0), (rounds, len(d)))
    return float((np.sum(np.abs(signs @ d) >= abs(d.sum()) - 1e-12) + 1) / (rounds + 1))
