"""Communities of a weighted graph by local moves of modularity, aggregated level by level.

Every round is a set of joins: each node looks at the weight it has to each
neighbouring community and moves to the best one, nodes with even and odd hash in
turn, so that two neighbours don't swap for ever.  A community that fell apart is
split into its connected parts before the graph is shrunk to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidar.tables import durable

#: fixed values: weights of edge types
WEIGHTS = {"Defines": 1.0, "Imports": 1.5, "Calls": 2.0, "Inherits": 3.0}


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w): both directions, weights of an unordered pair summed, no loops; edges have (type, source, target)."""
    weight = F.lit(1.0)
    for kind, w in WEIGHTS.items():
        weight = F.when(F.col("type") == kind, F.lit(w)).otherwise(weight)
    pair = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), weight.alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    return pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def _move(steps: DataFrame, label: DataFrame, degree: DataFrame, total: float, resolution: float, parity: int) -> DataFrame:
    mass = label.join(degree, "a").groupBy("c").agg(F.sum("k").alias("mass"))
    to = steps.join(label.select(F.col("a").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
    own = label.select("a", F.col("c").alias("now")).join(degree, "a")
    # staying is an option too, with a weight of 0 where no neighbour is in the own community
    options = to.unionByName(label.select("a", "c", F.lit(0.0).alias("w"))).groupBy("a", "c").agg(F.sum("w").alias("w"))
    rated = options.join(own, "a").join(mass, "c")
    rest = F.col("mass") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)
    rated = rated.withColumn("gain", F.round(F.col("w") - resolution * F.col("k") * rest / total, 9)).withColumn("stay", (F.col("c") == F.col("now")).cast("int"))
    best = rated.groupBy("a").agg(F.max(F.struct("gain", "stay", "c")).alias("x"), F.first("now").alias("now"))
    turn = F.pmod(F.xxhash64("a"), F.lit(2)) == parity
    return best.select("a", F.when(turn, F.col("x.c")).otherwise(F.col("now")).alias("c"))


def components(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, c): the least node that can be reached, by spreading minima and short cuts through them."""
    label = durable(nodes.select("a", F.col("a").alias("c")))
    while True:
        low = steps.join(label.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("low"))
        near = label.join(low, "a", "left").select("a", "c", F.least("c", F.coalesce("low", "c")).alias("n"))
        jump = near.select(F.col("a").alias("n"), F.col("n").alias("far"))
        new = durable(near.join(jump, "n").select("a", "c", F.least("n", "far").alias("n")))
        if new.where("n <> c").isEmpty():
            return new.select("a", F.col("n").alias("c"))
        label = durable(new.select("a", F.col("n").alias("c")))


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 6, levels: int = 3) -> DataFrame:
    """(id, community): a partition of the nodes with an edge; a community is named by its least member and is connected."""
    steps = durable(undirected(edges))
    total = steps.agg(F.sum("w")).first()[0]
    if not total:
        return steps.select(F.col("a").alias("id"), F.col("a").alias("community"))
    member = durable(steps.select("a").distinct().select(F.col("a").alias("id"), F.col("a")))
    level = steps
    for _ in range(levels):
        degree = durable(level.groupBy("a").agg(F.sum("w").alias("k")))
        label = durable(degree.select("a", F.col("a").alias("c")))
        plain = durable(level.where("a <> b"))
        for turn in range(rounds):
            new = durable(_move(plain, label, degree, total, resolution, turn % 2))
            moved = not new.join(label, ["a", "c"], "left_anti").isEmpty()
            label = new
            if not moved and turn % 2:
                break
        inside = plain.join(label, "a").join(label.select(F.col("a").alias("b"), F.col("c").alias("d")), "b").where("c = d").select("a", "b")
        label = components(durable(inside), label.select("a"))
        before = label.count()
        joined = member.join(label, "a").select("id", F.col("c").alias("a"))
        member = durable(joined)
        level = durable(level.join(label, "a").join(label.select(F.col("a").alias("b"), F.col("c").alias("d")), "b").groupBy("c", "d").agg(F.sum("w").alias("w")).select(F.col("c").alias("a"), F.col("d").alias("b"), "w"))
        if member.select("a").distinct().count() == before:
            break
    least = member.groupBy("a").agg(F.min("id").alias("community"))
    return member.join(least, "a").select("id", "community")


def modularity(edges: DataFrame, partition: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of a partition (id, community)."""
    steps = undirected(edges)
    total = steps.agg(F.sum("w")).first()[0]
    if not total:
        return 0.0
    a, b = partition.toDF("a", "c"), partition.toDF("b", "d")
    inside = steps.join(a, "a").join(b, "b").where("c = d").agg(F.sum("w")).first()[0] or 0.0
    mass = steps.join(a, "a").groupBy("c").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inside / total - resolution * mass / total**2
