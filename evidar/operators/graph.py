"""The property graph: upserts, dangling edges, neighbourhoods, paths and votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidar.tables import durable, release


def last_version(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key: the version with the greatest ``order``; of equal ones the greatest row.

    Only keys and ``order`` are aggregated over all rows.  Rows of a key that comes
    once pass as they are; the others are compared, of the columns ``df`` has.  So
    take the columns that are wanted before.  Null keys are one key.
    """
    rest = [c for c in df.columns if c not in keys]
    rows = df.withColumn("order__", order)
    seen = rows.groupBy(*[F.col(k).alias(f"{k}__key") for k in keys]).agg(F.count("*").alias("times__"), F.max("order__").alias("newest__")).where("times__ > 1")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__key")) for k in keys])
    marked = rows.join(seen, on, "left")
    single = marked.where("times__ is null").select(*df.columns)
    if not rest:
        return single.unionByName(marked.where("times__ is not null").select(*df.columns).distinct())
    again = marked.where("times__ is not null").where(F.col("order__").eqNullSafe(F.col("newest__")))
    newest = again.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("x__"))
    return single.unionByName(newest.select(*keys, *[F.col(f"x__.{c}").alias(c) for c in rest]).select(*df.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Property merge: values of ``new`` where not null, else those of ``old``; rows of either side stay."""
    rest = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, *[F.col(c).alias(f"{c}__new") for c in rest])
    return old.join(fresh, keys, "full").select(*keys, *[F.coalesce(f"{c}__new", c).alias(c) for c in rest])


def unique_edges(edges: DataFrame) -> DataFrame:
    """(type, source, target, line): one row per triple with its first line; null lines only if all are."""
    return edges.groupBy("type", "source", "target").agg(F.min("line").alias("line"))


def anchored(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which exist."""
    ids = nodes.select(F.col("id"))
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is missing."""
    ids = nodes.select(F.col("id"))
    lost = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    return lost.unionByName(edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "source"), "source", "left_anti")).select(*edges.columns)


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b): every edge in both directions, once."""
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()


#: edges of a node beyond which they are spread over several tasks
HUB = 100_000


def _parted(edges: DataFrame, key: str, other: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges with ``part__``: those of a node with more than ``most`` go by a hash of their other end; and the hubs (key, parts__), if there are any."""
    hubs = durable(edges.groupBy(key).agg(F.count("*").alias("n__")).where(F.col("n__") > most).select(key, F.ceil(F.col("n__") / most).cast("int").alias("parts__")))
    if hubs.isEmpty():
        return edges.withColumn("part__", F.lit(0)), None
    marked = edges.join(hubs, key, "left")
    return marked.withColumn("part__", F.pmod(F.xxhash64(other), F.coalesce("parts__", F.lit(1))).cast("int")).drop("parts__"), hubs


def _at_parts(rows: DataFrame, key: str, hubs: DataFrame | None, name: str) -> DataFrame:
    """Rows once for every part of their node's edges."""
    if hubs is None:
        return rows.withColumn("part__", F.lit(0))
    marked = rows.join(hubs.withColumnRenamed(name, key), key, "left")
    return marked.withColumn("part__", F.explode(F.sequence(F.lit(0), F.coalesce("parts__", F.lit(1)) - 1))).drop("parts__")


def ball(seeds: DataFrame, steps: DataFrame, group: str, depth: int, hub: int = HUB) -> DataFrame:
    """(group, id, hop): what can be reached over ``steps`` (a, b) from the seeds (group, id), with the least number of steps.

    Each round joins the frontier only, and keeps what no earlier round reached;
    rounds are cut off at the shared checkpoint folder.  The edges of a node with more
    than ``hub`` of them are joined in parts.
    """
    steps, hubs = _parted(durable(steps), "a", "b", hub)
    steps = durable(steps) if hubs is not None else steps
    reached = frontier = durable(seeds.select(group, "id").distinct().withColumn("hop", F.lit(0)))
    rounds = [reached]
    for hop in range(1, depth + 1):
        found = _at_parts(frontier.select(group, F.col("id").alias("a")), "a", hubs, "a").join(steps, ["a", "part__"]).select(group, F.col("b").alias("id")).distinct()
        frontier = durable(found.join(reached.select(group, "id"), [group, "id"], "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        rounds.append(frontier)
        reached = reduce(lambda a, b: a.unionByName(b), rounds)
    return reduce(lambda a, b: a.unionByName(b), rounds)


def induced(edges: DataFrame, reached: DataFrame, group: str, hub: int = HUB) -> DataFrame:
    """(group, type, source, target): edges with both ends in the same group's set; those of a hub are joined in parts."""
    edges, hubs = _parted(durable(edges.select("type", "source", "target")), "source", "target", hub)
    a = _at_parts(reached.select(group, F.col("id").alias("source")), "source", hubs, "source")
    b = reached.select(F.col(group).alias("group__"), F.col("id").alias("target"))
    return edges.join(a, ["source", "part__"]).join(b.withColumnRenamed("group__", group), [group, "target"]).select(group, "type", "source", "target")


def neighbours(edges: DataFrame, limit: int = 10) -> DataFrame:
    """(id, direction, other, place): the first ``limit`` callers and callees of every element by id."""
    out = edges.select(F.col("source").alias("id"), F.lit("out").alias("direction"), F.col("target").alias("other"))
    into = edges.select(F.col("target").alias("id"), F.lit("in").alias("direction"), F.col("source").alias("other"))
    window = Window.partitionBy("id", "direction").orderBy("other")
    return out.unionByName(into).distinct().withColumn("place", F.row_number().over(window)).where(F.col("place") <= limit)


def ranked_neighbours(wanted: DataFrame, edges: DataFrame, listed: DataFrame, group: str, limit: int = 10) -> DataFrame:
    """(group, id, direction, other, place, total): callers and callees of a group's elements (group, id).

    Those in the group's list (group, id, rank) come first, by their rank, the rest by
    id; ``total`` says how many there are.
    """
    pairs = edges.select("source", "target").distinct()
    out = wanted.join(pairs.select(F.col("source").alias("id"), F.col("target").alias("other")), "id").withColumn("direction", F.lit("out"))
    into = wanted.join(pairs.select(F.col("target").alias("id"), F.col("source").alias("other")), "id").withColumn("direction", F.lit("in"))
    rows = out.unionByName(into).join(listed.select(group, F.col("id").alias("other"), F.col("rank").alias("at")), [group, "other"], "left")
    by = Window.partitionBy(group, "id", "direction")
    placed = rows.withColumn("place", F.row_number().over(by.orderBy(F.asc_nulls_last("at"), "other")))
    # the first ``limit`` are picked before anything is said of how many there are
    total = rows.groupBy(group, "id", "direction").agg(F.count("*").alias("total"))
    return placed.where(F.col("place") <= limit).join(total, [group, "id", "direction"]).select(group, "id", "direction", "other", "place", "total")


def shortest(seeds: DataFrame, steps: DataFrame, group: str, budget: float) -> DataFrame:
    """(group, id, dist): least weight of a path over ``steps`` (a, b, w) within ``budget``, by relaxation in rounds."""
    steps = durable(steps.groupBy("a", "b").agg(F.min("w").alias("w")))
    best = durable(seeds.select(group, "id").distinct().withColumn("dist", F.lit(0.0)))
    changed = best
    while not changed.isEmpty():
        offer = changed.join(steps, F.col("id") == F.col("a")).select(group, F.col("b").alias("id"), F.round(F.col("dist") + F.col("w"), 9).alias("dist")).where(F.col("dist") <= budget)
        offer = offer.groupBy(group, "id").agg(F.min("dist").alias("dist"))
        known = best.select(group, "id", F.col("dist").alias("known"))
        changed = durable(offer.join(known, [group, "id"], "left").where("known is null or dist < known").select(group, "id", "dist"))
        best = durable(best.unionByName(changed).groupBy(group, "id").agg(F.min("dist").alias("dist")))
    return best


def shortest_near(seeds: DataFrame, edges: DataFrame, listed: DataFrame, group: str, budget: float = 4.0, inner: float = 0.25, other: float = 1.0) -> DataFrame:
    """(group, id, dist): least weight of a path from the seeds within ``budget``, over what a group's list leads to.

    ``edges`` has (type, source, target), walked both ways; containment (Defines)
    weighs ``inner`` and is open to all, other edges weigh ``other`` and are open to a
    group only if their target is in its list (group, id).  So a group sees its own
    part of the graph, and a hub costs only the groups that list it.
    """
    contained = edges.where("type = 'Defines'").select("source", "target").distinct()
    open_ = durable(edges.where("type <> 'Defines'").select("source", "target").distinct().join(listed.select(group, F.col("id").alias("target")).distinct(), "target").select(group, "source", "target"))
    both = contained.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(contained.select(F.col("target").alias("a"), F.col("source").alias("b")))
    steps = durable(both.distinct().withColumn("w", F.lit(inner)))
    own = durable(open_.select(group, F.col("source").alias("a"), F.col("target").alias("b")).unionByName(open_.select(group, F.col("target").alias("a"), F.col("source").alias("b"))).distinct().withColumn("w", F.lit(other)))
    best = changed = durable(seeds.select(group, "id").distinct().withColumn("dist", F.lit(0.0)))
    while not changed.isEmpty():
        at = changed.withColumnRenamed("id", "a")
        offer = at.join(steps, "a").select(group, F.col("b").alias("id"), (F.col("dist") + F.col("w")).alias("dist")).unionByName(at.join(own, [group, "a"]).select(group, F.col("b").alias("id"), (F.col("dist") + F.col("w")).alias("dist")))
        offer = offer.where(F.col("dist") <= budget).groupBy(group, "id").agg(F.round(F.min("dist"), 9).alias("dist"))
        changed = durable(offer.join(best.withColumnRenamed("dist", "known"), [group, "id"], "left").where("known is null or dist < known").select(group, "id", "dist"))
        older, best = best, durable(best.unionByName(changed).groupBy(group, "id").agg(F.min("dist").alias("dist")))
        release(older)
    return best


def votes(scored: DataFrame, described: DataFrame, calls: DataFrame, group: str, weight: float = 0.8, spill: float = 0.5, fan: int = 20) -> DataFrame:
    """(group, id, vote): what documentation says of code.

    A chunk gives ``weight`` times its score to what it describes, the best counts;
    half of that is spilled along calls, except from elements with more than ``fan``.
    """
    direct = scored.join(described, "chunk").groupBy(group, F.col("target").alias("id")).agg(F.max(F.col("score") * weight).alias("vote"))
    steps = calls.select("source", "target").distinct()
    narrow = steps.join(steps.groupBy("source").agg(F.count("*").alias("out")).where(F.col("out") <= fan).select("source"), "source", "left_semi")
    spread = direct.join(narrow, F.col("id") == F.col("source")).groupBy(group, F.col("target").alias("id")).agg(F.max(F.col("vote") * spill).alias("vote"))
    return direct.unionByName(spread).groupBy(group, "id").agg(F.round(F.max("vote"), 9).alias("vote"))


def missing(new: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key hasn't been worked on yet."""
    return new.join(done.select(*keys).distinct(), keys, "left_anti")
