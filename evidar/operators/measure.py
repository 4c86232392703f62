"""Measures of evidence and of reading, and tests on paired results."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidar.tables import durable

from .rank import ranked

#: rounds and seed of permutation tests; depth to which gold is looked for
ROUNDS, SEED, DEPTH_MAX = 10_000, 20261021, 3
#: fixed values: labels that exclude all others
EXCLUSIVE = ("no_new_information", "unrelated")


def overlap(left: DataFrame, right: DataFrame, group: str, key: str, top: int = 10) -> DataFrame:
    """(group, overlap): how many of the first ``top`` of two lists (group, key, rank) are the same."""
    a = left.where(F.col("rank") <= top).select(group, key).distinct()
    b = right.where(F.col("rank") <= top).select(group, key).distinct()
    shared = a.join(b, [group, key]).groupBy(group).agg(F.count("*").alias("overlap"))
    groups = a.select(group).unionByName(b.select(group)).distinct()
    return groups.join(shared, group, "left").select(group, F.coalesce("overlap", F.lit(0)).cast("bigint").alias("overlap"))


def kept_evidence(judged: DataFrame, kept, group: str = "n") -> DataFrame:
    """One row on what a rule keeps (a Column) of judged evidence (group, useful 0 or 1, tokens).

    precision, recall, f1 over all items (null where nothing could be counted), t11u
    (mean of 2 hits - false ones), the four counts of groups by whether anything is
    kept and whether anything useful is there, and the mean of tokens kept.
    """
    rows = judged.withColumn("keep__", F.coalesce(kept, F.lit(False)).cast("int")).withColumn("useful__", F.coalesce("useful", F.lit(0)).cast("int"))
    one = rows.groupBy(group).agg(
        F.sum("useful__").alias("there"), F.sum(F.col("useful__") * F.col("keep__")).alias("tp"), F.sum("keep__").alias("shown"), F.sum(F.col("keep__") * F.coalesce("tokens", F.lit(0))).alias("tok")
    ).withColumn("fp", F.col("shown") - F.col("tp")).withColumn("fn", F.col("there") - F.col("tp"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    count = lambda empty, has: F.sum(((F.col("shown") == 0) == empty).cast("bigint") * ((F.col("there") > 0) == has).cast("bigint"))
    return one.agg(
        F.round(F.when(tp + fp > 0, tp / (tp + fp)), 6).alias("precision"), F.round(F.when(tp + fn > 0, tp / (tp + fn)), 6).alias("recall"), F.round(F.when(tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)), 6).alias("f1"),
        F.round(F.avg(2 * F.col("tp") - F.col("fp")), 6).alias("t11u"), count(True, True).alias("empty_has"), count(True, False).alias("empty_none"), count(False, True).alias("shown_has"), count(False, False).alias("shown_none"),
        F.round(F.avg("tok"), 6).alias("mean_tokens"),
    )


def type_shares(judged: DataFrame, kind: str = "kind", types: str = "info_types") -> DataFrame:
    """(kind, type, items, share): how many items of a kind have a type; an item may have several."""
    size = judged.groupBy(kind).agg(F.count("*").alias("all"))
    each = judged.select(kind, F.explode(F.array_distinct(types)).alias("type")).groupBy(kind, "type").agg(F.count("*").alias("items"))
    return each.join(size, kind).select(kind, "type", "items", F.round(F.col("items") / F.col("all"), 6).alias("share"))


def mean_jaccard(judged: DataFrame, left: str, right: str) -> DataFrame:
    """(n, jaccard): mean similarity of two sets of types over items; two empty sets are alike."""
    both = F.size(F.array_union(left, right))
    return judged.agg(F.count("*").alias("n"), F.round(F.avg(F.when(both > 0, F.size(F.array_intersect(left, right)) / both).otherwise(1.0)), 6).alias("jaccard"))


def quality_by_position(judged: DataFrame, position: str = "pos") -> DataFrame:
    """(pos, n, useful, usefulness, relevance): shares and means of items by their place in a list."""
    return judged.groupBy(position).agg(F.count("*").alias("n"), F.round(F.avg("useful"), 6).alias("useful"), F.round(F.avg("usefulness"), 6).alias("usefulness"), F.round(F.avg("relevance"), 6).alias("relevance"))


def audit(judged: DataFrame, kind: str = "kind") -> DataFrame:
    """(kind, items, ...): how often judgements go against the rules; kind is null for all.

    Items called more useful than relevant, useful (2) though hardly relevant (1), very
    useful (3) though not fully relevant, useful though they only name a place, and
    irrelevant ones said to be known.
    """
    u, r, t = F.col("usefulness"), F.col("relevance"), F.col("info_types")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    return judged.groupingSets([[kind], []], kind).agg(
        F.count("*").alias("items"), count(u > r).alias("over"), count((u == 2) & (r == 1)).alias("two_of_one"), count((u == 3) & (r <= 2)).alias("three_of_two"),
        count((F.size(t) == 1) & F.array_contains(t, "code_location") & (u >= 2)).alias("place_only"), count(F.array_contains(t, "no_new_information") & (r == 0)).alias("known_irrelevant"),
    )


def complement(judged: DataFrame, left: str, right: str, group: str = "n", kind: str = "kind") -> DataFrame:
    """(n, only_left, only_right, both, neither): groups by which of two kinds of evidence has something useful."""
    has = judged.groupBy(group).pivot(kind, [left, right]).agg(F.max("useful"))
    a, b = F.coalesce(F.col(left), F.lit(0)) > 0, F.coalesce(F.col(right), F.lit(0)) > 0
    count = lambda c: F.sum(c.cast("bigint"))
    return has.agg(F.count("*").alias("n"), count(a & ~b).alias("only_left"), count(~a & b).alias("only_right"), count(a & b).alias("both"), count(~a & ~b).alias("neither"))


def lengths(requests: DataFrame, text: str = "text") -> DataFrame:
    """(n, mean, p90, most): lengths of texts; the percentile is exact, between two values by their distance."""
    size = F.length(text)
    return requests.agg(F.count("*").alias("n"), F.round(F.avg(size), 6).alias("mean"), F.round(F.percentile(size, 0.9), 6).alias("p90"), F.max(size).cast("bigint").alias("most"))


def token_gap(sections: DataFrame, group: str = "n", total: str = "total") -> DataFrame:
    """(group, sum, gap): tokens of the sections of a request (group, tokens, total), and what share of its total they leave out."""
    s = F.sum("tokens")
    return sections.groupBy(group).agg(s.alias("sum"), F.round(F.when(F.max(total) > 0, (F.max(total) - s) / F.max(total)), 4).alias("gap"))


def documentation_counts(chunks: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chunks, linked_chunks, links, elements): passages, those that describe something, descriptions, and what is described."""
    real = edges.select("chunk", "target").distinct().join(nodes.select(F.col("id").alias("target")).distinct(), "target", "left_semi").join(chunks.select(F.col("id").alias("chunk")).distinct(), "chunk", "left_semi")
    got = real.agg(F.countDistinct("chunk").alias("linked_chunks"), F.count("*").alias("links"), F.countDistinct("target").alias("elements")).first()
    return chunks.agg(F.countDistinct("id").alias("chunks")).select("chunks", *[F.lit(got[c]).cast("bigint").alias(c) for c in ("linked_chunks", "links", "elements")])


def lines_of_code(nodes: DataFrame) -> DataFrame:
    """(label, n, mean_lines): how many elements of a label have lines, and how many on average."""
    size = F.col("end_line") - F.col("start_line") + 1
    return nodes.where("start_line is not null and end_line is not null and label <> 'Module'").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(size), 6).alias("mean_lines"))


def level_sizes(seeds: DataFrame, gold: DataFrame, steps: DataFrame, group: str) -> DataFrame:
    """(group, layer, size, hits): per group how many elements each layer around its seeds has, and how many of them are gold.

    ``seeds`` and ``gold`` have (group, id), ``steps`` (a, b) in both directions.
    Layers are followed until a group has met gold or has no more neighbours.
    """
    steps = durable(steps.distinct())
    wanted = durable(gold.select(group, "id").distinct())
    seen = frontier = durable(seeds.select(group, "id").distinct())
    open_ = wanted.select(group).distinct()
    layer, out = 0, []
    while True:
        hits = frontier.join(wanted.withColumn("hit", F.lit(1)), [group, "id"], "left")
        out.append(durable(hits.groupBy(group).agg(F.count("*").alias("size"), F.sum(F.coalesce("hit", F.lit(0))).cast("bigint").alias("hits")).withColumn("layer", F.lit(layer))))
        open_ = durable(open_.join(out[-1].where("hits > 0").select(group), group, "left_anti"))
        found = frontier.join(open_, group, "left_semi").join(steps, F.col("id") == F.col("a")).select(group, F.col("b").alias("id")).distinct()
        frontier = durable(found.join(seen, [group, "id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = durable(seen.unionByName(frontier))
        layer += 1
    return reduce(lambda a, b: a.unionByName(b), out).select(group, "layer", "size", "hits")


def reading_effort(listed: DataFrame, gold: DataFrame, steps: DataFrame, group: str, top: int, total: int) -> DataFrame:
    """(group, effort, layer): elements to read until gold is met: the list's first ``top``, then its surroundings layer by layer.

    Gold in the list counts by its place; gold in a layer of n elements, g of them gold,
    at (n + 1) / (g + 1) within it; without any the effort is ``total`` and the layer
    null.  ``listed`` has (group, id, rank); groups without gold have no row.
    """
    seeds = durable(listed.where(F.col("rank") <= top).select(group, "id", "rank"))
    wanted = gold.select(group, "id").distinct()
    direct = seeds.join(wanted, [group, "id"]).groupBy(group).agg(F.min("rank").cast("double").alias("effort")).withColumn("layer", F.lit(0))
    rest = wanted.select(group).distinct().join(direct.select(group), group, "left_anti")
    layers = level_sizes(seeds.join(rest, group, "left_semi").select(group, "id"), wanted.join(rest, group, "left_semi"), steps, group)
    before = F.sum("size").over(Window.partitionBy(group).orderBy("layer").rowsBetween(Window.unboundedPreceding, -1))
    met = layers.withColumn("read", F.coalesce(before, F.lit(0))).where("hits > 0 and layer > 0").groupBy(group).agg(F.min(F.struct("layer", "read", "size", "hits")).alias("x"))
    met = met.select(group, (F.col("x.read") + (F.col("x.size") + 1) / (F.col("x.hits") + 1)).alias("effort"), F.col("x.layer").alias("layer"))
    reached = direct.unionByName(met)
    lost = wanted.select(group).distinct().join(reached.select(group), group, "left_anti").select(group, F.lit(float(total)).alias("effort"), F.lit(None).cast("int").alias("layer"))
    return reached.unionByName(lost).select(group, F.round("effort", 6).alias("effort"), "layer")


def effort_summary(effort: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, median, mean, unreachable): exact median and mean of effort, and the share that met no gold."""
    return effort.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.median("effort"), 6).alias("median"), F.round(F.avg("effort"), 6).alias("mean"), F.round(F.avg(F.col("layer").isNull().cast("int")), 6).alias("unreachable"))


def depth_shares(listed: DataFrame, reached: DataFrame, group: str, top: int = 10, most: int = DEPTH_MAX) -> DataFrame:
    """(group, depth, share): shares of the first ``top`` by how far the nearest gold is; ``most`` + 1 stands for farther.

    ``reached`` has (group, id, hop) around the gold.
    """
    rows = listed.where(F.col("rank") <= top).join(reached.select(group, "id", "hop"), [group, "id"], "left").withColumn("depth", F.coalesce("hop", F.lit(most + 1)))
    size = rows.groupBy(group).agg(F.count("*").alias("all"))
    return rows.groupBy(group, "depth").agg(F.count("*").alias("times__")).join(size, group).select(group, "depth", F.round(F.col("times__") / F.col("all"), 6).alias("share"))


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the rank of a value among all rows, equal ones sharing the mean of their ranks; null values have none.

    The rows are the instances of a study; distinct values are ranked, so that equal
    ones are counted before they meet.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n__"))
    below = F.coalesce(F.sum("n__").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select(value, (below + (F.col("n__") + 1) / 2).alias(out))
    return df.join(placed, value, "left")


def spearman(df: DataFrame, x: str, y: str) -> float | None:
    """Correlation of average ranks; None where a side has one value only."""
    both = average_ranks(average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y), x, "rx"), y, "ry")
    got = both.agg(F.covar_pop("rx", "ry").alias("c"), F.stddev_pop("rx").alias("x"), F.stddev_pop("ry").alias("y")).first()
    return float(got.c / (got.x * got.y)) if got.x and got.y else None


def permuted(x, y, rounds: int = ROUNDS, seed: int = SEED) -> float | None:
    """Two-sided p of the correlation of two columns of ranks, from ``rounds`` permutations of one: (hits + 1) / (rounds + 1)."""
    x, y = (np.asarray(v, float) - np.mean(v) for v in (x, y))
    size = np.sqrt((x**2).sum() * (y**2).sum())
    if not size:
        return None
    rng, seen = np.random.default_rng(seed), abs(x @ y)
    hits = sum(abs(rng.permutation(y) @ x) >= seen - 1e-12 for _ in range(rounds))
    return (int(hits) + 1) / (rounds + 1)


def stratified(values, group, strata, rounds: int = ROUNDS, seed: int = SEED) -> tuple[float | None, float | None]:
    """Difference of the means of a group and the rest, and its two-sided p when labels are permuted within strata."""
    v, g, s = np.asarray(values, float), np.asarray(group, bool), np.asarray(strata)
    if not len(v) or g.all() or not g.any():
        return None, None
    gap = lambda m: v[m].mean() - v[~m].mean()
    seen, rng, hits = gap(g), np.random.default_rng(seed), 0
    parts, mixed = [np.flatnonzero(s == k) for k in np.unique(s)], g.copy()
    for _ in range(rounds):
        for part in parts:
            mixed[part] = rng.permutation(g[part])
        hits += abs(gap(mixed)) >= abs(seen) - 1e-12
    return float(seen), (hits + 1) / (rounds + 1)


def mapped_gold(gold: DataFrame, nodes: DataFrame, group: str = "n") -> tuple[DataFrame, DataFrame]:
    """Gold (group, key) that a snapshot's nodes (id) have, as (group, key, id), and per group how many it hasn't (group, dropped)."""
    ids = nodes.select("id", F.regexp_replace("id", "^[^:]*:", "").alias("key"))
    kept = gold.select(group, "key").distinct().join(ids, "key").select(group, "key", "id")
    lost = gold.select(group, "key").distinct().join(ids.select("key").distinct(), "key", "left_anti").groupBy(group).agg(F.count("*").alias("dropped"))
    return kept, lost


def labels(answers: DataFrame, types: tuple[str, ...], group: str = "key") -> DataFrame:
    """(key, alias, relevance, usefulness, info_types) of judges' answers (key, answer, aliases).

    An answer is a JSON array, by itself or in other text; it counts only if every
    alias is judged once or more (the first counts), both grades lie in 0..3 and the
    types are known ones.  An excluding type beside others: of an irrelevant item only
    ``unrelated`` stays and it is useless; of a useless one with no_new_information
    only that; otherwise the excluding ones go.
    """
    schema = "array<struct<id: string, relevance: double, usefulness: double, info_types: array<string>>>"
    whole = F.from_json("answer", schema)
    inner = F.from_json(F.regexp_extract("answer", r"(?s)\[.*\]", 0), schema)
    items = answers.select(group, "aliases", F.posexplode(F.coalesce(whole, inner)).alias("place", "x"))
    known = F.array(*[F.lit(t) for t in types])
    grade = lambda c: F.floor(c).between(0, 3) & c.isNotNull()
    good = items.where(F.array_contains("aliases", F.trim("x.id")) & grade(F.col("x.relevance")) & grade(F.col("x.usefulness")) & (F.size("x.info_types") > 0) & (F.size(F.array_except("x.info_types", known)) == 0))
    first = good.groupBy(group, F.trim("x.id").alias("alias")).agg(F.min(F.struct("place", "x")).alias("y"), F.first("aliases").alias("aliases")).select(group, "alias", "aliases", F.floor("y.x.relevance").cast("int").alias("r"), F.floor("y.x.usefulness").cast("int").alias("u"), F.array_sort(F.array_distinct("y.x.info_types")).alias("t"))
    out = F.array(*[F.lit(t) for t in EXCLUSIVE])
    mixed = (F.size(F.array_intersect("t", out)) > 0) & (F.size("t") > 1)
    irrelevant, idle = mixed & (F.col("r") == 0), mixed & (F.col("u") == 0) & F.array_contains("t", "no_new_information")
    told = first.select(
        group, "alias", "aliases", F.col("r").alias("relevance"), F.when(irrelevant, 0).otherwise(F.col("u")).alias("usefulness"),
        F.when(irrelevant, F.array(F.lit("unrelated"))).when(idle, F.array(F.lit("no_new_information"))).when(mixed, F.array_except("t", out)).otherwise(F.col("t")).alias("info_types"),
    )
    full = told.groupBy(group).agg(F.count("*").alias("n"), F.max(F.size(F.array_distinct("aliases"))).alias("all")).where(F.col("n") == F.col("all"))
    return told.join(full.select(group), group, "left_semi").drop("aliases")
