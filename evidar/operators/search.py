"""Search over elements and passages by name, by words and by vector, and the older search over the graph."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidar.functions.terms import issue_terms

from . import rank
from .graph import ball
from .rank import ranked

#: seeds by name and by words, most elements of a neighbourhood
SEEDS, WORD_SEEDS, NODES = 30, 15, 60


def label_order(label: str = "label") -> Column:
    """Functions first, then classes, then the rest."""
    low = F.lower(label)
    return F.when(low.isin("function", "method"), 0).when(low == "class", 1).otherwise(2)


def embed_text(nodes: DataFrame, limit: int = 2000) -> Column:
    """What an element's vector is made of: the beginning of its source, or label and name without one."""
    source = F.substring("source", 1, limit)
    return F.when(F.length(F.trim("source")) > 0, source).otherwise(F.concat_ws(" ", "label", "name"))


def passage_text() -> Column:
    """What a passage's vector is made of: heading and text on a line each, or the text alone."""
    return F.when(F.coalesce(F.length("heading"), F.lit(0)) > 0, F.concat("heading", F.lit("\n"), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))


def words(queries: DataFrame, docs: DataFrame, group: str = "n", key: str = "id", top: int = 10) -> DataFrame:
    """(group, key, score, rank): elements by BM25 of (key, text), only those with a word of the query."""
    return rank.bm25(queries, docs, group, key, top).where("score > 0")


def english_words(queries: DataFrame, nodes: DataFrame, stop: list[str], group: str = "n", top: int = WORD_SEEDS) -> DataFrame:
    """(group, id, score, rank): elements by the stems of their names and sources, weighed as a full-text index would (k1 1.2, b 0.75)."""
    docs = nodes.select("id", F.concat_ws(" ", "name", "source").alias("text"))
    asked = queries.select(group, plain_query(F.col("text")).alias("text"))
    return rank.bm25(asked, docs, group, "id", top, terms=lambda t: issue_terms(t, stop), k1=1.2, b=0.75).where("score > 0")


def everything(queries: DataFrame, code: DataFrame, chunks: DataFrame, group: str = "n", top: int = 50) -> DataFrame:
    """(group, id, score, rank): elements and passages (id, text) by words, in one list."""
    return words(queries, code.select("id", "text").unionByName(chunks.select("id", "text")), group, "id", top)


def reranked(candidates: DataFrame, queries: DataFrame, texts: DataFrame, score, group: str = "n", key: str = "id", top: int = 50) -> DataFrame:
    """(group, key, score, rank): candidates in the order of a model that reads a query and a text together.

    ``score`` gets a list of pairs and gives a number for each; candidates without a
    text are left out.
    """
    pairs = candidates.select(group, key).distinct().join(queries.select(group, F.col("text").alias("asked")), group).join(texts.select(key, "text"), key).where("text is not null and asked is not null")
    kinds = [pairs.schema[c].dataType.simpleString() for c in (group, key)]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                got = score(list(zip(part.column(2).to_pylist(), part.column(3).to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([float(x) for x in got], pa.float64())], [group, key, "score"])

    told = pairs.select(group, key, "asked", "text").mapInArrow(run, f"{group} {kinds[0]}, {key} {kinds[1]}, score double")
    return ranked(told.withColumn("score", F.round("score", 9)), group, [F.desc("score"), F.asc(key)], top)


def covered(near: DataFrame, voted: DataFrame, group: str = "n") -> DataFrame:
    """(group, id): elements that are near a list or that documentation votes for, once each."""
    return near.select(group, "id").unionByName(voted.select(group, "id")).distinct()


def hybrid(by_words: DataFrame, by_vector: DataFrame, group: str = "n", key: str = "id", top: int = 10, pool: int = 50) -> DataFrame:
    """(group, key, score, rank): fusion of the first ``pool`` of both lists, ranks counted from 0."""
    lists = [x.where(F.col("rank") <= pool).select(group, key, (F.col("rank") - 1).alias("rank")) for x in (by_words, by_vector)]
    return rank.rrf(lists, group, key, depth=top)


def passages(queries: DataFrame, code: DataFrame, chunks: DataFrame, described: DataFrame, vectors: DataFrame | None = None, group: str = "n", size: int = 10) -> DataFrame:
    """(group, id, score, bm25, cos, rank): passages by words and by vector, both ranked among the candidates, from 0.

    Candidates are the passages that describe something (``described`` has chunk),
    or all if none does.  Words weigh as in the elements and passages together
    (``code``, ``chunks``: id, text).  The list by words holds the 500 best candidates;
    by vector they are ranked among themselves, ``vectors`` (group, id, cos), a passage
    without counting 0.  Ties go by id.
    """
    both = code.select("id", "text").unionByName(chunks.select("id", "text"))
    own = chunks.select("id").distinct()
    told = own.join(described.select(F.col("chunk").alias("id")).distinct(), "id", "left_semi")
    candidates = own if told.isEmpty() else told
    rows = rank.bm25(queries, both, group, "id", only=candidates).select(group, "id", F.col("score").alias("bm25"))
    rows = rows.withColumn("cos", F.lit(0.0)) if vectors is None else rows.join(vectors.select(group, "id", "cos"), [group, "id"], "left").withColumn("cos", F.coalesce("cos", F.lit(0.0)))
    placed = ranked(ranked(rows, group, [F.desc("bm25"), F.asc("id")], base=0, out="a"), group, [F.desc("cos"), F.asc("id")], base=0, out="b")
    score = F.round(1.0 / (rank.RRF_K + F.col("a")) + 1.0 / (rank.RRF_K + F.col("b")), 9)
    return ranked(placed.withColumn("score", score).drop("a", "b"), group, [F.desc("score"), F.asc("id")], size)


def name_seeds(names: DataFrame, nodes: DataFrame, group: str = "n", limit: int = SEEDS) -> DataFrame:
    """(group, id, label, place): elements of that name or file, or whose file ends in the name and .py; the first ``limit`` by label and id."""
    ends = nodes.where("file is not null").select("id", "label", F.explode(F.array_distinct(F.concat(F.array("file"), F.transform(rank.suffixes(F.col("file")), lambda e: e)))).alias("name"), "file")
    # a whole file, or what follows a slash without the ending
    by_file = ends.where((F.col("name") == F.col("file")) | (F.col("file").endswith(".py") & ~F.col("name").endswith(".py") & F.col("file").endswith(F.concat(F.lit("/"), "name", F.lit(".py"))))).select("id", "label", "name")
    hits = names.select(group, "name").distinct().join(nodes.select("id", "label", "name").unionByName(by_file), "name").select(group, "id", "label").distinct()
    return ranked(hits, group, [label_order(), F.asc("id")], limit, out="place")


def seeds(by_name: DataFrame, by_words: DataFrame, group: str = "n") -> DataFrame:
    """(group, id, by_name): seeds by name, and those by words that aren't among them."""
    a = by_name.select(group, "id").distinct()
    b = by_words.select(group, "id").distinct().join(a, [group, "id"], "left_anti")
    return a.withColumn("by_name", F.lit(True)).unionByName(b.withColumn("by_name", F.lit(False)))


def plain_query(text: Column) -> Column:
    """A query without the signs a query language would read, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r'[+\-&|!(){}\[\]^"~*?:\\/]', " "), r"\s+", " "))


def neighbourhood(seeds: DataFrame, steps: DataFrame, group: str = "n", depth: int = 2, most: int = NODES) -> DataFrame:
    """(group, id, hop, place): what is within ``depth`` steps (1 to 3) of the seeds, the first ``most`` by distance and id."""
    near = ball(seeds.select(group, "id"), steps, group, min(3, max(1, depth)))
    return ranked(near, group, [F.asc("hop"), F.asc("id")], most, out="place")


def graph_context(near: DataFrame, seeds: DataFrame, edges: DataFrame, nodes: DataFrame, group: str = "n", cut: int = 3000) -> DataFrame:
    """(group, text): sources of a neighbourhood: seeds, then what calls or is called by them, then the rest; each cut to ``cut`` characters."""
    own = seeds.select(group, "id").distinct().withColumn("seed", F.lit(True))
    calls = edges.where("lower(type) in ('calls', 'uses')")
    both = calls.select(F.col("source").alias("id"), F.col("target").alias("other")).unionByName(calls.select(F.col("target").alias("id"), F.col("source").alias("other")))
    linked = both.join(own.select(group, F.col("id").alias("other")), "other").select(group, "id").distinct().withColumn("linked", F.lit(True))
    rows = near.join(own, [group, "id"], "left").join(linked, [group, "id"], "left").join(nodes.select("id", "label", "name", "file", "source"), "id")
    order = F.when(F.col("seed"), 0).when(F.col("linked"), 1).otherwise(2)
    told = F.concat(F.lit("# "), F.coalesce("file", F.lit("")), F.lit(" "), "label", F.lit(" "), F.coalesce("name", F.lit("")), F.lit("\n"), F.coalesce(F.substring("source", 1, cut), F.lit("")))
    return rows.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "place", told.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def voted_files(near: DataFrame, seeds: DataFrame, nodes: DataFrame, group: str = "n") -> DataFrame:
    """(group, file, votes, place): files by their elements in a neighbourhood: 3 for a seed, 1 for another; ties by file."""
    own = seeds.select(group, "id").distinct().withColumn("seed", F.lit(True))
    votes = near.join(own, [group, "id"], "left").join(nodes.where("file is not null").select("id", "file"), "id").groupBy(group, "file").agg(F.sum(F.when(F.col("seed"), 3).otherwise(1)).cast("bigint").alias("votes"))
    return ranked(votes, group, [F.desc("votes"), F.asc("file")], out="place")


def matching_files(nodes: DataFrame, part: str) -> DataFrame:
    """(file): files whose path has ``part`` in it, upper and lower case alike."""
    return nodes.where(F.lower("file").contains(part.lower())).select("file").distinct()


def visible(nodes: DataFrame, edges: DataFrame, labels: list[str], types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the labels and edges of the types; an edge is hidden if one of its ends is."""
    shown = nodes.where(F.col("label").isin(labels))
    ids = shown.select("id").distinct()
    kept = edges.where(F.col("type").isin(types)).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return shown, kept.select(*edges.columns)


def mentions(texts: DataFrame, names: DataFrame, group: str = "n") -> DataFrame:
    """(group, name): names that stand in a text as whole words.

    Names are one word each, so a text's words are looked up; dotted names are looked
    up as their parts in a row.
    """
    found = texts.select(group, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), 0))).alias("name"))
    whole = found.join(names.select("name").distinct().where(~F.col("name").contains(".")), "name").select(group, "name")
    dotted = names.select("name").distinct().where(F.col("name").contains(".")).withColumn("first", F.element_at(F.split("name", r"\."), 1))
    maybe = found.withColumnRenamed("name", "first").join(dotted, "first").select(group, "name").distinct().join(texts.select(group, "text"), group)
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), "name", F.lit(r"\E(?![\p{L}\p{N}_])"))
    return whole.unionByName(maybe.where(F.regexp_like("text", pattern)).select(group, "name")).distinct()
