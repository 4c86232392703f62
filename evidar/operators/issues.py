"""Rankings from earlier reports, and links between reports and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.functions.text import closed_reports, pr_of
from evidar.tables import stored

from . import blocks, index
from .rank import DEPTH, ranked


def closing_links(units: DataFrame, reports: DataFrame, slug: str | None = None) -> DataFrame:
    """(n, h): reports that a commit's message, or the text of its pull request, closes by keyword.

    With a ``slug`` (owner/name) the repository's own long forms and addresses count too.
    """
    message = F.coalesce("msg", F.lit(""))
    own = units.select("h", F.explode(closed_reports(message, slug)).alias("n"))
    requests = reports.where("pr").select(F.col("n").alias("request"), F.coalesce("body", F.lit("")).alias("body"))
    through = units.select("h", pr_of(message).alias("request")).join(requests, "request").select("h", F.explode(closed_reports(F.col("body"), slug)).alias("n"))
    return own.unionByName(through).select("n", "h").distinct()


def commit_reports(units: DataFrame, reports: DataFrame, links: DataFrame) -> DataFrame:
    """(h, n, own): the closed reports of a commit that are no pull requests, then its own pull request."""
    closed = links.join(reports.where("not pr").select(F.col("n").cast("bigint").alias("n")), "n").select("h", "n", F.lit(0).alias("own"))
    mine = units.select("h", pr_of(F.coalesce("msg", F.lit(""))).alias("n")).join(reports.where("pr").select("n"), "n").select("h", F.col("n").cast("bigint").alias("n"), F.lit(1).alias("own"))
    return closed.unionByName(mine).distinct()


def fixed_elements(links: DataFrame, units: DataFrame) -> DataFrame:
    """(n, key): distinct elements that the commits linked to a report touched."""
    touched = units.select(F.col("h").alias("u"), F.explode("touch").alias("key"))
    return links.where("type = 'fixed'").select("n", "u").distinct().join(touched, "u").select("n", "key").distinct()


def _weighed(queries: DataFrame, reports: DataFrame, query_key: str, terms) -> tuple[DataFrame, DataFrame, int]:
    """Queries and reports (doc) under smoothed tf-idf of the reports, and the number of the reports' postings."""
    docs = reports.select(F.col("n").alias("doc"), "text")
    post = stored(index.postings(docs, ["doc"], F.col("text"), terms))
    df, count = index.frequencies(post), docs.count()
    asked = index.tfidf(index.postings(queries, [query_key], F.col("text"), terms), df, [query_key], count, smooth=True)
    return asked, index.tfidf(post, df, ["doc"], count, smooth=True), post.count()


def similar_reports(queries: DataFrame, reports: DataFrame, query_key: str, terms=index.tokenize_code) -> DataFrame:
    """(query, doc, sim): cosine under smoothed tf-idf between a query and every report with a common term, itself left out.

    That is nearly every pair; ``most_similar`` and ``simi_rank`` list the best without listing all.
    """
    asked, weights, count = _weighed(queries, reports, query_key, terms)
    found = blocks.products(asked, weights, query_key, "doc", count=count)
    return found.where(F.col(query_key) != F.col("doc")).select(query_key, "doc", F.round("score", 9).alias("sim"))


def most_similar(queries: DataFrame, reports: DataFrame, query_key: str, depth: int, terms=index.tokenize_code, among: DataFrame | None = None, margin: int | None = None) -> DataFrame:
    """(query, doc, sim, rank): the ``depth`` best of ``similar_reports``, ties by doc.

    With ``among`` (doc) only these are listed; with ``margin`` those written so many
    seconds before the query (reports and queries have ``created``; without a time there is no pair).
    """
    asked, weights, count = _weighed(queries, reports, query_key, terms)
    if among is not None:
        weights = weights.join(among.select("doc").distinct(), "doc", "left_semi")
    if margin is not None:
        weights = weights.join(reports.where("created is not null").select(F.col("n").alias("doc"), F.col("created").alias("at")), "doc")
        asked = asked.join(queries.where("created is not null").select(query_key, (F.col("created") - margin).alias("until")), query_key)
    # one more, since a query's own report may be in its list
    found = blocks.products(asked, weights, query_key, "doc", depth + 1, count)
    found = found.where(F.col(query_key) != F.col("doc")).withColumnRenamed("score", "sim")
    return ranked(found, query_key, [F.desc("sim"), F.asc("doc")], depth)


def simi_rank(queries: DataFrame, reports: DataFrame, fixed: DataFrame, elements: DataFrame, query_key: str, terms=index.tokenize_code, depth: int = DEPTH) -> DataFrame:
    """``simi_score`` of the ``similar_reports``, of which no list is made."""
    asked, weights, _ = _weighed(queries, reports, query_key, terms)
    fix = fixed.select(F.col("n").alias("doc"), "key")
    size = fix.groupBy("doc").agg(F.count("*").alias("size"))
    belongs = fix.join(size, "doc").join(elements.select("key"), "key", "left_semi").withColumn("plus", F.lit(0.0))
    scored = blocks.gathered(asked, weights, belongs, query_key, "doc", "key", "sum", depth, other=True)
    return ranked(scored, query_key, [F.desc("score"), F.asc("key")], depth)


def known_before(similar: DataFrame, queries: DataFrame, reports: DataFrame, query_key: str, doc_key: str = "doc", margin: int = 86400) -> DataFrame:
    """Pairs (query, doc) of which the report had been written ``margin`` seconds before the query; neither time may be null."""
    asked = queries.select(query_key, F.col("created").alias("asked__"))
    told = reports.select(F.col("n").alias(doc_key), F.col("created").alias("told__"))
    return similar.join(asked, query_key).join(told, doc_key).where(F.col("told__") <= F.col("asked__") - margin).drop("asked__", "told__")


def simi_score(similar: DataFrame, fixed: DataFrame, elements: DataFrame, query_key: str, doc_key: str, depth: int = DEPTH) -> DataFrame:
    """(query, key, score, rank): sum over similar reports of similarity divided by the number of elements they fixed."""
    fix = fixed.select(F.col("n").alias(doc_key), "key")
    size = fix.groupBy(doc_key).agg(F.count("*").alias("size"))
    shared = similar.join(size, doc_key).join(fix, doc_key)
    scored = shared.groupBy(query_key, "key").agg(F.round(F.sum(F.col("sim") / F.col("size")), 9).alias("score")).where("score > 0")
    return ranked(scored.join(elements.select("key"), "key", "left_semi"), query_key, [F.desc("score"), F.asc("key")], depth)
