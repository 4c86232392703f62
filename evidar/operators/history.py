"""Rankings from the history: commit texts, bug-fix recency and hunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidar.functions.text import hunk_body, is_bugfix, module_name
from evidar.tables import durable, stored

from . import blocks, index
from .rank import DEPTH, RRF_K, ranked

#: most elements a commit may touch; weight of recency; weight of code names
MAX_TOUCH, BETA, LAMBDA = 50, 0.1, 5.0


def touches(units: DataFrame) -> DataFrame:
    """(h, t, key): distinct touched elements of each commit; null and empty lists give none."""
    return units.select("h", "t", F.explode("touch").alias("key")).distinct()


def eligible(units: DataFrame, elements: DataFrame, most: int = MAX_TOUCH) -> DataFrame:
    """(h, t, n_touch): commits with 1 to ``most`` touched elements of which at least one is in ``elements``."""
    sized = units.where(F.size("touch").between(1, most)).select("h", "t", F.size("touch").cast("bigint").alias("n_touch"), "touch")
    hit = sized.select("h", F.explode("touch").alias("key")).join(elements.select("key"), "key", "left_semi").select("h").distinct()
    return sized.join(hit, "h", "left_semi").select("h", "t", "n_touch")


def fix_recency(units: DataFrame, at: int | None = None) -> DataFrame:
    """(key, fix): sum over bug-fix commits of a logistic of their age, 0 at the first commit and 1 at ``at`` (the last by default)."""
    span = units.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    start, end = span.a or 0, at if at is not None else (span.b or 0)
    age = F.least(F.greatest((F.col("t") - F.lit(start)) / F.lit(float(max(1, end - start))), F.lit(0.0)), F.lit(1.0))
    return touches(units.where(is_bugfix(F.coalesce("msg", F.lit(""))))).groupBy("key").agg(F.sum(1.0 / (1.0 + F.exp(-12.0 * age + 12.0))).alias("fix"))


def linked_texts(units: DataFrame, reports: DataFrame, linked: DataFrame) -> DataFrame:
    """(h, text): a commit's message with the titles and bodies of the reports linked to it (h, n, own), closed ones before its own pull request."""
    told = reports.select(F.col("n").cast("bigint").alias("n"), F.concat(F.lit("\n"), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))).alias("said"))
    more = linked.join(told, "n").groupBy("h").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("own", "n", "said"))), lambda x: x["said"]), "").alias("said"))
    return units.select("h", F.coalesce("msg", F.lit("")).alias("msg")).join(more, "h", "left").select("h", F.concat("msg", F.coalesce("said", F.lit(""))).alias("text"))


def before(units: DataFrame, ancestors: DataFrame, snapshot: str) -> DataFrame:
    """Commits that a snapshot comes from; ``ancestors`` has (snapshot, h)."""
    return units.join(ancestors.where(F.col("snapshot") == snapshot).select("h"), "h", "left_semi")


def message_scores(queries: DataFrame, units: DataFrame, query_key: str, depth: int | None = None, terms=index.tokenize_code) -> DataFrame:
    """(query, h, cos): cosine of query and commit text under tf-idf of the commits, where positive; with ``depth`` the best of each query.

    The text of a commit is its ``text`` if there is one, else its message.
    """
    asked, docs, count = _weighed(queries, units, query_key, "h", terms)
    return blocks.products(asked, docs, query_key, "h", depth, count).select(query_key, "h", F.round("score", 9).alias("cos")).where("cos > 0")


def _weighed(queries: DataFrame, units: DataFrame, query_key: str, key: str, terms) -> tuple[DataFrame, DataFrame, int]:
    """Queries and commits under tf-idf of the commits, and the number of the commits' postings."""
    text = F.col("text") if "text" in units.columns else F.coalesce("msg", F.lit(""))
    post = stored(index.postings(units.select(key, text.alias("text")), [key], F.col("text"), terms))
    df, count = index.frequencies(post), units.count()
    asked = index.tfidf(index.postings(queries, [query_key], F.col("text"), terms), df, [query_key], count)
    return asked, index.tfidf(post, df, [key], count), post.count()


#: from this place in the list by text on, scores of neighbours may be equal in nine digits
FAR = 30_000


def commit_scores(queries: DataFrame, fit: DataFrame, listed: DataFrame, query_key: str, depth: int, elements: DataFrame | None = None, terms=index.tokenize_code, far: int = FAR) -> DataFrame:
    """(query, h, t, cos, best, s): commits in the list by text or in the list by code, and what both give them.

    A commit's score adds 1 / (60 + rank) in the list by text and in the list by the
    best rank of its elements in ``listed`` (query, key, rank); ``cos`` is 0 and
    ``best`` null where it isn't in one.  Ties go to the newer commit, then by hash.

    Not all commits are given: those in the list by code, and of the others as many as
    the ``depth`` best commits can come from, or with ``elements`` (key) the best of each of
    the elements that the ``depth`` best elements can come from.  Their places are in the whole list.
    """
    scored, fit, _, _ = _scored(queries, fit, listed, query_key, depth, elements, terms, far)
    return scored.join(fit.select("o", "h", "t"), "o").select(query_key, "h", "t", "cos", "best", "s")


def _scored(queries: DataFrame, fit: DataFrame, listed: DataFrame, query_key: str, depth: int, elements: DataFrame | None, terms, far: int = FAR) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """(query, o, cos, best, s) and what the numbers mean: the commits with theirs (o), their elements (o, e), and the elements (key, e), by number as by key."""
    blocks.ready(fit.sparkSession)
    # o numbers the commits so that ties go by it
    text = "text" if "text" in fit.columns else "msg"
    fit = stored(fit.select("h", "t", text, "touch").orderBy(F.desc_nulls_last("t"), F.asc("h")).withColumn("o", F.monotonically_increasing_id()))
    touched = fit.select("o", F.explode("touch").alias("key")).distinct()
    near = touched.join(listed.select(query_key, "key", "rank"), "key").groupBy(query_key, "o").agg(F.min("rank").cast("bigint").alias("best"))
    near = durable(ranked(near, query_key, [F.asc("best"), F.asc("o")], out="near"))
    asked, docs, _ = _weighed(queries, fit, query_key, "o", terms)
    asked, docs = durable(blocks.packed(asked, query_key)), stored(blocks.packed(docs, "o"))
    own = names = None
    if elements is not None:
        names = stored(touched.join(elements.select("key"), "key", "left_semi").select("key").distinct().orderBy("key").withColumn("e", F.monotonically_increasing_id()))
        own = stored(touched.join(names, "key").select("o", "e"))
    first = [F.desc("score"), F.asc("o")]

    def head(asked: DataFrame, depth: int | None) -> DataFrame:
        """(query, o, score, lead): of the commits in the list by text those that count, with their cosines."""
        belongs = None if own is None else own.withColumnRenamed("e", "key")
        found = blocks.leading(asked, docs, near.select(query_key, "o"), query_key, "o", depth, belongs)
        if own is None:
            lead = ranked(found, query_key, first, depth).select(query_key, "o")
        else:
            pairs = found.join(own, "o").select(query_key, "o", "score", "e").repartition(F.col(query_key))
            keyed = ranked(ranked(pairs, [query_key, "e"], first, 1), query_key, [*first, F.asc("e")], depth)
            lead = keyed.select(query_key, "o").distinct()
        some = found.join(lead.withColumn("lead", F.lit(True)), [query_key, "o"], "left")
        some = durable(some.join(near.select(query_key, "o", "best"), [query_key, "o"], "left").where("lead or best is not null").select(query_key, "o", "score", "lead"))
        return durable(some.join(blocks.places(asked, docs, some, query_key, "o"), [query_key, "o"]))

    text = head(asked, depth)
    if own is not None:  # where the last of the list lies so far down that others may equal it, every element's best is taken
        deep = durable(text.where("lead").groupBy(query_key).agg(F.max("rank").alias("last")).where(F.col("last") > far).select(query_key))
        if not deep.isEmpty():
            text = text.join(deep, query_key, "left_anti").unionByName(head(durable(asked.join(deep, query_key, "left_semi")), None))
    none = F.lit(None)
    both = text.select(query_key, "o", F.col("score").alias("cos"), none.cast("bigint").alias("best"), "rank").unionByName(near.select(query_key, "o", F.lit(0.0).alias("cos"), "best", F.col("near").cast("bigint").alias("rank")))
    scored = both.groupBy(query_key, "o").agg(F.max("cos").alias("cos"), F.max("best").alias("best"), F.sum(1.0 / (RRF_K + F.col("rank"))).alias("s"))
    return scored, fit, own, names


def message_rank(queries: DataFrame, units: DataFrame, listed: DataFrame, elements: DataFrame, query_key: str, depth: int = DEPTH, terms=index.tokenize_code) -> DataFrame:
    """(query, key, score, rank): elements by their best commit, of those ``eligible`` lets through."""
    fit = units.join(eligible(units, elements).select("h"), "h", "left_semi")
    scored, _, own, names = _scored(queries, fit, listed, query_key, depth, elements, terms)
    best = scored.select(query_key, "o", "s").join(own, "o").groupBy(query_key, "e").agg(F.round(F.max("s"), 9).alias("score"))
    return ranked(best, query_key, [F.desc("score"), F.asc("e")], depth).join(names, "e").select(query_key, "key", "score", "rank")


def message_pool(queries: DataFrame, units: DataFrame, listed: DataFrame, elements: DataFrame, query_key: str, size: int = 10, terms=index.tokenize_code) -> DataFrame:
    """(query, h, t, cos, best, s, rank): the commits that say most, ties to the newer one, then by hash."""
    fit = stored(units.join(eligible(units, elements).select("h"), "h", "left_semi"))
    scored = commit_scores(queries, fit, listed, query_key, size, terms=terms).withColumn("s", F.round("s", 9))
    return ranked(scored, query_key, [F.desc("s"), F.desc("t"), F.asc("h")], size)


def pool_hunks(pool: DataFrame, hunks: DataFrame, query_key: str, size: int = 10) -> DataFrame:
    """(query, u, f, k, text, rank): the hunks of a pool's commits, in the order of the pool, as evidence."""
    rows = pool.drop("rank").join(hunks.select(F.col("u").alias("h"), "f", "k", "text"), "h")
    return ranked(rows, query_key, [F.desc("s"), F.desc("t"), F.asc("h"), F.asc("f"), F.asc("k")], size).select(query_key, F.col("h").alias("u"), "f", "k", "text", "rank")


def hunk_documents(hunks: DataFrame, units: DataFrame, message: int = 2000) -> DataFrame:
    """(hunk, ids, text): what a hunk (u, f, k, ids, text) says: its lines without marks, and the beginning of its commit's message."""
    said = units.select(F.col("h").alias("u"), F.substring(F.coalesce("msg", F.lit("")), 1, message).alias("msg"))
    text = F.concat(hunk_body(F.col("text")), F.lit("\n"), F.coalesce("msg", F.lit("")))
    return hunks.join(said, "u", "left").select(F.concat_ws("|", "u", "f", F.col("k").cast("string")).alias("hunk"), "ids", text.alias("text"))


def graph_names(nodes: DataFrame) -> DataFrame:
    """(term): names of functions and classes, and dotted names of Python modules, as reports write them."""
    own = nodes.where("label <> 'Module' and name <> ''").select(F.col("name").alias("term"))
    modules = nodes.where("label = 'Module'").where(F.coalesce("file", "name").endswith(".py")).select(module_name(F.coalesce("file", "name")).alias("term"))
    return own.unionByName(modules).distinct()


def locus(queries: DataFrame, hunks: DataFrame, units: DataFrame, names: DataFrame, elements: DataFrame, query_key: str, words, codes, depth: int = DEPTH, at: int | None = None) -> DataFrame:
    """(query, key, score, rank): best hunk of an element, in words and in code names, plus recency of its fixes at a time (``at``).

    ``hunks`` has (hunk, key list ``ids``, text), ``queries`` (key, text), ``names``
    (term): code terms count only if they are names.  ``words`` and ``codes`` make
    terms from a text.  An element with fixes only is ranked too; scores of 0 aren't.
    """
    count = hunks.count()
    # hunks and elements go as numbers, those of elements in the order of their keys, so that ties go by them
    numbers = stored(hunks.select("hunk").distinct().withColumn("o", F.monotonically_increasing_id()))
    hunks = stored(hunks.join(numbers, "hunk").select("o", "ids", "text"))
    # words and names of code are terms of two kinds in one index, each kind with rows of unit length; so
    # one product gives the sum of both sides
    marked = lambda kind, own: F.transform(own, lambda w: F.concat(F.lit(kind), w))
    both = lambda t: F.concat(marked("n:", words(t)), marked("c:", codes(t)))
    known = names.select(F.concat(F.lit("c:"), "term").alias("term"), F.lit(True).alias("known")).distinct()

    def sided(rows: DataFrame, key: str) -> DataFrame:
        found = index.postings(rows, [key], F.col("text"), both).join(known, "term", "left").where(F.col("known") | F.col("term").startswith("n:"))
        return stored(found.select(key, F.substring("term", 1, 1).alias("side"), "term", "tf"))

    post, asked = sided(hunks, "o"), sided(queries, query_key)
    df = index.frequencies(post)
    total = queries.select(query_key, F.size(index.tokenize_code(F.col("text"))).alias("tokens"))
    alpha = total.join(asked.where("side = 'c'").groupBy(query_key).agg(F.sum("tf").alias("names")), query_key, "left").select(
        query_key, F.least(F.lit(1.0), LAMBDA * F.coalesce("names", F.lit(0)) / F.greatest(F.lit(1), "tokens")).alias("alpha")
    )
    weighed = index.tfidf(asked, df, [query_key, "side"], count).join(alpha, query_key).select(query_key, "term", (F.col("w") * F.when(F.col("side") == "c", F.col("alpha")).otherwise(1.0)).alias("w"))
    fix = durable(fix_recency(units, at).join(elements.select("key"), "key", "left_semi"))
    told = hunks.select("o", F.explode("ids").alias("key")).distinct().join(elements.select("key"), "key", "left_semi")
    keys = stored(told.select("key").union(fix.select("key")).distinct().orderBy("key").withColumn("e", F.monotonically_increasing_id()))
    fix = durable(fix.join(keys, "key").select("e", "fix"))
    belongs = told.join(keys, "key").join(fix, "e", "left").select("o", "e", F.lit(1.0).alias("size"), (BETA * F.coalesce("fix", F.lit(0.0))).alias("plus"))
    best = durable(blocks.gathered(weighed, index.tfidf(post, df, ["o", "side"], count), belongs, query_key, "o", "e", "max", depth))
    # of elements with fixes only, no more than depth can be in a list: the best 2 * depth suffice
    top = ranked(fix.withColumn("one", F.lit(1)), "one", [F.desc("fix"), F.asc("e")], 2 * depth).select("one", "e", F.round(BETA * F.col("fix"), 9).alias("score")).where("score > 0")
    spare = top.groupBy("one").agg(F.collect_list(F.struct("e", "score")).alias("spare"))  # one row that holds 2 * depth keys
    # of a full list the last is a floor for them
    floor = best.groupBy(query_key).agg(F.count("*").alias("held"), F.min("score").alias("floor")).where(F.col("held") >= depth).select(query_key, "floor")
    more = queries.select(query_key).distinct().join(floor, query_key, "left").withColumn("one", F.lit(1)).join(spare, "one")
    more = more.select(query_key, "floor", F.explode("spare").alias("x")).select(query_key, "floor", "x.*").where("floor is null or score >= floor").drop("floor")
    # an element that is in one of the hunks and missed the list gets less here, so it misses it again
    more = more.join(best, [query_key, "e"], "left_anti")
    found = ranked(best.unionByName(more), query_key, [F.desc("score"), F.asc("e")], depth)
    return found.join(keys, "e").select(query_key, "key", "score", "rank")


def time_bins(units: DataFrame, group: str, seconds: int = 60 * 86400) -> DataFrame:
    """(group, t, start): greedy bins; a bin ends when a commit is more than ``seconds`` after its first one.

    The first of each following bin is found for all distinct times at once, then
    starts are followed from bin to bin.  Times are distinct before the window.
    """
    times = units.where("t is not null").select(group, "t").distinct()
    after = Window.partitionBy(group).orderBy("t").rangeBetween(seconds + 1, Window.unboundedFollowing)
    jump = times.withColumn("next", F.min("t").over(after))
    starts = times.groupBy(group).agg(F.min("t").alias("t"))
    jump, reached = durable(jump), durable(starts)
    frontier = reached
    while True:
        frontier = durable(frontier.join(jump, [group, "t"]).where("next is not null").select(group, F.col("next").alias("t")))
        if frontier.isEmpty():
            break
        reached = durable(reached.unionByName(frontier))
    begun = times.join(reached.withColumn("start", F.col("t")), [group, "t"], "left")
    return begun.select(group, "t", F.last("start", True).over(Window.partitionBy(group).orderBy("t")).alias("start"))
