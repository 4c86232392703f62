"""Ranked lists: BM25, cosine, reciprocal rank fusion, files, quotas."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidar.tables import durable, stored

from . import blocks, index

#: constant of reciprocal rank fusion, depth of lists
RRF_K, DEPTH = 60, 500


def ranked(df: DataFrame, group: str | list[str], order: list[Column], limit: int | None = None, base: int = 1, out: str = "rank") -> DataFrame:
    """Adds the position in the group under a total order, from ``base``; with ``limit`` only so many rows are kept."""
    placed = df.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    if limit is not None:
        placed = placed.where(F.col(out) <= limit)
    return placed if base == 1 else placed.withColumn(out, F.col(out) + (base - 1))


def bm25(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, depth: int = DEPTH, only: DataFrame | None = None, terms=index.tokenize_code, k1: float = index.K1, b: float = index.B) -> DataFrame:
    """(query, doc, score, rank): BM25 lists of ``depth``, best first, ties by doc.

    Both inputs have (key, text).  Documents no query term is in have a score of 0
    and fill a list that would be shorter.  A term repeated in a query counts as often.
    With ``only`` (doc) the others lend their words to the weights but aren't listed.
    """
    # o numbers the documents in the order of their keys, so that ties go by it and keys aren't carried along
    ids = stored(docs.select(doc_key).distinct().orderBy(doc_key).withColumn("o", F.monotonically_increasing_id()))
    texts = docs.select(doc_key, "text").join(ids, doc_key).groupBy("o").agg(F.flatten(F.collect_list(terms(F.col("text")))).alias("all"))
    said = texts.select("o", F.explode("all").alias("term")).groupBy("o", "term").agg(F.count("*").alias("tf"))
    post = stored(said.groupBy("o").agg(F.sum("tf").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("x")).select("o", "dl", F.col("x.term").alias("terms"), F.col("x.tf").alias("tfs")))
    count = docs.count()
    told = post.agg(F.sum("dl").alias("words"), F.sum(F.size("terms")).alias("rows")).first()
    average = (told.words or 0) / max(1, count)
    idf = index.bm25_idf(durable(post.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))), count)
    norm = k1 * (1 - b + b * F.col("dl") / F.lit(float(average or 1)))
    weights = post.select("o", F.transform("terms", lambda t: F.xxhash64(t)).alias("words__"), F.transform("tfs", lambda tf: tf * (k1 + 1) / (tf + norm)).alias("weights__"))
    if only is not None:
        kept = ids.join(only.select(doc_key).distinct(), doc_key, "left_semi")
        weights, docs = weights.join(kept, "o", "left_semi"), docs.join(only.select(doc_key).distinct(), doc_key, "left_semi")
    # the rarity of a term counts with the queries, which are fewer
    wanted = index.postings(queries, [query_key], F.col("text"), terms).join(idf, "term").select(query_key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    top = stored(blocks.products(wanted, weights, query_key, "o", depth, told.rows or 0).join(ids, "o").select(query_key, doc_key, "score"))
    # a list of fewer than depth hits has all positive scores, and none is negative; the first
    # 2 * depth documents hold enough that it doesn't have
    short = durable(queries.select(query_key).distinct().join(top.groupBy(query_key).agg(F.count("*").alias("hits")), query_key, "left").where(F.coalesce("hits", F.lit(0)) < depth))
    both = top
    if not short.isEmpty():
        # one row that holds 2 * depth ids
        spare = docs.select(doc_key).orderBy(doc_key).limit(2 * depth).agg(F.sort_array(F.collect_list(doc_key)).alias("ids")).withColumn("one", F.lit(1))
        fill = short.select(query_key, F.lit(1).alias("one")).join(spare, "one").select(query_key, F.explode("ids").alias(doc_key)).join(top, [query_key, doc_key], "left_anti")
        both = top.unionByName(fill.withColumn("score", F.lit(0.0)))
    return ranked(both, query_key, [F.desc("score"), F.asc(doc_key)], depth)


def cosine(vectors: DataFrame, key: str, vector: str, is_query: Column, depth: int = DEPTH, block: int = 16_384) -> DataFrame:
    """(query, id, score, rank): for each query row the rows most like it, itself left out.

    Rows and queries are packed into blocks; every block of queries meets every
    block of rows as one matrix product, of which only the best ``depth`` per query
    go on.  Null vectors are no rows; ties go by id.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    count = rows.count()
    parts = max(1, -(-count // block))
    cell = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    packed = rows.groupBy(cell.alias("cell")).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    asked = rows.where("q").groupBy(cell.alias("asked_cell")).agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    spread = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def best(batches):
        for batch in batches:
            kind = batch.schema.field(0).type.value_type.field("id").type
            for asked_rows, all_rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                qi, ri = np.array([r["id"] for r in asked_rows]), np.array([r["id"] for r in all_rows])
                score = np.round(np.array([r["v"] for r in asked_rows]) @ np.array([r["v"] for r in all_rows]).T, 9)
                score[qi[:, None] == ri[None, :]] = -np.inf
                for i in range(len(qi)):
                    order = np.lexsort((ri, -score[i]))[:depth]
                    order = order[np.isfinite(score[i][order])]
                    yield pa.RecordBatch.from_arrays([pa.array([qi[i]] * len(order), kind), pa.array(ri[order], kind), pa.array(score[i][order])], ["query", "id", "score"])

    id_type = rows.schema["id"].dataType.simpleString()
    found = spread.join(packed, "cell").select("asked", "rows").mapInArrow(best, f"query {id_type}, id {id_type}, score double")
    return ranked(found, "query", [F.desc("score"), F.asc("id")], depth)


def rrf(lists: list[DataFrame], group: str, key: str, base: int = 1, k: int = RRF_K, depth: int | None = DEPTH) -> DataFrame:
    """(group, key, score, rank): reciprocal rank fusion of lists with (group, key, rank).

    Ties go to the better rank in the first list, then by key; an entry missing in a
    list gets nothing from it.
    """
    union = reduce(lambda a, b: a.unionByName(b), [x.select(group, key, F.col("rank").cast("bigint").alias("r"), F.lit(i).alias("i")) for i, x in enumerate(lists)])
    fused = union.groupBy(group, key).agg(F.round(F.sum(1.0 / (k + F.col("r"))), 9).alias("score"), F.min(F.when(F.col("i") == 0, F.col("r"))).alias("first"))
    return ranked(fused, group, [F.desc("score"), F.asc_nulls_last("first"), F.asc(key)], depth).drop("first")


def file_rank(listed: DataFrame, files: DataFrame, group: str, key: str, limit: int = 5) -> DataFrame:
    """(group, file, position, best_pos, best_id): files in the order of their first element in a list."""
    first = listed.join(files, key).groupBy(group, "file").agg(F.min(F.struct(F.col("rank"), F.col(key))).alias("x"))
    return ranked(first.select(group, "file", F.col("x.rank").alias("best_pos"), F.col(f"x.{key}").alias("best_id")), group, [F.asc("best_pos")], limit, out="position")


def suffixes(path: Column) -> Column:
    """Every end of a path that begins after a slash, with and without its .py, for look-ups by equality."""
    parts = F.split(path, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
    bare = F.transform(F.filter(ends, lambda e: e.endswith(".py")), lambda e: F.regexp_replace(e, r"\.py$", ""))
    return F.array_distinct(F.concat(ends, bare))
