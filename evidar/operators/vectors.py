"""Nearest neighbours by an inverted file: vectors in cells around centroids, queries in the cells nearest to them.

The centroids are fitted on a sample of at most ``SAMPLE`` rows, chosen by a hash of
the key, and number at most ``CELLS``; so they are bounded whatever the table.  Every
row is put into a cell.  A cell that holds many rows, as copies of one vector do, is
cut into parts by a hash of the key, all of which a query visits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidar.tables import durable

#: rows the centroids are fitted on, and most centroids
SAMPLE, CELLS = 20_000, 1_024
#: rows of a part of a cell
PART = 16_384


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1.0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = len(values)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.empty((0, 1))


def fit(vectors: DataFrame, key: str, vector: str, cells: int | None = None, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Centroids of unit length: spherical k-means on a sample; by default as many as the square root of the number of rows."""
    rows = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    count = rows.count()
    share = F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 20)) < int(min(1.0, sample / max(1, count)) * (1 << 20)) + 1
    picked = rows.where(share).orderBy(F.xxhash64(F.lit(17), F.col(key))).limit(sample).select(F.col(vector).cast("array<double>").alias("v")).toArrow()
    x = _unit(_matrix(picked.column("v")))
    k = max(1, min(cells or int(count**0.5), CELLS, len(x)))
    if not len(x):
        return np.zeros((1, 1))
    centre = x[np.random.default_rng(5).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        hit = np.bincount(near, minlength=k) > 0
        centre[hit] = _unit(total[hit])
    return centre


def search(vectors: DataFrame, key: str, vector: str, is_query: Column, centre: np.ndarray, depth: int = 10, probes: int | None = None) -> DataFrame:
    """(query, id, score, rank): of the rows in the ``probes`` cells nearest to each query the most like it by dot product, itself left out.

    Rows without a vector are in no cell; by default a third of the cells and at least
    eight are visited.  Ties go by id.
    """
    probes = min(len(centre), probes or max(8, len(centre) // 3))
    shared = vectors.sparkSession.sparkContext.broadcast(centre)
    rows = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asked"))
    kind = rows.schema["id"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            near = np.argmax(x @ shared.value.T, axis=1) if len(x) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(near.astype(np.int32))], ["id", "v", "asked", "cell"])

    def visit(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            order = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :probes] if len(x) else np.empty((0, probes), int)
            at = np.repeat(np.arange(len(x)), order.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(order.ravel().astype(np.int32))], ["query", "v", "cell"])

    placed = durable(rows.mapInArrow(place, f"id {kind}, v array<double>, asked boolean, cell int"))
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    # at most CELLS rows
    table = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    asked = placed.where("asked").select("id", "v").mapInArrow(visit, f"query {kind}, v array<double>, cell int").join(F.broadcast(parts), "cell")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(left) and len(right):
            qi, ri = np.array(left.column("query").to_pylist()), np.array(right.column("id").to_pylist())
            score = np.round(_matrix(left.column("v")) @ _matrix(right.column("v")).T, 9)
            score[qi[:, None] == ri[None, :]] = -np.inf
            for i in range(len(qi)):
                best = np.lexsort((ri, -score[i]))[:depth]
                best = best[np.isfinite(score[i][best])]
                out[0].append(np.full(len(best), qi[i]))
                out[1].append(ri[best])
                out[2].append(score[i][best])
        types = [left.schema.field("query").type, right.schema.field("id").type, pa.float64()]
        return pa.table([pa.array(np.concatenate(c).tolist() if c else [], t) for c, t in zip(out, types)], names=["query", "id", "score"])

    found = asked.select("query", "v", "cell", "part").groupBy("cell", "part").cogroup(table.select("id", "v", "cell", "part").groupBy("cell", "part")).applyInArrow(meet, f"query {kind}, id {kind}, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact neighbours (query, id) that were found."""
    total = exact.count()
    return exact.join(found.select("query", "id"), ["query", "id"], "left_semi").count() / total if total else 1.0


def encoded(texts: DataFrame, key: str, text: str, encode, cache: DataFrame | None = None, model: str = "") -> DataFrame:
    """(key, digest, v): vectors of texts by ``encode``, a function from a list of texts to a matrix; equal texts are encoded once.

    ``cache`` has (digest, v) of texts encoded before: those are taken from there.  The
    digest is of the model's name and the text.  Null texts have no row.
    """
    rows = texts.where(F.col(text).isNotNull()).select(key, F.sha1(F.concat(F.lit(model + "\n"), text)).alias("digest"), F.col(text).alias("t"))
    fresh = rows.groupBy("digest").agg(F.max("t").alias("t"))
    if cache is not None:
        fresh = fresh.join(cache.select("digest"), "digest", "left_anti")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                got = np.asarray(encode(part.column(1).to_pylist()), np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(got), pa.list_(pa.float32()))], ["digest", "v"])

    made = fresh.mapInArrow(run, "digest string, v array<float>")
    known = made if cache is None else cache.select("digest", "v").unionByName(made)
    return rows.drop("t").join(known, "digest").select(key, "digest", "v")


def without_vector(nodes: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Functions and classes that have no vector."""
    return nodes.where("label <> 'Module'").join(vectors.select(key), key, "left_anti")
