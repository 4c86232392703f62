"""Writing a graph and its manifest; Spark's commit protocol makes each write whole or nothing."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidar.operators import graph, index, runs


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes by label, then unique edges between them by type; what was there is replaced."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{folder}/nodes")
    stored = nodes.sparkSession.read.parquet(f"{folder}/nodes")
    graph.unique_edges(graph.anchored(edges, stored)).write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")


def merge_nodes(nodes: DataFrame, folder: str) -> DataFrame:
    """The stored nodes with new values merged in, to be written to another folder."""
    return graph.upsert(nodes.sparkSession.read.parquet(f"{folder}/nodes").select(*nodes.columns), nodes, ["id"])


def manifest(nodes: DataFrame, edges: DataFrame, built_at: str) -> DataFrame:
    """One row: built_at, counts per label and per type as maps, raw number of edges."""
    labels = nodes.groupBy("label").count().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "count")))).alias("labels"))
    kept = graph.unique_edges(graph.anchored(edges, nodes))
    types = kept.groupBy("type").count().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "count")))).alias("types"))
    # each side is one row of a few entries
    return nodes.sparkSession.createDataFrame([(built_at, labels.first()[0], types.first()[0], edges.count())], "built_at string, labels map<string,bigint>, types map<string,bigint>, raw_edges bigint")


def consistent(nodes: DataFrame, stored: dict[str, int]) -> list[str]:
    """Differences between stored counts per label and those of a graph; empty if there are none."""
    live = {r.label: r["count"] for r in nodes.groupBy("label").count().collect()}
    if not live:
        return ["the graph is empty"]
    return [f"{k}: stored {stored.get(k, 0)}, live {live.get(k, 0)}" for k in sorted(live.keys() | stored.keys()) if live.get(k, 0) != stored.get(k, 0)]


def clear(session: SparkSession, folder: str) -> None:
    """Removes a graph that was written to a folder; a folder without one stays as it is."""
    for part in ("nodes", "edges", "words", "state"):
        place = session._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}")
        place.getFileSystem(session._jsc.hadoopConfiguration()).delete(place, True)


def write_word_index(nodes: DataFrame, folder: str) -> None:
    """Postings of names and sources of functions and classes, by term, as a search by words reads them."""
    text = F.concat_ws(" ", "name", "source")
    post = index.postings(nodes.where(F.lower("label").isin("function", "class", "method")), ["id"], text)
    post.repartition("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/words")


def write_state(state: DataFrame, folder: str) -> None:
    """A manifest (one row) as JSON."""
    state.coalesce(1).write.mode("overwrite").json(f"{folder}/state")


def update_summary(before: DataFrame, after: DataFrame, reused: DataFrame | None = None) -> DataFrame:
    """(commits, new_commits, reports_new, reuse): what an update brought.

    ``before`` and ``after`` have (kind, key), kind being commit or report; ``reused``
    has a column ``known`` that says whether a vector was there already.
    """
    fresh = after.join(before, ["kind", "key"], "left_anti")
    count = lambda df, kind: df.where(F.col("kind") == kind).count()
    rate = reused.agg(F.round(F.avg(F.col("known").cast("int")), 4)).first()[0] if reused is not None else None
    return after.sparkSession.createDataFrame([(count(after, "commit"), count(fresh, "commit"), count(fresh, "report"), rate)], "commits bigint, new_commits bigint, reports_new bigint, reuse double")


def refresh_edges(edges: DataFrame, folder: str, types: list[str]) -> None:
    """Replaces the stored edges of some types and leaves the others; the folders of the types are exchanged whole."""
    session = edges.sparkSession
    mode = session.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        edges.where(F.col("type").isin(types)).write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")
    finally:
        session.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def same_rows(left: DataFrame, right: DataFrame, columns: list[str]) -> bool:
    """Whether two tables have the same distinct rows in these columns."""
    a, b = left.select(*columns).distinct(), right.select(*columns).distinct()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write_run(session: SparkSession, record: dict, folder: str) -> str:
    """Files of a run's record: record.json, prompt.txt, answer.md, and its line appended to the list of runs; returns its folder."""
    place = f"{folder}/runs/{record['run']['id']}"
    prompt = record.get("_prompt", "")
    _text(session, f"{place}/record.json", json.dumps({k: v for k, v in record.items() if not k.startswith("_")}, ensure_ascii=False, default=str))
    _text(session, f"{place}/prompt.txt", prompt)
    _text(session, f"{place}/answer.md", record["llm"].get("answer") or "")
    session.createDataFrame([(json.dumps(runs.summary(record), ensure_ascii=False),)], "value string").coalesce(1).write.mode("append").text(f"{folder}/runs/index")
    return place


def _text(session: SparkSession, path: str, text: str) -> None:
    """A file of its own on any file system: written under another name, then renamed."""
    jvm = session._jvm
    place, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    files = place.getFileSystem(session._jsc.hadoopConfiguration())
    out = files.create(part, True)
    out.write(text.encode("utf-8"))
    out.close()
    files.delete(place, False)
    files.rename(part, place)


#: fixed values: names of settings that are kept out of a manifest
_HIDDEN = re.compile(r"(?i)token|secret|password|passwd|api_?key|credential")


def run_manifest(config: dict, files: DataFrame) -> dict:
    """Settings without secrets, their hash, and a hash of each file (file, source) and of all of them."""
    def open_(value):
        if isinstance(value, dict):
            return {k: "***" if _HIDDEN.search(str(k)) else open_(v) for k, v in value.items()}
        return [open_(v) for v in value] if isinstance(value, (list, tuple)) else value

    shown = open_(config)
    hashed = files.select("file", F.sha1("source").alias("sha1"))
    # the hash of all is made of the sums per file, which add up in any order
    whole = hashed.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("sha1", 1, 12), 16, 10).cast("decimal(20,0)")).alias("s")).first()
    return {"config": shown, "config_sha": runs.config_sha(shown), "files": whole.n, "files_sha": hashlib.sha1(f"{whole.n}:{whole.s}".encode()).hexdigest()[:12]}
