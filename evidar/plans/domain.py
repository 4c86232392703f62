"""The tables of a project as the operators read them, and the same as SQL for DuckDB.

Elements and reports come again when they are indexed or fetched again; the newest
version counts.  Queries of searches are the reports whose number is divisible by 20.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidar.functions.text import key_of
from evidar.operators.graph import last_version
from evidar.tables import read, spread

CODE = ("Module", "Class", "Function")


def nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Code elements, newest version, with the columns asked for, else with all; ``file`` falls back to the name of a module."""
    rows = read(spark, d, "node").where(F.col("label").isin(*CODE))
    names = [c for c in (columns or rows.columns) if c not in ("id", "indexed_at")]
    file = F.coalesce("file", F.when(F.col("label") == "Module", F.col("name"))).alias("file")
    rows = rows.select("id", *[file if c == "file" else c for c in names], "indexed_at")
    if "source" in names:
        rows = spread(rows)
    return last_version(rows, ["id"], F.col("indexed_at")).select("id", *names, *[] if columns else ["indexed_at"])


def elements(spark: SparkSession, d: str) -> DataFrame:
    """(id, key): functions and classes, and how the history names them."""
    rows = read(spark, d, "node").where(F.col("label").isin("Class", "Function")).select("id").distinct()
    return rows.select("id", key_of(F.col("id")).alias("key"))


def keys(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d).select("key").distinct()


def calls(spark: SparkSession, d: str) -> DataFrame:
    """(type, source, target, line): call edges as stored."""
    return read(spark, d, "call_edge").select(F.lit("Calls").alias("type"), F.col("caller").alias("source"), F.col("callee").alias("target"), "line")


def defines(spark: SparkSession, d: str) -> DataFrame:
    """Edges from a module or class to what stands in it, by the grammar of ids."""
    ids = read(spark, d, "node").where(F.col("label").isin(*CODE)).select("id").distinct()
    inner = ids.where(F.size(F.split("id", ":")) > 2)
    return inner.select(F.lit("Defines").alias("type"), F.regexp_replace("id", ":[^:]*$", "").alias("source"), F.col("id").alias("target"), F.lit(None).cast("int").alias("line"))


def documents_edges(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "doc_edge").select(F.lit("Documents").alias("type"), F.col("chunk").alias("source"), F.col("target"), F.lit(None).cast("int").alias("line"))


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports, the version fetched last, with ``text`` = title, line end, body."""
    rows = last_version(spread(read(spark, d, "report")), ["n"], F.col("fetched_at"))
    return rows.withColumn("text", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """(n, text): the query set."""
    return reports(spark, d).where(F.col("n") % 20 == 0).select("n", "text")


def listed_prompts(spark: SparkSession, d: str) -> DataFrame:
    """(n, text): reports that have candidates."""
    return reports(spark, d).join(read(spark, d, "cand").select("n").distinct(), "n", "left_semi").select("n", "text")


def units(spark: SparkSession, d: str) -> DataFrame:
    return last_version(read(spark, d, "unit"), ["h"], F.col("loaded_at"))


def links(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "link").distinct()


def cand(spark: SparkSession, d: str, section: str) -> DataFrame:
    """One row per report and candidate: the greatest of each score, nulls as 0."""
    rows = read(spark, d, "cand").where(F.col("section") == section)
    return rows.groupBy("n", "id").agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("bm25", "cos", "fused_score")])


def gold(spark: SparkSession, d: str) -> DataFrame:
    """(n, key): elements touched by the commits that fixed a report."""
    touched = read(spark, d, "unit").select(F.col("h").alias("u"), F.explode("touch").alias("key")).distinct()
    return links(spark, d).where("type = 'fixed'").select("n", "u").distinct().join(touched, "u").select("n", "key").distinct()


def six(name: str):
    """A score of nine decimals as one of six; the nudge makes every engine round a tie upwards."""
    return F.round(F.col(name) + 1e-10, 6)


SQL = {
    "nodes": """nodes AS (SELECT id, label, name, coalesce(file, CASE WHEN label = 'Module' THEN name END) AS file, start_line, end_line, source, repo
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) AS rn FROM node WHERE label IN ('Module', 'Class', 'Function')) WHERE rn = 1)""",
    "elements": "elements AS (SELECT DISTINCT id, regexp_replace(id, '^[^:]*:', '') AS key FROM node WHERE label IN ('Class', 'Function'))",
    "keys": "keys AS (SELECT DISTINCT regexp_replace(id, '^[^:]*:', '') AS key FROM node WHERE label IN ('Class', 'Function'))",
    "edges": """edges AS (SELECT 'Calls' AS type, caller AS source, callee AS target, line FROM call_edge
        UNION ALL SELECT 'Defines', regexp_replace(id, ':[^:]*$', ''), id, NULL FROM (SELECT DISTINCT id FROM node WHERE label IN ('Module', 'Class', 'Function')) WHERE len(string_split(id, ':')) > 2)""",
    "ids": "ids AS (SELECT DISTINCT id FROM node WHERE label IN ('Module', 'Class', 'Function'))",
    "real": "real AS (SELECT type, source, target, min(line) AS line FROM edges WHERE source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids) GROUP BY ALL)",
    "steps": "steps AS (SELECT source AS a, target AS b FROM real UNION SELECT target, source FROM real)",
    "reports": """reports AS (SELECT *, coalesce(title, '') || chr(10) || coalesce(body, '') AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY fetched_at DESC, pr DESC, title DESC NULLS LAST, body DESC NULLS LAST) AS rn FROM report) WHERE rn = 1)""",
    "prompts": "prompts AS (SELECT n, text FROM reports WHERE n % 20 = 0)",
    "listed": "prompts AS (SELECT n, text FROM reports WHERE n IN (SELECT n FROM cand))",
    "units": "units AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY loaded_at DESC) AS rn FROM unit) WHERE rn = 1)",
    "touched": "touched AS (SELECT DISTINCT h, t, unnest(touch) AS key FROM units)",
    "code": "code AS (SELECT n, id, coalesce(max(bm25), 0) AS bm25, coalesce(max(cos), 0) AS cos, coalesce(max(fused_score), 0) AS fused_score FROM cand WHERE section = 'code' GROUP BY n, id)",
    "doc": "doc AS (SELECT n, id, coalesce(max(bm25), 0) AS bm25, coalesce(max(cos), 0) AS cos FROM cand WHERE section = 'doc' GROUP BY n, id)",
    "gold": """gold AS (SELECT DISTINCT n, key FROM (SELECT DISTINCT n, u FROM link WHERE type = 'fixed') l JOIN (SELECT DISTINCT h, unnest(touch) AS key FROM unit) t ON t.h = l.u)""",
    "hybrid": """hybrid_all AS (SELECT n, id, round(1.0 / (60 + row_number() OVER (PARTITION BY n ORDER BY bm25 DESC, id) - 1) + 1.0 / (60 + row_number() OVER (PARTITION BY n ORDER BY cos DESC, id) - 1), 9) AS score FROM code),
        hybrid AS (SELECT n, id, score, row_number() OVER (PARTITION BY n ORDER BY score DESC, id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, id) AS c FROM hybrid_all)
            WHERE c <= 500 AND id IN (SELECT id FROM elements))""",
}


def sql(*names: str, recursive: bool = False) -> str:
    """A WITH clause of the named parts."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower(regexp_replace({text}, '([A-Z])', ' \\1', 'g')), '[a-z0-9]+')"


def weights_sql(name: str, post: str, df: str, key: str, count: str, smooth: bool = False) -> str:
    """tf-idf rows of unit length as the part ``name`` (key, term, w)."""
    rarity = f"(ln((1.0 + ({count})) / (1.0 + df)) + 1)" if smooth else f"ln(({count})::DOUBLE / df)"
    return f"""{name}_raw AS (SELECT {key}, term, (ln(tf) + 1) * {rarity} AS raw FROM {post} JOIN {df} USING (term)),
        {name}_norm AS (SELECT {key}, sqrt(sum(raw * raw)) AS norm FROM {name}_raw GROUP BY {key}),
        {name} AS (SELECT {key}, term, CASE WHEN norm > 0 THEN raw / norm ELSE 0 END AS w FROM {name}_raw JOIN {name}_norm USING ({key}))"""
