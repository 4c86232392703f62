"""Queries on texts: tokens, names, links, paths, index tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidar.functions import text as X
from evidar.operators import index
from evidar.tables import read

from . import domain
from .domain import sql, tokens_sql

NODE_TEXT_SQL = "CASE WHEN length(trim(source)) >= 5 THEN source ELSE concat_ws(' ', label, name, file) END"


def node_text():
    """What an element is searched by: its source, or label, name and file if that is empty or short."""
    return F.when(F.length(F.trim("source")) >= 5, F.col("source")).otherwise(F.concat_ws(" ", "label", "name", "file"))


def code_texts(spark, d):
    return domain.nodes(spark, d, "label", "name", "file", "source").select("id", node_text().alias("text"))


def tokenize(spark, d):
    words = X.tokenize_code(F.col("text"))
    return code_texts(spark, d).select("id", F.size(words).cast("bigint").alias("tokens"), F.size(F.array_distinct(words)).cast("bigint").alias("distinct_tokens"), F.md5(F.array_join(words, " ")).alias("digest"))


def identifiers(spark, d):
    return domain.reports(spark, d).select(F.col("n").cast("bigint").alias("n"), F.array_join(X.identifiers(F.col("text")), ",").alias("names"))


def query_texts(spark, d):
    return domain.reports(spark, d).select(F.col("n").cast("bigint").alias("n"), F.md5(X.query_text(F.col("text"))).alias("digest"))


def pull_requests(spark, d):
    return domain.units(spark, d).select("h", X.pr_of(F.coalesce("msg", F.lit(""))).cast("bigint").alias("pr")).where("pr is not null")


def close_links(spark, d):
    return domain.units(spark, d).select("h", F.explode(X.closed_reports(F.coalesce("msg", F.lit("")))).alias("n"))


def cited_items(spark, d):
    return domain.reports(spark, d).select(F.col("n").cast("bigint").alias("n"), F.array_join(X.cited_items(F.col("text")), ",").alias("items"), F.array_join(X.answered_files(F.col("text")), ",").alias("files"))


def qualified(spark, d):
    rows = domain.nodes(spark, d, "file")
    return rows.select("id", X.qualified(F.col("id")).alias("qualified"), X.key_of(F.col("id")).alias("key"), X.module_name(F.col("file")).alias("module"), X.directory(F.col("file")).alias("directory"))


def kept_files(spark, d):
    return domain.nodes(spark, d, "label", "file").where("label = 'Module'").select("file").distinct().where(X.kept_path(F.col("file")))


def clipped(spark, d):
    return domain.reports(spark, d).select(F.col("n").cast("bigint").alias("n"), F.md5(X.clip(F.col("text"), 400)).alias("digest"))


def bug_fixes(spark, d):
    return domain.units(spark, d).where(X.is_bugfix(F.coalesce("msg", F.lit("")))).select("h", "t")


def postings(spark, d):
    return index.postings(domain.reports(spark, d), ["n"], F.col("text")).select(F.col("n").cast("bigint").alias("n"), "term", "tf")


def df_idf_bm25(spark, d):
    docs = code_texts(spark, d)
    return index.bm25_idf(index.frequencies(index.postings(docs, ["id"], F.col("text"))), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


def _weights(spark, d, smooth):
    docs = domain.reports(spark, d).select(F.col("n").cast("bigint").alias("n"), "text")
    post = index.postings(docs, ["n"], F.col("text"))
    return index.tfidf(post, index.frequencies(post), ["n"], docs.count(), smooth).select("n", "term", F.round("w", 6).alias("w"))


def tfidf_plain(spark, d):
    return _weights(spark, d, False)


def tfidf_smooth(spark, d):
    return _weights(spark, d, True)


def chunk_texts(spark, d):
    """What a passage is searched by: heading and text, or its id if that is empty or short."""
    both = F.trim(F.concat(F.coalesce("heading", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    return read(spark, d, "chunk").select("id", F.md5(F.when(F.length(both) >= 5, both).otherwise(F.concat(F.lit("DocChunk "), F.col("id")))).alias("digest")).distinct()


QUERIES = {
    f.__name__: f
    for f in (tokenize, identifiers, query_texts, pull_requests, close_links, cited_items, qualified, kept_files, clipped, bug_fixes, postings, df_idf_bm25, tfidf_plain, tfidf_smooth, chunk_texts)
}

_STOP = ", ".join(f"'{w}'" for w in X.PASCAL_STOP)
_WEIGHTS = "{with_}, post AS (SELECT n, term, count(*) AS tf FROM (SELECT n, unnest({tokens}) AS term FROM reports) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), {w} SELECT CAST(n AS BIGINT) AS n, term, round(w, 6) AS w FROM w"
SQL = {
    "tokenize": f"{sql('nodes')}, t AS (SELECT id, {tokens_sql(NODE_TEXT_SQL)} AS w FROM nodes) SELECT id, len(w) AS tokens, len(list_distinct(w)) AS distinct_tokens, md5(array_to_string(w, ' ')) AS digest FROM t",
    "identifiers": rf"""{sql('reports')}, x AS (SELECT n, regexp_extract_all(text, '[a-zA-Z0-9_/]+\.py') AS paths,
            list_filter(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b[A-Z][a-zA-Z0-9]{{2,}}\b'), lambda z: z NOT IN ({_STOP})) AS pascal, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', 'Z', 'g'), '\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b') AS snake,
            list_filter(regexp_extract_all(text, '[`''"]([a-zA-Z_][a-zA-Z0-9_]*)[`''"]', 1), lambda z: length(z) > 2) AS quoted FROM reports)
        SELECT CAST(n AS BIGINT) AS n, array_to_string(list_sort(list_distinct(list_concat(pascal, snake, quoted, paths,
            list_filter(list_transform(paths, lambda p: replace(string_split(p, '/')[-1], '.py', '')), lambda b: b <> '' AND b NOT IN ({_STOP}))))), ',') AS names FROM x""",
    "query_texts": f"{sql('reports')} SELECT CAST(n AS BIGINT) AS n, md5(substring(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), 1, 2000)) AS digest FROM reports",
    "pull_requests": rf"""{sql('units')}, x AS (SELECT h, coalesce(try_cast(nullif(regexp_extract(coalesce(msg, ''), '{X.MERGED}', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(string_split(coalesce(msg, ''), chr(10))[1], '{X.SQUASHED}', 1), '') AS BIGINT)) AS pr FROM units)
        SELECT h, pr FROM x WHERE pr IS NOT NULL""",
    "close_links": rf"{sql('units')} SELECT h, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(msg, ''), '{X.CLOSES}', 1), lambda x: CAST(x AS BIGINT)))) AS n FROM units",
    "cited_items": rf"""{sql('reports')}, g AS (SELECT n, text, generate_subscripts(x, 1) AS i, unnest(x) AS tag FROM (SELECT n, text, flatten(list_transform(regexp_extract_all(text, '\[([ECDHI]\d+(?:\s*[,;]\s*[ECDHI]\d+)*)\]', 1), lambda z: regexp_extract_all(z, '[ECDHI]\d+'))) AS x FROM reports)),
        i AS (SELECT n, string_agg(tag, ',' ORDER BY i) AS items FROM (SELECT n, tag, min(i) AS i FROM g GROUP BY n, tag) GROUP BY n),
        f0 AS (SELECT n, list_concat(regexp_extract_all(text, '(?i)FILE:\s*([\w/\-.]+\.\w+)', 1), regexp_extract_all(text, '`([\w/\-.]+\.(?:py|swift|js|ts|java|go|rb|rs|kt|cpp|c|h))`', 1)) AS x FROM reports),
        f AS (SELECT n, string_agg(p, ',' ORDER BY i) AS files FROM (SELECT n, p, min(i) AS i FROM (SELECT n, generate_subscripts(x, 1) AS i, unnest(x) AS p FROM f0) GROUP BY n, p) GROUP BY n)
        SELECT CAST(r.n AS BIGINT) AS n, coalesce(items, '') AS items, coalesce(files, '') AS files FROM reports r LEFT JOIN i ON i.n = r.n LEFT JOIN f ON f.n = r.n""",
    "qualified": f"""{sql('nodes')} SELECT id, CASE WHEN len(string_split(id, ':')) > 2 THEN replace(regexp_replace(id, '^[^:]*:[^:]*:', ''), ':', '.') ELSE string_split(id, ':')[-1] END AS qualified, regexp_replace(id, '^[^:]*:', '') AS key,
        regexp_replace(regexp_replace(regexp_replace(replace(file, '/', '.'), '\\.py$', ''), '\\.__init__$', ''), '^src\\.', '') AS module, CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '.' END AS directory FROM nodes""".replace("ELSE '.' END AS directory", "WHEN file IS NULL THEN '.' ELSE '.' END AS directory"),
    "kept_files": f"""{sql('nodes')} SELECT DISTINCT file FROM nodes WHERE label = 'Module' AND NOT list_has_any(string_split(file, '/')[:-2], ['tests', 'test', 'examples', 'example', 'benchmarks', 'docs']) AND string_split(file, '/')[-1] NOT IN ('conftest.py', 'setup.py')""",
    "clipped": f"{sql('reports')} SELECT CAST(n AS BIGINT) AS n, md5(CASE WHEN length(text) > 400 THEN substring(text, 1, 280) || ' ... ' || right(text, 120) ELSE text END) AS digest FROM reports",
    "bug_fixes": f"{sql('units')} SELECT h, t FROM units WHERE regexp_matches(coalesce(msg, ''), '(?i)fix|bug')",
    "postings": f"{sql('reports')} SELECT CAST(n AS BIGINT) AS n, term, count(*) AS tf FROM (SELECT n, unnest({tokens_sql('text')}) AS term FROM reports) GROUP BY n, term",
    "df_idf_bm25": f"""{sql('nodes')}, post AS (SELECT DISTINCT id, unnest({tokens_sql(NODE_TEXT_SQL)}) AS term FROM nodes), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
        raw AS (SELECT term, df, ln((SELECT count(*) FROM nodes) + 0.5 - df) - ln(df + 0.5) AS raw FROM df) SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END, 6) AS idf FROM raw""",
    "tfidf_plain": _WEIGHTS.format(with_=sql("reports"), tokens=tokens_sql("text"), w=domain.weights_sql("w", "post", "df", "n", "SELECT count(*) FROM reports")),
    "tfidf_smooth": _WEIGHTS.format(with_=sql("reports"), tokens=tokens_sql("text"), w=domain.weights_sql("w", "post", "df", "n", "SELECT count(*) FROM reports", True)),
    "chunk_texts": """WITH x AS (SELECT id, trim(coalesce(heading, '') || ' ' || coalesce(text, ''), ' ') AS t FROM chunk) SELECT DISTINCT id, md5(CASE WHEN length(t) >= 5 THEN t ELSE 'DocChunk ' || id END) AS digest FROM x""",
}
