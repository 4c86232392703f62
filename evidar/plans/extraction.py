"""Queries of parsing, samples and event windows; most have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidar.functions import terms
from evidar.operators import code, docs, evaluate, index
from evidar.streaming.incremental import windowed_counts
from evidar.tables import read

from . import domain


def python_elements(spark, d):
    """Elements that parsing the Python modules finds."""
    return code.extract(_modules(spark, d))[0]


def python_edges(spark, d):
    """Imports, definitions, calls and base classes of the Python modules, resolved."""
    nodes, refs = code.extract(_modules(spark, d))
    return code.resolve(nodes, refs)


def _modules(spark, d):
    return domain.nodes(spark, d, "label", "file", "source").where("label = 'Module' and file like '%.py'").select("file", "source")


def doc_links(spark, d):
    """Elements that passages name, by the first form that exists."""
    return docs.resolve(read(spark, d, "chunk").select("id", "file", "idx", "text"), domain.nodes(spark, d, "label", "name", "file"))


def doc_passages(spark, d):
    """Every documentation file put together from its passages and cut by headings again."""
    rows = read(spark, d, "chunk").where("file is not null and text is not null").select("file", "idx", "heading", "text").distinct()
    part = F.concat(F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit("# "), "heading", F.lit("\n\n"))).otherwise(""), "text")
    files = rows.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("text"))
    return docs.chunk_files(files)


def nl_terms(spark, d):
    """Stems of the words of reports that are no stop words and no keywords."""
    stop = terms.stop_words(spark)
    return index.postings(domain.reports(spark, d), ["n"], F.col("text"), lambda t: terms.nl_terms(t, stop))


def issue_terms(spark, d):
    """Stems of the words of reports that are no stop words."""
    stop = terms.stop_words(spark)
    return index.postings(domain.reports(spark, d), ["n"], F.col("text"), lambda t: terms.issue_terms(t, stop))


def code_terms(spark, d):
    """Words of reports that look like code, whole and in parts."""
    return index.postings(domain.reports(spark, d), ["n"], F.col("text"), terms.code_terms).select(F.col("n").cast("bigint").alias("n"), "term", "tf")


def event_windows(spark, d):
    return windowed_counts(read(spark, d, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events")


def report_samples(spark, d):
    """Three commits of every repository, chosen by their hash."""
    return evaluate.sample(domain.units(spark, d), "repo", "h", 3).select("repo", "h", F.col("place").cast("bigint").alias("place"))


QUERIES = {f.__name__: f for f in (python_elements, python_edges, doc_links, doc_passages, nl_terms, issue_terms, code_terms, event_windows, report_samples)}
_NAME = r"[A-Za-z_][\p{L}\p{N}_]*(?:\.[A-Za-z_][\p{L}\p{N}_]*)*"
SQL = {
    "code_terms": f"""{domain.sql('reports')}, w AS (SELECT n, unnest(regexp_extract_all(text, '`[^`\\n]+`|{_NAME}\\(?')) AS w FROM reports),
        t AS (SELECT n, unnest(CASE WHEN starts_with(w, '`') THEN regexp_extract_all(w, '{_NAME}') WHEN ends_with(w, '(') OR contains(w, '_') OR contains(w, '.') OR regexp_matches(substring(w, 2), '\\p{{Lu}}') THEN [regexp_replace(w, '\\($', '')] ELSE [] END) AS t FROM w),
        p AS (SELECT n, unnest(CASE WHEN contains(t, '.') THEN list_concat([t], string_split(t, '.')) ELSE [t] END) AS term FROM t) SELECT CAST(n AS BIGINT) AS n, term, count(*) AS tf FROM p GROUP BY n, term""",
    "event_windows": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL",
    "report_samples": f"{domain.sql('units')}, k AS (SELECT repo, h, row_number() OVER (PARTITION BY repo ORDER BY sha1(h), h) AS place FROM units) SELECT repo, h, place FROM k WHERE place <= 3",
}
