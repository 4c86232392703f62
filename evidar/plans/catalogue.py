"""All queries of the core by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import evaluation, evidence, extraction, graph, history, search, text

QUERIES = {**text.QUERIES, **search.QUERIES, **history.QUERIES, **graph.QUERIES, **evaluation.QUERIES, **extraction.QUERIES, **evidence.QUERIES}
SQL = {**text.SQL, **search.SQL, **history.SQL, **graph.SQL, **evaluation.SQL, **extraction.SQL, **evidence.SQL}
