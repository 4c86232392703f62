"""SQL for DuckDB that gives the rows of those pN_ queries which SQL can express."""

SQL = {
    "p2_found": "SELECT DISTINCT id FROM chunk WHERE length(text) > 1600",
    "p4_found": r"""
        WITH rec AS (
            SELECT 'unit' AS kind, h AS rec, coalesce(max_by(msg, loaded_at), '') AS text FROM unit WHERE h IS NOT NULL GROUP BY h
            UNION ALL
            SELECT 'report', CAST(n AS VARCHAR), max_by(coalesce(title, '') || chr(10) || coalesce(body, ''), fetched_at) FROM report WHERE n IS NOT NULL GROUP BY n
        ),
        runs AS (SELECT kind, rec, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS run FROM rec),
        tf AS (SELECT kind, rec, lower(run) AS term, count(*) AS tf FROM runs WHERE regexp_full_match(run, '[A-Za-z]{4,}') GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
        SELECT kind, rec, term FROM tf JOIN df USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 8
    """,
    "p4_scores": r"""
        WITH rec AS (
            SELECT 'unit' AS kind, h AS rec, coalesce(max_by(msg, loaded_at), '') AS text FROM unit WHERE h IS NOT NULL GROUP BY h
            UNION ALL
            SELECT 'report', CAST(n AS VARCHAR), max_by(coalesce(title, '') || chr(10) || coalesce(body, ''), fetched_at) FROM report WHERE n IS NOT NULL GROUP BY n
        ),
        runs AS (SELECT kind, rec, generate_subscripts(x, 1) AS i, unnest(x) AS run FROM (SELECT kind, rec, regexp_extract_all(text, '[A-Za-z0-9]+') AS x FROM rec)),
        words AS (SELECT kind, rec, lower(run) AS term, row_number() OVER (PARTITION BY kind, rec ORDER BY i) AS p FROM runs WHERE regexp_full_match(run, '[A-Za-z]{4,}')),
        tf AS (SELECT kind, rec, term, count(*) AS tf FROM words GROUP BY ALL),
        near AS (SELECT a.kind, a.rec, a.term, count(DISTINCT b.term) AS degree FROM words a JOIN words b ON b.kind = a.kind AND b.rec = a.rec AND b.p BETWEEN a.p - 3 AND a.p + 3 AND b.term <> a.term GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
        SELECT kind, rec, term, tf, coalesce(degree, 0) AS degree, df, round(coalesce(degree, 0) * ln((SELECT count(*) FROM rec)::DOUBLE / df), 6) AS score FROM tf JOIN df USING (term) LEFT JOIN near USING (kind, rec, term)
    """,
    "p6_found": """
        WITH c AS (SELECT DISTINCT n, section, id, bm25, cos, fused_score FROM cand),
        g AS (
            SELECT *, count(*) OVER (PARTITION BY n, section) AS m,
                rank() OVER (PARTITION BY n, section ORDER BY bm25 DESC NULLS LAST) - 1 AS above_bm25,
                rank() OVER (PARTITION BY n, section ORDER BY cos DESC NULLS LAST) - 1 AS above_cos,
                rank() OVER (PARTITION BY n, section ORDER BY fused_score DESC NULLS LAST) - 1 AS above_fused
            FROM c
        )
        SELECT DISTINCT n, section, id FROM g
        WHERE bm25 IS NOT NULL AND cos IS NOT NULL AND above_bm25 < ceil(m / 10) AND above_cos < ceil(m / 10)
            AND (section = 'doc' OR (section = 'code' AND fused_score IS NOT NULL AND above_fused < ceil(m / 10)))
    """,
}
