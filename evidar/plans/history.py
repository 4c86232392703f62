"""Queries on the history of commits and on earlier reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidar.functions.text import tokenize_code
from evidar.operators import history, issues

from . import domain, search
from .domain import six, sql, tokens_sql, weights_sql


def eligible_commits(spark, d):
    return history.eligible(domain.units(spark, d), domain.keys(spark, d))


def touch_sets(spark, d):
    return history.touches(domain.units(spark, d)).select("h", "key")


def fix_recency(spark, d):
    return history.fix_recency(domain.units(spark, d)).select("key", F.round("fix", 6).alias("fix"))


def message_cosine(spark, d):
    """The 500 commits whose messages are most like a report."""
    return history.message_scores(domain.prompts(spark, d), domain.units(spark, d), "n", 500).select(F.col("n").cast("bigint").alias("n"), "h", six("cos").alias("cos"))


def msg_rank(spark, d):
    """Elements by the best commit, from commit texts and from the hybrid list."""
    listed = search.hybrid(spark, d).select("n", F.regexp_replace("id", "^[^:]*:", "").alias("key"), "rank")
    found = history.message_rank(domain.listed_prompts(spark, d), domain.units(spark, d), listed, domain.keys(spark, d), "n")
    return found.select(F.col("n").cast("bigint").alias("n"), "key", six("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def locus_full(spark, d):
    """Commits as hunks: words of the message, names of code in it, and recency of fixes."""
    units = domain.units(spark, d)
    hunks = units.select(F.col("h").alias("hunk"), F.array_distinct(F.coalesce("touch", F.array().cast("array<string>"))).alias("ids"), F.coalesce("msg", F.lit("")).alias("text"))
    names = domain.nodes(spark, d, "label", "name").where("label <> 'Module'").select(F.col("name").alias("term")).distinct()
    codes = lambda t: F.regexp_extract_all(t, F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0)
    found = history.locus(domain.prompts(spark, d), hunks, units, names, domain.keys(spark, d), "n", tokenize_code, codes)
    return found.select(F.col("n").cast("bigint").alias("n"), "key", six("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def snapshot_bins(spark, d):
    return history.time_bins(domain.units(spark, d), "repo").select("repo", "t", "start")


def closing_links(spark, d):
    return issues.closing_links(domain.units(spark, d), domain.reports(spark, d)).select(F.col("n").cast("bigint").alias("n"), "h")


def commit_texts(spark, d):
    units, reports = domain.units(spark, d), domain.reports(spark, d)
    return issues.commit_reports(units, reports, issues.closing_links(units, reports)).select("h", F.col("n").cast("bigint").alias("n"), F.col("own").cast("bigint").alias("own"))


def fixed_elements(spark, d):
    return domain.gold(spark, d)


def simiscore(spark, d):
    found = issues.simi_rank(domain.prompts(spark, d), domain.reports(spark, d).where("not pr"), domain.gold(spark, d), domain.keys(spark, d), "n")
    return found.select(F.col("n").cast("bigint").alias("n"), "key", six("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def issue_pool(spark, d):
    """The ten most similar reports that fixed something."""
    fixed = domain.gold(spark, d).select(F.col("n").alias("doc"))
    pool = issues.most_similar(domain.prompts(spark, d), domain.reports(spark, d).where("not pr"), "n", 10, among=fixed)
    return pool.select(F.col("n").cast("bigint").alias("n"), F.col("doc").cast("bigint").alias("doc"), six("sim").alias("sim"), F.col("rank").cast("bigint").alias("rank"))


QUERIES = {
    f.__name__: f
    for f in (eligible_commits, touch_sets, fix_recency, message_cosine, msg_rank, locus_full, snapshot_bins, closing_links, commit_texts, fixed_elements, simiscore, issue_pool)
}

_FIT = "fit AS (SELECT * FROM units WHERE len(touch) BETWEEN 1 AND 50 AND h IN (SELECT h FROM touched WHERE key IN (SELECT key FROM keys)))"


def _cosine(docs: str, key: str, text: str, prefix: str = "", terms: str | None = None, asked: str | None = None, only: str = "") -> str:
    """Parts that end in {prefix}cos (n, key, cos): prompts against documents under plain tf-idf."""
    terms, asked = terms or tokens_sql(text), asked or tokens_sql("text")
    p = prefix
    return f"""{p}post AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({terms}) AS term FROM {docs}) {only} GROUP BY ALL), {p}df AS (SELECT term, count(*) AS df FROM {p}post GROUP BY term),
        {p}qpost AS (SELECT n, term, count(*) AS tf FROM (SELECT n, unnest({asked}) AS term FROM prompts) {only} GROUP BY ALL),
        {weights_sql(p + 'w', p + 'post', p + 'df', key, f'SELECT count(*) FROM {docs}')}, {weights_sql(p + 'qw', p + 'qpost', p + 'df', 'n', f'SELECT count(*) FROM {docs}')},
        {p}cos AS (SELECT q.n, d.{key}, sum(q.w * d.w) AS cos FROM {p}qw q JOIN {p}w d USING (term) GROUP BY q.n, d.{key})"""


_FIX = """span AS (SELECT min(t) AS a, max(t) AS b FROM units),
    fix AS (SELECT key, sum(1.0 / (1.0 + exp(-12.0 * least(greatest((t - a) / greatest(1, b - a)::DOUBLE, 0.0), 1.0) + 12.0))) AS fix FROM touched, span WHERE h IN (SELECT h FROM units WHERE regexp_matches(coalesce(msg, ''), '(?i)fix|bug')) GROUP BY key)"""
_CLOSED = r"list_transform(regexp_extract_all(coalesce({0}, ''), '(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\b\s*:?\s*#(\d+)', 1), lambda x: CAST(x AS BIGINT))"
_PR = r"coalesce(try_cast(nullif(regexp_extract(coalesce(msg, ''), '^Merge pull request #(\d+)', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(string_split(coalesce(msg, ''), chr(10))[1], '\(#(\d+)\)\s*$', 1), '') AS BIGINT))"
_LINKED = f"""prs AS (SELECT h, {_PR} AS pr FROM units),
    closing AS (SELECT DISTINCT h, unnest({_CLOSED.format('msg')}) AS n FROM units UNION SELECT h, unnest({_CLOSED.format('body')}) FROM prs JOIN reports r ON r.n = prs.pr WHERE r.pr)"""
_SIM = f"""docs AS (SELECT n AS doc, text FROM reports WHERE NOT pr), post AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest({tokens_sql('text')}) AS term FROM docs) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY term), qpost AS (SELECT n, term, count(*) AS tf FROM (SELECT n, unnest({tokens_sql('text')}) AS term FROM prompts) GROUP BY ALL),
    {weights_sql('w', 'post', 'df', 'doc', 'SELECT count(*) FROM docs', True)}, {weights_sql('qw', 'qpost', 'df', 'n', 'SELECT count(*) FROM docs', True)},
    sim AS (SELECT q.n, d.doc, round(sum(q.w * d.w), 9) AS sim FROM qw q JOIN w d USING (term) WHERE q.n <> d.doc GROUP BY q.n, d.doc)"""
SQL = {
    "eligible_commits": f"{sql('units', 'keys', 'touched')}, {_FIT} SELECT h, t, len(touch) AS n_touch FROM fit",
    "touch_sets": f"{sql('units', 'touched')} SELECT h, key FROM touched",
    "fix_recency": f"{sql('units', 'touched')}, {_FIX} SELECT key, round(fix, 6) AS fix FROM fix",
    "message_cosine": f"{sql('reports', 'prompts', 'units')}, docs AS (SELECT h, coalesce(msg, '') AS msg FROM units), {_cosine('docs', 'h', 'msg')}, k AS (SELECT n, h, round(cos, 9) AS cos, row_number() OVER (PARTITION BY n ORDER BY round(cos, 9) DESC, h) AS place FROM cos WHERE round(cos, 9) > 0) SELECT CAST(n AS BIGINT) AS n, h, round(cos + 1e-10, 6) AS cos FROM k WHERE place <= 500",
    "msg_rank": f"""{sql('reports', 'listed', 'units', 'keys', 'touched', 'elements', 'code', 'hybrid')}, {_FIT}, docs AS (SELECT h, coalesce(msg, '') AS msg FROM fit), {_cosine('docs', 'h', 'msg')},
        text_list AS (SELECT n, h, row_number() OVER (PARTITION BY n ORDER BY round(cos, 9) DESC, t DESC, h) AS rank FROM cos JOIN fit USING (h) WHERE round(cos, 9) > 0),
        listed AS (SELECT n, regexp_replace(id, '^[^:]*:', '') AS key, rank FROM hybrid),
        near AS (SELECT n, h, min(rank) AS best, max(t) AS t FROM touched JOIN listed USING (key) WHERE h IN (SELECT h FROM fit) GROUP BY n, h),
        near_list AS (SELECT n, h, row_number() OVER (PARTITION BY n ORDER BY best, t DESC, h) AS rank FROM near),
        s AS (SELECT n, h, sum(1.0 / (60 + rank)) AS s FROM (SELECT n, h, rank FROM text_list UNION ALL SELECT n, h, rank FROM near_list) GROUP BY n, h),
        b AS (SELECT n, key, round(max(s), 9) AS score FROM s JOIN touched USING (h) WHERE key IN (SELECT key FROM keys) GROUP BY n, key),
        k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, key) AS rank FROM b) SELECT CAST(n AS BIGINT) AS n, key, round(score + 1e-10, 6) AS score, rank FROM k WHERE rank <= 500""",
    "locus_full": f"""{sql('nodes', 'reports', 'prompts', 'units', 'keys', 'touched')}, names AS (SELECT DISTINCT name FROM nodes WHERE label <> 'Module'), docs AS (SELECT h, coalesce(msg, '') AS msg FROM units), {_FIX},
        {_cosine('docs', 'h', 'msg', 'a_')},
        {_cosine('docs', 'h', 'msg', 'b_', "regexp_extract_all(msg, '[A-Za-z_][A-Za-z0-9_]*')", "regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')", "WHERE term IN (SELECT name FROM names)")},
        alpha AS (SELECT p.n, least(1.0, 5.0 * coalesce(q.names, 0) / greatest(1, len({tokens_sql('p.text')}))) AS alpha FROM prompts p LEFT JOIN (SELECT n, sum(tf) AS names FROM b_qpost GROUP BY n) q ON q.n = p.n),
        s AS (SELECT coalesce(a.n, b.n) AS n, coalesce(a.h, b.h) AS h, coalesce(a.cos, 0) AS nl, coalesce(b.cos, 0) AS ce FROM a_cos a FULL JOIN b_cos b ON a.n = b.n AND a.h = b.h),
        best AS (SELECT n, key, max(nl + alpha * ce) AS best FROM s JOIN alpha USING (n) JOIN touched USING (h) GROUP BY n, key),
        f AS (SELECT n, key, round(coalesce(best, 0) + 0.1 * coalesce(fix, 0), 9) AS score FROM (SELECT n, key FROM (SELECT DISTINCT n FROM prompts), (SELECT key FROM keys)) LEFT JOIN best USING (n, key) LEFT JOIN fix USING (key)),
        k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, key) AS rank FROM f WHERE score > 0) SELECT CAST(n AS BIGINT) AS n, key, round(score + 1e-10, 6) AS score, rank FROM k WHERE rank <= 500""",
    "snapshot_bins": f"""{sql('units', recursive=True)}, times AS (SELECT DISTINCT repo, t FROM units WHERE t IS NOT NULL), starts AS (SELECT repo, min(t) AS t FROM times GROUP BY repo UNION ALL
        SELECT repo, next FROM (SELECT s.repo, (SELECT min(x.t) FROM times x WHERE x.repo = s.repo AND x.t > s.t + 5184000) AS next FROM starts s) WHERE next IS NOT NULL)
        SELECT times.repo, times.t, max(starts.t) AS start FROM times JOIN starts ON starts.repo = times.repo AND starts.t <= times.t GROUP BY times.repo, times.t""",
    "closing_links": f"{sql('units', 'reports')}, {_LINKED} SELECT DISTINCT n, h FROM closing",
    "commit_texts": f"""{sql('units', 'reports')}, {_LINKED} SELECT DISTINCT c.h, c.n, 0::BIGINT AS own FROM closing c JOIN reports r ON r.n = c.n WHERE NOT r.pr
        UNION ALL SELECT DISTINCT p.h, p.pr, 1 FROM prs p JOIN reports r ON r.n = p.pr WHERE r.pr""",
    "fixed_elements": f"{sql('gold')} SELECT n, key FROM gold",
    "simiscore": f"""{sql('reports', 'prompts', 'keys', 'gold')}, {_SIM}, size AS (SELECT n, count(*) AS size FROM gold GROUP BY n),
        s AS (SELECT sim.n, key, round(sum(sim / size), 9) AS score FROM sim JOIN size ON size.n = sim.doc JOIN gold ON gold.n = sim.doc GROUP BY sim.n, key),
        k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, key) AS rank FROM s WHERE score > 0 AND key IN (SELECT key FROM keys)) SELECT CAST(n AS BIGINT) AS n, key, round(score + 1e-10, 6) AS score, rank FROM k WHERE rank <= 500""",
    "issue_pool": f"""{sql('reports', 'prompts', 'gold')}, {_SIM}, k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY sim DESC, doc) AS rank FROM sim WHERE sim > 0 AND doc IN (SELECT n FROM gold))
        SELECT CAST(n AS BIGINT) AS n, CAST(doc AS BIGINT) AS doc, round(sim + 1e-10, 6) AS sim, rank FROM k WHERE rank <= 10""",
}
