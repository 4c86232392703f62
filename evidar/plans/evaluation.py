"""Queries of evaluation: file metrics, list metrics, paired tests, agreement, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidar.functions.text import key_of
from evidar.operators import evaluate, rank
from evidar.tables import read

from . import domain, search
from .domain import sql

SYSTEMS = ("bm25", "cos", "fused_score")


def _lists(spark, d):
    """(system, n, repo, key, rank): the candidates of every report by each score."""
    rows = domain.cand(spark, d, "code").join(domain.reports(spark, d).select("n", "repo"), "n").withColumn("key", key_of(F.col("id")))
    out = None
    for s in SYSTEMS:
        one = rank.ranked(rows, "n", [F.desc(s), F.asc("id")]).select(F.lit(s).alias("system"), "n", "repo", "key", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def _gold(spark, d):
    """(n, repo, key): candidates of a report that documentation describes, as stand-in judgements for every report with candidates."""
    told = read(spark, d, "doc_edge").select(F.col("target").alias("id")).distinct()
    rows = domain.cand(spark, d, "code").join(told, "id", "left_semi").join(domain.reports(spark, d).select("n", "repo"), "n")
    return rows.select("n", "repo", key_of(F.col("id")).alias("key"))


def _metrics(spark, d):
    return evaluate.list_metrics(_lists(spark, d), _gold(spark, d), ["n", "repo"])


def prf(spark, d):
    """Files of the five best places against files a report's fixes touched."""
    predicted = search.file_rank(spark, d).select("n", "file")
    touched = domain.gold(spark, d).select("n", F.regexp_replace("key", ":.*$", "").alias("file")).distinct()
    return evaluate.precision_recall(predicted, touched, "n", "file")


def topk_mrr_map(spark, d):
    m = _metrics(spark, d)
    return m.select("system", "n", "gold", "best", "mrr", "map", *[F.col(c).cast("bigint").alias(c) for c in ("top1", "acc1", "top5", "acc5", "top10", "acc10")])


def system_means_grouping_sets(spark, d):
    return evaluate.system_means(_metrics(spark, d))


def mcnemar_counts(spark, d):
    m = _metrics(spark, d)
    return evaluate.discordant(m, "bm25", "cos", ["n"])


def win_loss(spark, d):
    return evaluate.win_loss(_metrics(spark, d), "bm25", "cos", ["n"])


def holm(spark, d):
    """Shares of reports a score gets wrong, as if they were p values of a family of tests."""
    means = evaluate.system_means(_metrics(spark, d)).where("repo is not null").select(F.concat_ws("/", "repo", "system").alias("test"), (F.lit(1.0) - F.col("mrr")).alias("p"))
    return evaluate.holm(means.select("test", F.round("p", 6).alias("p")))


def kappa(spark, d):
    """Agreement of two scores that grade a report's candidates by quarters."""
    rows = domain.cand(spark, d, "code")
    grade = rows
    for s in ("bm25", "cos"):
        grade = rank.ranked(grade, "n", [F.desc(s), F.asc("id")], out=f"{s}_rank")
    size = rows.groupBy("n").agg(F.count("*").alias("m"))
    graded = grade.join(size, "n").select(*[F.floor((F.col(f"{s}_rank") - 1) * 4 / F.col("m")).cast("bigint").alias(s) for s in ("bm25", "cos")])
    return evaluate.kappa(graded, "bm25", "cos")


def deterministic_sample(spark, d):
    return evaluate.sample(domain.reports(spark, d), "repo", "n", 3).select("repo", F.col("n").cast("bigint").alias("n"), F.col("place").cast("bigint").alias("place"))


QUERIES = {f.__name__: f for f in (prf, topk_mrr_map, system_means_grouping_sets, mcnemar_counts, win_loss, holm, kappa, deterministic_sample)}

_RANKS = " UNION ALL ".join(
    f"SELECT '{s}' AS system, c.n, r.repo, regexp_replace(id, '^[^:]*:', '') AS key, row_number() OVER (PARTITION BY c.n ORDER BY {s} DESC, id) AS rank FROM code c JOIN reports r ON r.n = c.n" for s in SYSTEMS
)
_CUTS = ", ".join(f"max(coalesce(rank <= {k}, false)::BIGINT) AS top{k}, min(coalesce(rank <= {k}, false)::BIGINT) AS acc{k}" for k in (1, 5, 10))
_METRICS = f"""{sql('reports', 'code')}, lists AS ({_RANKS}), wanted AS (SELECT DISTINCT c.n, r.repo, regexp_replace(id, '^[^:]*:', '') AS key FROM code c JOIN reports r ON r.n = c.n WHERE id IN (SELECT target FROM doc_edge)),
    placed AS (SELECT s.system, w.n, w.repo, w.key, l.rank, row_number() OVER (PARTITION BY s.system, w.n, w.repo ORDER BY l.rank NULLS LAST, w.key) AS nth FROM (SELECT DISTINCT system, n, repo FROM lists) s JOIN wanted w ON w.n = s.n AND w.repo IS NOT DISTINCT FROM s.repo
        LEFT JOIN (SELECT * FROM lists WHERE rank <= 500) l ON l.system = s.system AND l.n = w.n AND l.key = w.key),
    metrics AS (SELECT system, n, repo, count(*) AS gold, coalesce(min(rank), 501) AS best, round(coalesce(1.0 / min(rank), 0), 6) AS mrr, round(sum(CASE WHEN rank IS NOT NULL THEN nth / rank ELSE 0 END) / count(*), 6) AS map, {_CUTS} FROM placed GROUP BY system, n, repo)"""
_MEANS = f"{_METRICS}, means AS (SELECT repo, system, count(*) AS n, round(avg(top10), 6) AS top10, round(avg(mrr), 6) AS mrr, round(avg(map), 6) AS map FROM metrics GROUP BY GROUPING SETS ((system), (repo, system)))"
SQL = {
    "prf": f"""{sql('nodes', 'elements', 'code', 'hybrid', 'gold')}, f AS (SELECT n, file, min(rank) AS best FROM hybrid h JOIN nodes USING (id) WHERE file IS NOT NULL GROUP BY n, file),
        p AS (SELECT n, file FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY best) AS k FROM f) WHERE k <= 5), g AS (SELECT DISTINCT n, regexp_replace(key, ':.*$', '') AS file FROM gold),
        x AS (SELECT n, coalesce(tp, 0) AS tp, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng FROM (SELECT n, count(*) AS np FROM p GROUP BY n) FULL JOIN (SELECT n, count(*) AS ng FROM g GROUP BY n) USING (n) LEFT JOIN (SELECT n, count(*) AS tp FROM p JOIN g USING (n, file) GROUP BY n) USING (n)),
        y AS (SELECT n, tp, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS a, CASE WHEN ng > 0 THEN tp / ng ELSE 0 END AS b FROM x)
        SELECT n, tp, round(a, 6) AS precision, round(b, 6) AS recall, round(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END, 6) AS f1 FROM y""",
    "topk_mrr_map": f"{_METRICS} SELECT system, n, gold, best, mrr, map, top1, acc1, top5, acc5, top10, acc10 FROM metrics",
    "system_means_grouping_sets": f"{_MEANS} SELECT * FROM means",
    "mcnemar_counts": f"""{_METRICS} SELECT CAST(coalesce(sum((a.top10 = 1 AND b.top10 = 0)::BIGINT), 0) AS BIGINT) AS b, CAST(coalesce(sum((a.top10 = 0 AND b.top10 = 1)::BIGINT), 0) AS BIGINT) AS c
        FROM (SELECT * FROM metrics WHERE system = 'bm25') a JOIN (SELECT * FROM metrics WHERE system = 'cos') b USING (n)""",
    "win_loss": f"""{_METRICS}, p AS (SELECT a.best AS x, b.best AS y FROM (SELECT * FROM metrics WHERE system = 'bm25') a JOIN (SELECT * FROM metrics WHERE system = 'cos') b USING (n)),
        q AS (SELECT x, y, unnest([CASE WHEN x <= 10 THEN '1-10' WHEN x <= 100 THEN '11-100' ELSE '101-' END, 'all']) AS bucket FROM p)
        SELECT bucket, CAST(sum((x > y)::BIGINT) AS BIGINT) AS wins, CAST(sum((x < y)::BIGINT) AS BIGINT) AS losses, CAST(sum((x = y)::BIGINT) AS BIGINT) AS ties FROM q GROUP BY bucket""",
    "holm": f"""{_MEANS}, t AS (SELECT concat_ws('/', repo, system) AS test, round(1.0 - mrr, 6) AS p FROM means WHERE repo IS NOT NULL),
        s AS (SELECT test, p, ((SELECT count(*) FROM t) - row_number() OVER (ORDER BY p, test) + 1) * p AS raised FROM t) SELECT test, p, round(least(1.0, max(raised) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING)), 9) AS adjusted FROM s""",
    "kappa": f"""{sql('code')}, g AS (SELECT floor((row_number() OVER (PARTITION BY n ORDER BY bm25 DESC, id) - 1) * 4 / count(*) OVER (PARTITION BY n)) AS a, floor((row_number() OVER (PARTITION BY n ORDER BY cos DESC, id) - 1) * 4 / count(*) OVER (PARTITION BY n)) AS b FROM code),
        o AS (SELECT count(*) AS n, avg((a = b)::INT) AS o, avg((a - b) * (a - b)) AS d, avg(a) AS ma, avg(b) AS mb, avg(a * a) AS sa, avg(b * b) AS sb FROM g),
        c AS (SELECT sum(x.n * y.n) / (SELECT n * n FROM o) AS pe FROM (SELECT a, count(*) AS n FROM g GROUP BY a) x JOIN (SELECT b, count(*) AS n FROM g GROUP BY b) y ON x.a = y.b)
        SELECT n, round(o, 6) AS agreement, round(CASE WHEN pe < 1 THEN (o - pe) / (1 - pe) END, 6) AS kappa, round(CASE WHEN sa + sb - 2 * ma * mb > 0 THEN 1 - d / (sa + sb - 2 * ma * mb) END, 6) AS weighted FROM o, c""",
    "deterministic_sample": f"{sql('reports')}, k AS (SELECT repo, n, row_number() OVER (PARTITION BY repo ORDER BY sha1(CAST(n AS VARCHAR)), n) AS place FROM reports) SELECT repo, CAST(n AS BIGINT) AS n, place FROM k WHERE place <= 3",
}
