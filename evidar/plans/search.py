"""Queries of ranked search: BM25, cosine, fusion, pools, look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidar.functions.text import identifiers
from evidar.operators import rank
from evidar.tables import read

from . import domain
from .domain import six, sql, tokens_sql
from .text import NODE_TEXT_SQL, code_texts


def bm25_topk(spark, d):
    """Reports against all code elements: lists of 500, elements without a common term included by id."""
    return rank.bm25(domain.prompts(spark, d), code_texts(spark, d), "n", "id").select(F.col("n").cast("bigint").alias("n"), "id", six("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def cosine_topk(spark, d):
    """Every 20th vector against all vectors."""
    found = rank.cosine(read(spark, d, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)
    return found.select("query", "id", six("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def hybrid_lists(spark, d, section="code"):
    rows = domain.cand(spark, d, section)
    by = lambda c: rank.ranked(rows, "n", [F.desc(c), F.asc("id")], base=0)
    return by("bm25"), by("cos")


def hybrid(spark, d):
    """Fusion of both lists from rank 0, cut to 500 and then filtered to functions and classes."""
    fused = rank.rrf(list(hybrid_lists(spark, d)), "n", "id", depth=None).drop("rank")
    cut = rank.ranked(fused, "n", [F.desc("score"), F.asc("id")], rank.DEPTH).drop("rank")
    kept = cut.join(domain.elements(spark, d).select("id"), "id", "left_semi")
    return rank.ranked(kept, "n", [F.desc("score"), F.asc("id")])


def _out(df):
    return df.select("n", "id", six("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def ast_hybrid(spark, d):
    return _out(hybrid(spark, d))


def doc_pool(spark, d):
    """The ten best passages of a report."""
    fused = rank.rrf(list(hybrid_lists(spark, d, "doc")), "n", "id", depth=None).drop("rank")
    return _out(rank.ranked(fused, "n", [F.desc("score"), F.asc("id")], 10))


def rrf_fuse(spark, d):
    """Three lists from rank 1; ties by the first list."""
    rows = domain.cand(spark, d, "code")
    return _out(rank.rrf([rank.ranked(rows, "n", [F.desc(c), F.asc("id")]) for c in ("bm25", "cos", "fused_score")], "n", "id"))


def file_rank(spark, d):
    files = domain.nodes(spark, d, "file").where("file is not null")
    return rank.file_rank(hybrid(spark, d), files, "n", "id").select("n", "file", *[F.col(c).cast("bigint").alias(c) for c in ("position", "best_pos")], "best_id")


def find_entities(spark, d):
    """Names in a report that are names of functions or classes, or ends of module paths; 30 a report."""
    names = domain.prompts(spark, d).select("n", F.explode(identifiers(F.col("text"))).alias("name")).distinct()
    nodes = domain.nodes(spark, d, "label", "name", "file")
    code = nodes.where("label <> 'Module'").select("id", "label", "name", F.lit(0).alias("how"))
    paths = nodes.where("label = 'Module' and file is not null").select("id", "label", F.explode(rank.suffixes(F.col("file"))).alias("name"), F.lit(1).alias("how"))
    hits = names.join(code.unionByName(paths), "name")
    # the first name in order decides, names before paths
    best = hits.groupBy("n", "id", "label").agg(F.min(F.struct("name", "how")).alias("x")).select("n", "id", "label", F.col("x.name").alias("matched"))
    order = F.when(F.col("label") == "Function", 0).when(F.col("label") == "Class", 1).otherwise(2)
    return rank.ranked(best, "n", [order, F.asc("id")], 30, out="place").select("n", "id", "label", "matched", F.col("place").cast("bigint").alias("place"))


def quota_tags(spark, d):
    """Pools with their tags: ten of each kind, the first five passages and ten elements are shown."""
    doc = doc_pool(spark, d).select("n", "id", F.lit("D").alias("kind"), "rank", F.lit(5).alias("quota"))
    code = ast_hybrid(spark, d).where("rank <= 10").select("n", "id", F.lit("C").alias("kind"), "rank", F.lit(10).alias("quota"))
    return doc.unionByName(code).select("n", "id", F.concat("kind", F.col("rank").cast("string")).alias("tag"), (F.col("rank") <= F.col("quota")).alias("in_context"))


def evidence_links(spark, d):
    """Shown passages that describe a shown element: which, and how many of a report's passages do."""
    shown = ast_hybrid(spark, d).where("rank <= 10").select("n", F.col("id").alias("target"), F.concat(F.lit("C"), F.col("rank").cast("string")).alias("code_tag"))
    pool = doc_pool(spark, d).select("n", F.col("id").alias("chunk"), F.concat(F.lit("D"), F.col("rank").cast("string")).alias("tag"))
    edges = read(spark, d, "doc_edge").distinct()
    return pool.join(edges, "chunk").join(shown, ["n", "target"]).select("n", "tag", "code_tag").distinct()


QUERIES = {f.__name__: f for f in (bm25_topk, cosine_topk, ast_hybrid, doc_pool, rrf_fuse, file_rank, find_entities, quota_tags, evidence_links)}

_POOL = """pool_all AS (SELECT n, id, round(1.0 / (60 + row_number() OVER (PARTITION BY n ORDER BY bm25 DESC, id) - 1) + 1.0 / (60 + row_number() OVER (PARTITION BY n ORDER BY cos DESC, id) - 1), 9) AS score,
        row_number() OVER (PARTITION BY n ORDER BY bm25 DESC, id) AS first FROM doc),
    pool AS (SELECT * FROM (SELECT n, id, score, row_number() OVER (PARTITION BY n ORDER BY score DESC, id) AS rank FROM pool_all) WHERE rank <= 10)"""
_TAGS = f"{sql('elements', 'code', 'hybrid', 'doc')}, {_POOL}"
_NAMES = r"""names AS (SELECT DISTINCT n, unnest(x) AS name FROM (SELECT n, list_concat(
        list_filter(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b[A-Z][a-zA-Z0-9]{2,}\b'), lambda z: z NOT IN (@STOP)), regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', 'Z', 'g'), '\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b'),
        list_filter(regexp_extract_all(text, '[`''"]([a-zA-Z_][a-zA-Z0-9_]*)[`''"]', 1), lambda z: length(z) > 2), regexp_extract_all(text, '[a-zA-Z0-9_/]+\.py'),
        list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z0-9_/]+\.py'), lambda p: replace(string_split(p, '/')[-1], '.py', '')), lambda b: b <> '' AND b NOT IN (@STOP))) AS x FROM prompts))"""


def _names():
    from .text import _STOP

    return _NAMES.replace("@STOP", _STOP)


SQL = {
    "bm25_topk": f"""{sql('nodes', 'reports', 'prompts')}, docs AS (SELECT id, {NODE_TEXT_SQL} AS text FROM nodes),
        post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({tokens_sql('text')}) AS term FROM docs) GROUP BY ALL),
        dl AS (SELECT id, sum(tf) AS dl FROM post GROUP BY id), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
        raw AS (SELECT term, ln((SELECT count(*) FROM docs) + 0.5 - df) - ln(df + 0.5) AS raw FROM df),
        idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
        q AS (SELECT n, term, count(*) AS qtf FROM (SELECT n, unnest({tokens_sql('text')}) AS term FROM prompts) GROUP BY ALL),
        hit AS (SELECT n, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT sum(dl) / (SELECT count(*) FROM docs) FROM dl)))), 9) AS score FROM q JOIN post USING (term) JOIN idf USING (term) JOIN dl USING (id) GROUP BY n, id),
        every AS (SELECT n, id FROM (SELECT DISTINCT n FROM prompts), (SELECT id FROM docs)),
        r AS (SELECT n, id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY n ORDER BY coalesce(score, 0) DESC, id) AS rank FROM every LEFT JOIN hit USING (n, id))
        SELECT CAST(n AS BIGINT) AS n, id, round(score + 1e-10, 6) AS score, rank FROM r WHERE rank <= 500""",
    "cosine_topk": """WITH p AS (SELECT q.vec_id AS query, r.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM p) SELECT query, id, round(score + 1e-10, 6) AS score, rank FROM k WHERE rank <= 500""",
    "ast_hybrid": f"{sql('elements', 'code', 'hybrid')} SELECT n, id, round(score + 1e-10, 6) AS score, rank FROM hybrid",
    "doc_pool": f"{sql('doc')}, {_POOL} SELECT n, id, round(score + 1e-10, 6) AS score, rank FROM pool",
    "rrf_fuse": f"""{sql('code')}, r AS (SELECT n, id, row_number() OVER (PARTITION BY n ORDER BY bm25 DESC, id) AS a, row_number() OVER (PARTITION BY n ORDER BY cos DESC, id) AS b, row_number() OVER (PARTITION BY n ORDER BY fused_score DESC, id) AS c FROM code),
        s AS (SELECT n, id, a, round(1.0 / (60 + a) + 1.0 / (60 + b) + 1.0 / (60 + c), 9) AS score FROM r), k AS (SELECT n, id, score, row_number() OVER (PARTITION BY n ORDER BY score DESC, a, id) AS rank FROM s)
        SELECT n, id, round(score + 1e-10, 6) AS score, rank FROM k WHERE rank <= 500""",
    "file_rank": f"""{sql('nodes', 'elements', 'code', 'hybrid')}, f AS (SELECT n, file, min(rank) AS best_pos, min_by(h.id, rank) AS best_id FROM hybrid h JOIN nodes USING (id) WHERE file IS NOT NULL GROUP BY n, file),
        k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY best_pos) AS position FROM f) SELECT n, file, position, best_pos, best_id FROM k WHERE position <= 5""",
    "find_entities": f"""{sql('nodes', 'reports', 'prompts')}, {_names()},
        ends AS (SELECT id, label, unnest(list_transform(generate_series(1, len(string_split(file, '/'))), lambda i: array_to_string(string_split(file, '/')[i:], '/'))) AS name FROM nodes WHERE label = 'Module' AND file IS NOT NULL),
        look AS (SELECT id, label, name FROM nodes WHERE label <> 'Module' UNION ALL SELECT id, label, name FROM ends UNION ALL SELECT id, label, regexp_replace(name, '\\.py$', '') FROM ends WHERE name LIKE '%.py'),
        m AS (SELECT n, id, label, min(name) AS matched FROM names JOIN look USING (name) GROUP BY n, id, label),
        k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY CASE label WHEN 'Function' THEN 0 WHEN 'Class' THEN 1 ELSE 2 END, id) AS place FROM m) SELECT n, id, label, matched, place FROM k WHERE place <= 30""",
    "quota_tags": f"{_TAGS} SELECT n, id, 'D' || rank AS tag, rank <= 5 AS in_context FROM pool UNION ALL SELECT n, id, 'C' || rank, true FROM hybrid WHERE rank <= 10",
    "evidence_links": f"{_TAGS} SELECT DISTINCT p.n, 'D' || p.rank AS tag, 'C' || h.rank AS code_tag FROM pool p JOIN doc_edge e ON e.chunk = p.id JOIN hybrid h ON h.id = e.target AND h.n = p.n WHERE h.rank <= 10",
}
