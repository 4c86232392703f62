"""Queries of evidence: linked texts, pools, time limits, measures, and search by names and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidar.functions import terms
from evidar.operators import context, graph, history, issues, measure, rank, search, vectors
from evidar.tables import read

from . import domain
from . import graph as graphs
from . import search as searches
from .domain import six, sql
from .history import _FIT, _LINKED, _SIM, _cosine
from .text import code_texts


def _big(df, *names):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in names else c for c in df.columns])


def _listed(spark, d):
    return searches.hybrid(spark, d).select("n", F.regexp_replace("id", "^[^:]*:", "").alias("key"), "rank")


def _linked(spark, d):
    units, reports = domain.units(spark, d), domain.reports(spark, d)
    return units.join(history.linked_texts(units, reports, issues.commit_reports(units, reports, issues.closing_links(units, reports))), "h")


def msg_rank_linked(spark, d):
    """Elements by the best commit, commits with the text of the reports linked to them."""
    found = history.message_rank(domain.listed_prompts(spark, d), _linked(spark, d), _listed(spark, d), domain.keys(spark, d), "n")
    return _big(found.withColumn("score", six("score")), "n", "rank")


def message_pool(spark, d):
    """The ten commits that say most about a report."""
    found = history.message_pool(domain.listed_prompts(spark, d), _linked(spark, d), _listed(spark, d), domain.keys(spark, d), "n")
    return _big(found.select("n", "h", six("s").alias("s"), "best", "rank"), "n", "best", "rank")


def earlier_reports(spark, d):
    """Of the reports like another one those written at least a day before it, the ten best."""
    reports = domain.reports(spark, d)
    pool = issues.most_similar(reports.where(F.col("n") % 20 == 0), reports.where("not pr"), "n", 10, margin=86400)
    return _big(pool.withColumn("sim", six("sim")), "n", "doc", "rank")


def locus_terms(spark, d):
    """Commits as hunks under the term rules: stems of words, names of the graph, recency of fixes."""
    stop = terms.stop_words(spark)
    units = domain.units(spark, d)
    hunks = units.select(F.col("h").alias("hunk"), F.array_distinct(F.coalesce("touch", F.array().cast("array<string>"))).alias("ids"), F.coalesce("msg", F.lit("")).alias("text"))
    names = history.graph_names(domain.nodes(spark, d, "label", "name", "file"))
    found = history.locus(domain.prompts(spark, d), hunks, units, names, domain.keys(spark, d), "n", lambda t: terms.nl_terms(t, stop), terms.code_terms)
    return _big(found.withColumn("score", six("score")), "n", "rank")


def simiscore_terms(spark, d):
    """Elements by similar reports, under stems without stop words."""
    stop = terms.stop_words(spark)
    found = issues.simi_rank(domain.prompts(spark, d), domain.reports(spark, d).where("not pr"), domain.gold(spark, d), domain.keys(spark, d), "n", lambda t: terms.issue_terms(t, stop))
    return _big(found.select("key", "n", "score", "rank").withColumn("score", six("score")), "n", "rank")


def passage_pool(spark, d):
    """The ten best described passages of a report by words, which weigh as in passages and elements together."""
    both = F.trim(F.concat(F.coalesce("heading", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    chunks = read(spark, d, "chunk").groupBy("id").agg(F.max(F.struct("heading", "text")).alias("x")).select("id", "x.*").select("id", F.when(F.length(both) >= 5, both).otherwise(F.concat(F.lit("DocChunk "), "id")).alias("text"))
    ids = domain.nodes(spark, d, "label").select(F.col("id").alias("target"))
    described = read(spark, d, "doc_edge").join(ids, "target", "left_semi").select("chunk").distinct()
    found = search.passages(domain.prompts(spark, d), code_texts(spark, d), chunks, described)
    return _big(found.select("n", "id", six("bm25").alias("bm25"), six("score").alias("score"), "rank"), "n", "rank")


def list_overlap(spark, d):
    """How many of the ten best elements of two lists are the same."""
    rows = domain.cand(spark, d, "code")
    fused = rank.rrf([rank.ranked(rows, "n", [F.desc(c), F.asc("id")]) for c in ("bm25", "cos", "fused_score")], "n", "id")
    return _big(measure.overlap(searches.hybrid(spark, d), fused, "n", "id"), "n")


def _judged(spark, d):
    """Passages of a report in the order of their scores; those that describe an existing element count as useful."""
    told = read(spark, d, "doc_edge").join(domain.nodes(spark, d, "label").select(F.col("id").alias("target")), "target", "left_semi").select(F.col("chunk").alias("id")).distinct().withColumn("useful", F.lit(1))
    rows = rank.ranked(domain.cand(spark, d, "doc"), "n", [F.desc("bm25"), F.asc("id")], 10, out="pos")
    return rows.join(told, "id", "left").select("n", "id", "pos", F.coalesce("useful", F.lit(0)).alias("useful"), F.length("id").alias("tokens"), F.floor(F.col("cos") * 3.999).cast("int").alias("usefulness"), F.floor(F.col("bm25") % 4).cast("int").alias("relevance"))


def evidence_kept(spark, d):
    """What keeping the first five passages is worth."""
    return measure.kept_evidence(_judged(spark, d), F.col("pos") <= 5)


def evidence_by_position(spark, d):
    return _big(measure.quality_by_position(_judged(spark, d).select("pos", "useful", "usefulness", "relevance")), "pos")


def request_lengths(spark, d):
    return measure.lengths(domain.reports(spark, d))


def score_correlation(spark, d):
    """Correlation of the ranks of two scores over all candidates."""
    rho = measure.spearman(domain.cand(spark, d, "code"), "bm25", "cos")
    return spark.createDataFrame([(round(rho, 6) if rho is not None else None,)], "rho double")


def element_sizes(spark, d):
    return measure.lines_of_code(domain.nodes(spark, d, "label", "start_line", "end_line"))


def documentation_counts(spark, d):
    return measure.documentation_counts(read(spark, d, "chunk"), read(spark, d, "doc_edge"), domain.nodes(spark, d, "label"))


def reading_effort(spark, d):
    """Elements to read from a report's first five until one its fixes touched is met."""
    nodes = domain.nodes(spark, d, "label").where("label <> 'Module'")
    gold = domain.gold(spark, d).join(nodes.select("id", F.regexp_replace("id", "^[^:]*:", "").alias("key")), "key").select("n", "id").distinct()
    steps = graph.both_ways(graphs._real(spark, d))
    return _big(measure.reading_effort(searches.hybrid(spark, d), gold, steps, "n", 5, nodes.count()), "n", "layer")


def _seeds(spark, d):
    names = domain.prompts(spark, d).select("n", F.explode(searches.identifiers(F.col("text"))).alias("name"))
    by_name = search.name_seeds(names, domain.nodes(spark, d, "label", "name", "file"))
    return by_name


def name_seeds(spark, d):
    """Elements that a report names, by name, file or end of a path."""
    return _big(_seeds(spark, d), "n", "place")


def graph_seeds(spark, d):
    """Seeds by name, then those among a report's fifteen best by words that no name gave."""
    words = search.words(domain.prompts(spark, d), code_texts(spark, d), top=search.WORD_SEEDS)
    return _big(search.seeds(_seeds(spark, d), words), "n")


def neighbourhood(spark, d):
    """Up to 60 elements within two steps of the elements at the head of a report's list."""
    near = search.neighbourhood(searches.hybrid(spark, d).where("rank <= 10"), graph.both_ways(graphs._real(spark, d)))
    return _big(near, "n", "hop", "place")


def voted_files(spark, d):
    """Files by their elements in that neighbourhood."""
    seeds = searches.hybrid(spark, d).where("rank <= 10").select("n", "id")
    near = search.neighbourhood(seeds, graph.both_ways(graphs._real(spark, d)))
    return _big(search.voted_files(near, seeds, domain.nodes(spark, d, "file")), "n", "place")


def ranked_neighbours(spark, d):
    """Callers and callees of the elements at the head of a report's list: those high in the list first."""
    lists = searches.hybrid(spark, d)
    calls = graph.anchored(domain.calls(spark, d), graphs._ids(spark, d))
    return _big(graph.ranked_neighbours(lists.where("rank <= 10").select("n", "id"), calls, lists, "n"), "n", "place", "total")


def named_elements(spark, d):
    """Functions and classes whose name stands in a report as a word."""
    names = domain.nodes(spark, d, "label", "name").where("label <> 'Module'").select("name")
    return _big(search.mentions(domain.prompts(spark, d), names), "n")


def visible_edges(spark, d):
    """Calls between functions, as a view that shows nothing else."""
    nodes = domain.nodes(spark, d, "label")
    return search.visible(nodes, graphs._edges(spark, d), ["Function"], ["Calls"])[1].select("source", "target").distinct()


def linked_share(spark, d):
    """Share of the shown passages that describe a shown element."""
    code = searches.ast_hybrid(spark, d).where("rank <= 10").select("n", F.concat(F.lit("C"), F.col("rank").cast("string")).alias("tag"), "id")
    edges = read(spark, d, "doc_edge").groupBy("chunk").agg(F.collect_set("target").alias("targets"))
    pool = searches.doc_pool(spark, d).select("n", F.lit("D").alias("section"), F.concat(F.lit("D"), F.col("rank").cast("string")).alias("tag"), (F.col("rank") <= 5).alias("in_context"), F.col("id").alias("chunk"))
    items = pool.join(edges, "chunk", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))
    return _big(context.linked_ratio(items, context.linked(items, code)), "n")


def cosine_ivf(spark, d):
    """Of every 20th vector the ten nearest by an inverted file."""
    rows = read(spark, d, "embeddings")
    centre = vectors.fit(rows, "vec_id", "embedding")
    return vectors.search(rows, "vec_id", "embedding", F.col("vec_id") % 20 == 0, centre, depth=10)


QUERIES = {
    f.__name__: f
    for f in (
        msg_rank_linked, message_pool, earlier_reports, locus_terms, simiscore_terms, passage_pool, list_overlap, evidence_kept, evidence_by_position, request_lengths, score_correlation, element_sizes,
        documentation_counts, reading_effort, name_seeds, graph_seeds, neighbourhood, voted_files, ranked_neighbours, named_elements, visible_edges, linked_share, cosine_ivf,
    )
}

_TEXTS = f"""{_LINKED}, said AS (SELECT c.h, string_agg(chr(10) || coalesce(r.title, '') || chr(10) || coalesce(r.body, ''), '') AS said FROM (SELECT DISTINCT c.h, c.n FROM closing c JOIN reports r ON r.n = c.n WHERE NOT r.pr UNION ALL SELECT DISTINCT p.h, p.pr FROM prs p JOIN reports r ON r.n = p.pr WHERE r.pr) c JOIN reports r ON r.n = c.n GROUP BY c.h),
    {_FIT}, docs AS (SELECT fit.h, coalesce(msg, '') || coalesce(said, '') AS msg FROM fit LEFT JOIN said ON said.h = fit.h)"""
_POOL = f"""{sql('reports', 'listed', 'units', 'keys', 'touched', 'elements', 'code', 'hybrid')}, {_TEXTS}, {_cosine('docs', 'h', 'msg')},
    text_list AS (SELECT n, h, row_number() OVER (PARTITION BY n ORDER BY round(cos, 9) DESC, t DESC, h) AS rank FROM cos JOIN fit USING (h) WHERE round(cos, 9) > 0),
    listed AS (SELECT n, regexp_replace(id, '^[^:]*:', '') AS key, rank FROM hybrid),
    near AS (SELECT n, h, min(rank) AS best, max(t) AS t FROM touched JOIN listed USING (key) WHERE h IN (SELECT h FROM fit) GROUP BY n, h),
    near_list AS (SELECT n, h, best, row_number() OVER (PARTITION BY n ORDER BY best, t DESC, h) AS rank FROM near),
    s AS (SELECT n, h, max(best) AS best, sum(1.0 / (60 + rank)) AS s FROM (SELECT n, h, NULL AS best, rank FROM text_list UNION ALL SELECT n, h, best, rank FROM near_list) GROUP BY n, h)"""
_JUDGED = f"""{sql('nodes', 'doc')}, judged AS (SELECT d.n, d.id, row_number() OVER (PARTITION BY n ORDER BY bm25 DESC, id) AS pos, (d.id IN (SELECT chunk FROM doc_edge WHERE target IN (SELECT id FROM nodes)))::INT AS useful, length(d.id) AS tokens,
    floor(cos * 3.999)::INT AS usefulness, floor(bm25 % 4)::INT AS relevance FROM doc d QUALIFY pos <= 10)"""
_ENDS = """look AS (SELECT id, label, name FROM nodes UNION SELECT id, label, file FROM nodes WHERE file IS NOT NULL
    UNION SELECT id, label, array_to_string(string_split(left(file, length(file) - 3), '/')[i:], '/') FROM (SELECT id, label, file, unnest(generate_series(2, len(string_split(file, '/')))) AS i FROM nodes WHERE file LIKE '%.py')),
    m AS (SELECT DISTINCT n, id, label FROM names JOIN look USING (name)),
    named AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY CASE label WHEN 'Function' THEN 0 WHEN 'Class' THEN 1 ELSE 2 END, id) AS place FROM m QUALIFY place <= 30)"""
_NEAR = f"{sql(*graphs._HYBRID)}, {graphs._ball(2)}, near AS (SELECT n, id, hop, row_number() OVER (PARTITION BY n ORDER BY hop, id) AS place FROM ball QUALIFY place <= 60)"
SQL = {
    "msg_rank_linked": f"{_POOL}, b AS (SELECT n, key, round(max(s), 9) AS score FROM s JOIN touched USING (h) WHERE key IN (SELECT key FROM keys) GROUP BY n, key), k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, key) AS rank FROM b) SELECT CAST(n AS BIGINT) AS n, key, round(score + 1e-10, 6) AS score, rank FROM k WHERE rank <= 500",
    "message_pool": f"{_POOL}, k AS (SELECT s.n, s.h, round(s, 9) AS s, best, row_number() OVER (PARTITION BY s.n ORDER BY round(s, 9) DESC, t DESC, s.h) AS rank FROM s JOIN fit ON fit.h = s.h) SELECT CAST(n AS BIGINT) AS n, h, round(s + 1e-10, 6) AS s, CAST(best AS BIGINT) AS best, rank FROM k WHERE rank <= 10",
    "earlier_reports": f"""{sql('reports', 'prompts')}, {_SIM}, safe AS (SELECT sim.* FROM sim JOIN reports q ON q.n = sim.n JOIN reports r ON r.n = sim.doc WHERE r.created <= q.created - 86400 AND sim > 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY sim DESC, doc) AS rank FROM safe) SELECT CAST(n AS BIGINT) AS n, CAST(doc AS BIGINT) AS doc, round(sim + 1e-10, 6) AS sim, rank FROM k WHERE rank <= 10""",
    "list_overlap": f"""{sql('elements', 'code', 'hybrid')}, r AS (SELECT n, id, row_number() OVER (PARTITION BY n ORDER BY bm25 DESC, id) AS a, row_number() OVER (PARTITION BY n ORDER BY cos DESC, id) AS b, row_number() OVER (PARTITION BY n ORDER BY fused_score DESC, id) AS c FROM code),
        f AS (SELECT n, id, row_number() OVER (PARTITION BY n ORDER BY round(1.0 / (60 + a) + 1.0 / (60 + b) + 1.0 / (60 + c), 9) DESC, a, id) AS rank FROM r),
        g AS (SELECT DISTINCT n FROM hybrid WHERE rank <= 10 UNION SELECT DISTINCT n FROM f WHERE rank <= 10)
        SELECT CAST(g.n AS BIGINT) AS n, count(f.id) AS overlap FROM g LEFT JOIN (SELECT n, id FROM hybrid WHERE rank <= 10) h ON h.n = g.n LEFT JOIN (SELECT n, id FROM f WHERE rank <= 10) f ON f.n = g.n AND f.id = h.id GROUP BY g.n""",
    "evidence_kept": f"""{_JUDGED}, o AS (SELECT n, sum(useful) AS there, sum(useful * (pos <= 5)::INT) AS tp, sum((pos <= 5)::INT) AS shown, sum(tokens * (pos <= 5)::INT) AS tok FROM judged GROUP BY n), x AS (SELECT *, shown - tp AS fp, there - tp AS fn FROM o)
        SELECT round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 6) AS precision, round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 6) AS recall, round(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 6) AS f1, round(avg(2 * tp - fp), 6) AS t11u,
            CAST(count(*) FILTER (shown = 0 AND there > 0) AS BIGINT) AS empty_has, CAST(count(*) FILTER (shown = 0 AND there = 0) AS BIGINT) AS empty_none, CAST(count(*) FILTER (shown > 0 AND there > 0) AS BIGINT) AS shown_has,
            CAST(count(*) FILTER (shown > 0 AND there = 0) AS BIGINT) AS shown_none, round(avg(tok), 6) AS mean_tokens FROM x""",
    "evidence_by_position": f"{_JUDGED} SELECT pos, count(*) AS n, round(avg(useful), 6) AS useful, round(avg(usefulness), 6) AS usefulness, round(avg(relevance), 6) AS relevance FROM judged GROUP BY pos",
    "request_lengths": f"{sql('reports')} SELECT count(*) AS n, round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text), 0.9), 6) AS p90, CAST(max(length(text)) AS BIGINT) AS most FROM reports",
    "score_correlation": f"""{sql('code')}, r AS (SELECT rank() OVER (ORDER BY bm25) + (count(*) OVER (PARTITION BY bm25) - 1) / 2.0 AS x, rank() OVER (ORDER BY cos) + (count(*) OVER (PARTITION BY cos) - 1) / 2.0 AS y FROM code) SELECT round(corr(x, y), 6) AS rho FROM r""",
    "element_sizes": f"{sql('nodes')} SELECT label, count(*) AS n, round(avg(end_line - start_line + 1), 6) AS mean_lines FROM nodes WHERE start_line IS NOT NULL AND end_line IS NOT NULL AND label <> 'Module' GROUP BY label",
    "documentation_counts": f"{sql('ids')}, e AS (SELECT DISTINCT chunk, target FROM doc_edge WHERE target IN (SELECT id FROM ids) AND chunk IN (SELECT id FROM chunk)) SELECT (SELECT count(DISTINCT id) FROM chunk) AS chunks, count(DISTINCT chunk) AS linked_chunks, count(*) AS links, count(DISTINCT target) AS elements FROM e",
    "name_seeds": f"{sql('nodes', 'reports', 'prompts')}, {searches._names()}, {_ENDS} SELECT CAST(n AS BIGINT) AS n, id, label, place FROM named",
    "neighbourhood": f"{_NEAR} SELECT CAST(n AS BIGINT) AS n, id, CAST(hop AS BIGINT) AS hop, place FROM near",
    "voted_files": f"""{_NEAR.replace(sql(*graphs._HYBRID), sql('nodes', *graphs._HYBRID))}, v AS (SELECT near.n, file, sum(CASE WHEN seeds.id IS NOT NULL THEN 3 ELSE 1 END) AS votes FROM near JOIN nodes USING (id) LEFT JOIN seeds ON seeds.n = near.n AND seeds.id = near.id WHERE file IS NOT NULL GROUP BY near.n, file)
        SELECT CAST(n AS BIGINT) AS n, file, CAST(votes AS BIGINT) AS votes, row_number() OVER (PARTITION BY n ORDER BY votes DESC, file) AS place FROM v""",
    "ranked_neighbours": f"""{sql('elements', 'code', 'hybrid', 'ids')}, e AS (SELECT DISTINCT caller AS s, callee AS t FROM call_edge WHERE caller IN (SELECT id FROM ids) AND callee IN (SELECT id FROM ids)),
        b AS (SELECT n, h.id, 'out' AS direction, t AS other FROM hybrid h JOIN e ON e.s = h.id WHERE rank <= 10 UNION ALL SELECT n, h.id, 'in', s FROM hybrid h JOIN e ON e.t = h.id WHERE rank <= 10),
        k AS (SELECT b.*, row_number() OVER (PARTITION BY b.n, b.id, direction ORDER BY l.rank NULLS LAST, other) AS place, count(*) OVER (PARTITION BY b.n, b.id, direction) AS total FROM b LEFT JOIN hybrid l ON l.n = b.n AND l.id = b.other)
        SELECT CAST(n AS BIGINT) AS n, id, direction, other, place, total FROM k WHERE place <= 10""",
    "named_elements": f"{sql('nodes', 'reports', 'prompts')}, w AS (SELECT DISTINCT n, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS name FROM prompts) SELECT CAST(n AS BIGINT) AS n, name FROM w WHERE name IN (SELECT name FROM nodes WHERE label <> 'Module')",
    "visible_edges": f"{sql('nodes')} SELECT DISTINCT caller AS source, callee AS target FROM call_edge WHERE caller IN (SELECT id FROM nodes WHERE label = 'Function') AND callee IN (SELECT id FROM nodes WHERE label = 'Function')",
    "linked_share": f"""{searches._TAGS}, shown AS (SELECT n, id FROM hybrid WHERE rank <= 10), x AS (SELECT p.n, p.rank <= 5 AS shown, (EXISTS (SELECT 1 FROM doc_edge e JOIN shown s ON s.id = e.target WHERE e.chunk = p.id AND s.n = p.n))::INT AS hit FROM pool p)
        SELECT CAST(n AS BIGINT) AS n, 'D' AS section, round(sum(CASE WHEN shown THEN hit ELSE 0 END) / nullif(sum(shown::INT), 0), 4) AS ratio FROM x GROUP BY n""",
}
