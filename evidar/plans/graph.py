"""Queries on the property graph: upserts, dangling edges, neighbourhoods, paths, votes, spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidar.operators import diff, graph
from evidar.tables import read

from . import domain, search
from .domain import six, sql


def _ids(spark, d):
    return read(spark, d, "node").where(F.col("label").isin(*domain.CODE)).select("id").distinct()


def _edges(spark, d):
    return domain.calls(spark, d).unionByName(domain.defines(spark, d))


def _real(spark, d):
    return graph.unique_edges(graph.anchored(_edges(spark, d), _ids(spark, d)))


def _seeds(spark, d):
    """(n, id): elements in the ten best of the hybrid list of every report with candidates."""
    return search.hybrid(spark, d).where("rank <= 10").select("n", "id")


def label_counts(spark, d):
    return domain.nodes(spark, d, "label").groupBy("label").agg(F.count("*").alias("nodes"))


def edge_counts(spark, d):
    return _real(spark, d).groupBy("type").agg(F.count("*").alias("edges"))


def edge_dedup(spark, d):
    return _real(spark, d).select("type", "source", "target", F.col("line").cast("bigint").alias("line"))


def dangling(spark, d):
    return graph.dangling(domain.calls(spark, d), _ids(spark, d)).select("source", "target").distinct()


def doc_coverage(spark, d):
    """Share of functions and classes that documentation describes, per label."""
    chunks = read(spark, d, "chunk").select(F.col("id").alias("chunk")).distinct()
    told = read(spark, d, "doc_edge").join(chunks, "chunk", "left_semi").select(F.col("target").alias("id")).distinct().withColumn("told", F.lit(1))
    rows = domain.nodes(spark, d, "label").where("label <> 'Module'").join(told, "id", "left")
    return rows.groupBy("label").agg(F.count("*").alias("elements"), F.sum(F.coalesce("told", F.lit(0))).cast("bigint").alias("documented"), F.round(F.sum(F.coalesce("told", F.lit(0))) / F.count("*"), 6).alias("coverage"))


def described_chunks(spark, d):
    """(chunk, targets): passages with at least one description of an existing element, targets in order."""
    ids, chunks = _ids(spark, d).withColumnRenamed("id", "target"), read(spark, d, "chunk").select(F.col("id").alias("chunk")).distinct()
    edges = read(spark, d, "doc_edge").distinct().join(ids, "target", "left_semi").join(chunks, "chunk", "left_semi")
    return edges.groupBy("chunk").agg(F.array_join(F.sort_array(F.collect_set("target")), ",").alias("targets"))


def neighbors(spark, d):
    return graph.neighbours(graph.anchored(domain.calls(spark, d), _ids(spark, d))).select("id", "direction", "other", F.col("place").cast("bigint").alias("place"))


def bfs_ball(spark, d):
    found = graph.ball(_seeds(spark, d), graph.both_ways(_real(spark, d)), "n", 3)
    return found.select("n", "id", F.col("hop").cast("bigint").alias("hop"))


def callers_callees(spark, d):
    """Elements that call, directly or through up to two others, what a report's list begins with."""
    steps = _real(spark, d).where("type = 'Calls'").select(F.col("target").alias("a"), F.col("source").alias("b"))
    return graph.ball(_seeds(spark, d), steps, "n", 3).select("n", "id", F.col("hop").cast("bigint").alias("hop"))


def induced_edges(spark, d):
    return graph.induced(_real(spark, d), graph.ball(_seeds(spark, d), graph.both_ways(_real(spark, d)), "n", 1), "n")


def hop_coverage(spark, d):
    """Of the elements a report's fixes touched, how many are within each number of steps of its list."""
    reached = graph.ball(_seeds(spark, d), graph.both_ways(_real(spark, d)), "n", 3).select("n", F.regexp_replace("id", "^[^:]*:", "").alias("key"), "hop")
    return domain.gold(spark, d).join(reached.groupBy("n", "key").agg(F.min("hop").alias("hop")), ["n", "key"]).groupBy("n", F.col("hop").cast("bigint").alias("hop")).agg(F.count("*").alias("reached"))


def _near(spark, d):
    return graph.shortest_near(_seeds(spark, d), _real(spark, d), search.hybrid(spark, d).select("n", "id"), "n", 4.0)


def bounded_sssp(spark, d):
    """Elements within a weight of 4 of a report's list, over containment and over edges to what the list has."""
    return _near(spark, d).select("n", "id", six("dist").alias("dist"))


def kg_rank(spark, d):
    """Elements near a report's list, by closeness, by the vector side of the list and by edit distance of their names to the name at its head."""
    near = _near(spark, d)
    names = domain.nodes(spark, d, "label", "name").where("label <> 'Module'").select("id", "name")
    head = search.hybrid(spark, d).where("rank = 1").select("n", "id").join(names.withColumnRenamed("name", "head"), "id").select("n", "head")
    vector = domain.cand(spark, d, "code").select("n", "id", "cos")
    rows = near.join(names, "id").join(head, "n").join(vector, ["n", "id"], "left").withColumn("cos", F.coalesce("cos", F.lit(0.0)))
    alike = 1 - F.levenshtein("name", "head") / F.greatest(F.length("name"), F.length("head"))
    scored = rows.select("n", "id", "dist", F.round(F.pow(F.lit(0.6), F.col("dist")) * (0.3 * (F.col("cos") + 1) / 2 + 0.7 * alike), 9).alias("score"))
    from evidar.operators.rank import ranked

    return ranked(scored, "n", [F.desc("score"), F.asc("dist"), F.asc("id")], 500).select("n", "id", six("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def doc_votes(spark, d):
    pool = search.doc_pool(spark, d).select("n", F.col("id").alias("chunk"), "score")
    edges = read(spark, d, "doc_edge").distinct()
    real = graph.unique_edges(graph.anchored(domain.calls(spark, d), _ids(spark, d)))
    return graph.votes(pool, edges, real, "n").select("n", "id", six("vote").alias("vote"))


def file_votes(spark, d):
    """Votes for files: 3 for an element of the list, 1 for one next to it."""
    ball = graph.ball(_seeds(spark, d), graph.both_ways(_real(spark, d)), "n", 1)
    files = domain.nodes(spark, d, "file").where("file is not null")
    return ball.join(files, "id").groupBy("n", "file").agg(F.sum(F.when(F.col("hop") == 0, 3).otherwise(1)).cast("bigint").alias("votes"))


def upsert_last_wins(spark, d):
    """Older versions of elements merged with the newest ones."""
    rows = read(spark, d, "node").where(F.col("label").isin(*domain.CODE)).select("id", "label", "name", "repo", "indexed_at")
    old = rows.groupBy("id").agg(F.min(F.struct("indexed_at", "label", "name", "repo")).alias("x")).select("id", "x.label", "x.name", "x.repo")
    new = graph.last_version(rows, ["id"], F.col("indexed_at")).select("id", "label", "name", "repo")
    return graph.upsert(old, new, ["id"])


def incremental_antijoin(spark, d):
    """Commits that no link names yet."""
    return graph.missing(domain.units(spark, d).select("h", "t"), domain.links(spark, d).select(F.col("u").alias("h")), ["h"])


def narrowest_interval(spark, d):
    """The innermost function or class that a call stands in, by file and line."""
    files = domain.nodes(spark, d, "file")
    points = domain.calls(spark, d).where("line is not null").join(files.withColumnRenamed("id", "source"), "source").select("file", "line").distinct()
    spans = domain.nodes(spark, d, "label", "file", "start_line", "end_line").where("label <> 'Module' and start_line is not null and end_line is not null and file is not null").select("id", "file", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    return diff.narrowest(points, spans).select("file", F.col("line").cast("bigint").alias("line"), "id")


def uncovered_lines(spark, d):
    """Calls that stand in no function or class of their file."""
    files = domain.nodes(spark, d, "file")
    points = domain.calls(spark, d).where("line is not null").join(files.withColumnRenamed("id", "source"), "source").where("file is not null").select("file", "line").distinct()
    spans = domain.nodes(spark, d, "label", "file", "start_line", "end_line").where("label <> 'Module' and start_line is not null and end_line is not null").select("id", "file", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    return points.join(diff.narrowest(points, spans).select("file", "line"), ["file", "line"], "left_anti").select("file", F.col("line").cast("bigint").alias("line"))


QUERIES = {
    f.__name__: f
    for f in (
        label_counts, edge_counts, edge_dedup, dangling, doc_coverage, described_chunks, neighbors, bfs_ball, callers_callees, induced_edges, hop_coverage, bounded_sssp, kg_rank, doc_votes, file_votes,
        upsert_last_wins, incremental_antijoin, narrowest_interval, uncovered_lines,
    )
}

_HYBRID = ("elements", "code", "hybrid", "ids", "edges", "real", "steps")
_SEEDS = "seeds AS (SELECT n, id FROM hybrid WHERE rank <= 10)"


def _ball(depth: int, steps: str = "steps") -> str:
    parts = [_SEEDS, "b0 AS (SELECT DISTINCT n, id, 0 AS hop FROM seeds)"]
    for i in range(1, depth + 1):
        parts.append(f"b{i} AS (SELECT n, id, min(hop) AS hop FROM (SELECT * FROM b{i - 1} UNION ALL SELECT DISTINCT x.n, s.b, {i} FROM b{i - 1} x JOIN {steps} s ON s.a = x.id) GROUP BY n, id)")
    return ",\n".join(parts) + f", ball AS (SELECT * FROM b{depth})"


def _near_sql(budget: float, rounds: int) -> str:
    parts = [
        _SEEDS, "defs AS (SELECT DISTINCT source AS a, target AS b FROM real WHERE type = 'Defines' UNION SELECT target, source FROM real WHERE type = 'Defines')",
        "open_ AS (SELECT DISTINCT h.n, r.source, r.target FROM real r JOIN hybrid h ON h.id = r.target WHERE r.type <> 'Defines')", "own AS (SELECT n, source AS a, target AS b FROM open_ UNION SELECT n, target, source FROM open_)",
        "d0 AS (SELECT DISTINCT n, id, 0.0::DOUBLE AS dist FROM seeds)",
    ]
    for i in range(1, rounds + 1):
        parts.append(f"""d{i} AS MATERIALIZED (SELECT n, id, min(dist) AS dist FROM (SELECT * FROM d{i - 1} UNION ALL SELECT x.n, s.b, x.dist + 0.25 FROM d{i - 1} x JOIN defs s ON s.a = x.id WHERE x.dist + 0.25 <= {budget}
            UNION ALL SELECT x.n, s.b, x.dist + 1.0 FROM d{i - 1} x JOIN own s ON s.a = x.id AND s.n = x.n WHERE x.dist + 1.0 <= {budget}) GROUP BY n, id)""")
    return ",\n".join(parts) + f", near AS (SELECT * FROM d{rounds})"


_POINTS = """points AS (SELECT DISTINCT n.file, c.line FROM call_edge c JOIN nodes n ON n.id = c.caller WHERE c.line IS NOT NULL AND n.file IS NOT NULL),
    spans AS (SELECT id, file, start_line, end_line FROM nodes WHERE label <> 'Module' AND start_line IS NOT NULL AND end_line IS NOT NULL),
    inside AS (SELECT p.file, p.line, s.id, row_number() OVER (PARTITION BY p.file, p.line ORDER BY end_line - start_line, s.id) AS rn FROM points p JOIN spans s ON s.file = p.file AND p.line BETWEEN s.start_line AND s.end_line)"""
SQL = {
    "label_counts": f"{sql('nodes')} SELECT label, count(*) AS nodes FROM nodes GROUP BY label",
    "edge_counts": f"{sql('ids', 'edges', 'real')} SELECT type, count(*) AS edges FROM real GROUP BY type",
    "edge_dedup": f"{sql('ids', 'edges', 'real')} SELECT type, source, target, CAST(line AS BIGINT) AS line FROM real",
    "dangling": f"{sql('ids')} SELECT DISTINCT caller AS source, callee AS target FROM call_edge WHERE caller NOT IN (SELECT id FROM ids) OR callee NOT IN (SELECT id FROM ids)",
    "doc_coverage": f"""{sql('nodes')}, told AS (SELECT DISTINCT target AS id FROM doc_edge WHERE chunk IN (SELECT id FROM chunk)) SELECT label, count(*) AS elements, count(told.id) AS documented, round(count(told.id) / count(*), 6) AS coverage
        FROM nodes LEFT JOIN told ON told.id = nodes.id WHERE label <> 'Module' GROUP BY label""",
    "described_chunks": f"{sql('ids')} SELECT chunk, string_agg(target, ',' ORDER BY target) AS targets FROM (SELECT DISTINCT chunk, target FROM doc_edge WHERE target IN (SELECT id FROM ids) AND chunk IN (SELECT id FROM chunk)) GROUP BY chunk",
    "neighbors": f"""{sql('ids')}, e AS (SELECT DISTINCT caller AS s, callee AS t FROM call_edge WHERE caller IN (SELECT id FROM ids) AND callee IN (SELECT id FROM ids)),
        b AS (SELECT s AS id, 'out' AS direction, t AS other FROM e UNION ALL SELECT t, 'in', s FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY id, direction ORDER BY other) AS place FROM b) SELECT * FROM k WHERE place <= 10""",
    "bfs_ball": f"{sql(*_HYBRID)}, {_ball(3)} SELECT n, id, CAST(hop AS BIGINT) AS hop FROM ball",
    "callers_callees": f"{sql(*_HYBRID)}, up AS (SELECT target AS a, source AS b FROM real WHERE type = 'Calls'), {_ball(3, 'up')} SELECT n, id, CAST(hop AS BIGINT) AS hop FROM ball",
    "induced_edges": f"{sql(*_HYBRID)}, {_ball(1)} SELECT x.n, r.type, r.source, r.target FROM real r JOIN ball x ON x.id = r.source JOIN ball y ON y.id = r.target AND y.n = x.n",
    "hop_coverage": f"{sql(*_HYBRID, 'gold')}, {_ball(3)} SELECT n, CAST(hop AS BIGINT) AS hop, count(*) AS reached FROM (SELECT n, regexp_replace(id, '^[^:]*:', '') AS key, min(hop) AS hop FROM ball GROUP BY ALL) JOIN gold USING (n, key) GROUP BY n, hop",
    "bounded_sssp": f"{sql(*_HYBRID)}, {_near_sql(4.0, 16)} SELECT n, id, round(dist + 1e-10, 6) AS dist FROM near",
    "kg_rank": f"""{sql('nodes', *_HYBRID)}, {_near_sql(4.0, 16)}, head AS (SELECT h.n, name AS head FROM hybrid h JOIN nodes USING (id) WHERE rank = 1),
        s AS (SELECT n, id, dist, round(pow(0.6, dist) * (0.3 * (coalesce(cos, 0) + 1) / 2 + 0.7 * (1 - levenshtein(name, head) / greatest(length(name), length(head)))), 9) AS score FROM near JOIN nodes USING (id) JOIN head USING (n) LEFT JOIN code USING (n, id) WHERE label <> 'Module'),
        k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, dist, id) AS rank FROM s) SELECT n, id, round(score + 1e-10, 6) AS score, rank FROM k WHERE rank <= 500""",
    "doc_votes": f"""{sql('ids', 'doc')}, {search._POOL}, e AS (SELECT DISTINCT caller AS s, callee AS t FROM call_edge WHERE caller IN (SELECT id FROM ids) AND callee IN (SELECT id FROM ids)),
        direct AS (SELECT n, target AS id, max(round(score + 1e-10, 6) * 0.8) AS vote FROM pool JOIN (SELECT DISTINCT chunk, target FROM doc_edge) x ON x.chunk = pool.id GROUP BY n, target),
        spread AS (SELECT n, t AS id, max(vote * 0.5) AS vote FROM direct JOIN e ON e.s = direct.id WHERE e.s IN (SELECT s FROM e GROUP BY s HAVING count(*) <= 20) GROUP BY n, t)
        SELECT n, id, round(round(max(vote), 9) + 1e-10, 6) AS vote FROM (SELECT * FROM direct UNION ALL SELECT * FROM spread) GROUP BY n, id""",
    "file_votes": f"{sql('nodes', *_HYBRID)}, {_ball(1)} SELECT n, file, CAST(sum(CASE WHEN hop = 0 THEN 3 ELSE 1 END) AS BIGINT) AS votes FROM ball JOIN nodes USING (id) WHERE file IS NOT NULL GROUP BY n, file",
    "upsert_last_wins": f"{sql('nodes')} SELECT id, label, name, repo FROM nodes",
    "incremental_antijoin": f"{sql('units')} SELECT h, t FROM units WHERE h NOT IN (SELECT u FROM link WHERE u IS NOT NULL)",
    "narrowest_interval": f"{sql('nodes')}, {_POINTS} SELECT file, CAST(line AS BIGINT) AS line, id FROM inside WHERE rn = 1",
    "uncovered_lines": f"{sql('nodes')}, {_POINTS} SELECT file, CAST(line AS BIGINT) AS line FROM points WHERE (file, line) NOT IN (SELECT (file, line) FROM inside)",
}
