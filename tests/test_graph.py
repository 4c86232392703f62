import random

from pyspark.sql import functions as F

from evidar.operators import community, graph, history, issues


def edges(spark, rows):
    return spark.createDataFrame(rows, "type string, source string, target string, line int")


def test_edges_are_unique_and_anchored(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    e = edges(spark, [("Calls", "a", "b", 5), ("Calls", "a", "b", 3), ("Calls", "a", "gone", 1), ("Calls", None, "b", 1), ("Calls", "b", "a", None)])
    assert sorted((r.source, r.target, r.line) for r in graph.unique_edges(graph.anchored(e, nodes)).collect()) == [("a", "b", 3), ("b", "a", None)]
    assert graph.dangling(e, nodes).count() == 2
    assert graph.unique_edges(e.where("false")).count() == 0


def test_upsert_keeps_old_values_where_new_are_null(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    new = spark.createDataFrame([("a", None, "z"), ("c", 3, None)], "id string, n int, s string")
    assert sorted(map(tuple, graph.upsert(old, new, ["id"]).collect())) == [("a", 1, "z"), ("b", 2, "y"), ("c", 3, None)]


def test_ball_and_paths_equal_brute_force(spark):
    r = random.Random(11)
    names = [f"v{i}" for i in range(30)]
    rows = [("Calls", r.choice(names), r.choice(names), 1) for _ in range(45)]
    seeds = spark.createDataFrame([(1, "v0"), (1, "v1"), (2, "v2")], "n int, id string")
    steps = graph.both_ways(edges(spark, rows))
    near: dict = {}
    for _, a, b, _ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for n, start in ((1, {"v0", "v1"}), (2, {"v2"})):
        front, hop = start, 0
        while front and hop <= 3:
            want |= {(n, v): hop for v in front if (n, v) not in want}
            front, hop = {w for v in front for w in near.get(v, ()) if (n, w) not in want}, hop + 1
    assert {(x.n, x.id): x.hop for x in graph.ball(seeds, steps, "n", 3).collect()} == want
    weighted = steps.withColumn("w", F.when(F.crc32(F.concat("a", "b")) % 2 == 0, 0.5).otherwise(1.0))
    w = {(x.a, x.b): x.w for x in weighted.collect()}
    dist = {(n, v): 0.0 for n, v in ((1, "v0"), (1, "v1"), (2, "v2"))}
    for _ in range(10):
        for (n, a), da in list(dist.items()):
            for (p, q), x in w.items():
                if p == a and da + x <= 2.0 and da + x < dist.get((n, q), 9):
                    dist[(n, q)] = da + x
    assert {(x.n, x.id): x.dist for x in graph.shortest(seeds, weighted, "n", 2.0).collect()} == dist


def test_votes_spill_but_not_from_hubs(spark):
    pool = spark.createDataFrame([(1, "k", 1.0)], "n int, chunk string, score double")
    told = spark.createDataFrame([("k", "a"), ("k", "hub")], "chunk string, target string")
    calls = edges(spark, [("Calls", "a", "b", 1)] + [("Calls", "hub", f"t{i}", 1) for i in range(21)])
    assert {r.id: r.vote for r in graph.votes(pool, told, calls, "n").collect()} == {"a": 0.8, "hub": 0.8, "b": 0.4}


def test_communities_find_cliques(spark):
    rows = [("Calls", f"{g}{i}", f"{g}{j}", 1) for g in "pqr" for i in range(5) for j in range(i)] + [("Calls", "p0", "q0", 1), ("Calls", "q1", "r0", 1)]
    e = edges(spark, rows)
    got = community.communities(e)
    groups: dict = {}
    for x in got.collect():
        groups.setdefault(x.community, set()).add(x.id[0])
    assert sorted(map(sorted, groups.values())) == [["p"], ["q"], ["r"]] and got.count() == 15
    assert community.modularity(e, got) > 0.5
    assert community.communities(e.where("false")).count() == 0


def test_bins_follow_their_first_commit(spark):
    day = 86400
    units = spark.createDataFrame([("r", d * day) for d in (0, 30, 60, 61, 100, 122, 300)] + [("s", 5), ("s", None)], "repo string, t bigint")
    got = sorted((r.repo, r.t // day, r.start // day) for r in history.time_bins(units, "repo").collect())
    assert got == [("r", 0, 0), ("r", 30, 0), ("r", 60, 0), ("r", 61, 61), ("r", 100, 61), ("r", 122, 122), ("r", 300, 300), ("s", 0, 0)]


def test_report_links(spark):
    units = spark.createDataFrame([("a", "Fixes #20"), ("b", "Merge pull request #30 from x"), ("c", None)], "h string, msg string")
    reports = spark.createDataFrame([(20, False, "t", None), (30, True, "t", "closes #21"), (21, False, "t", "")], "n int, pr boolean, title string, body string")
    links = issues.closing_links(units, reports)
    assert sorted((r.n, r.h) for r in links.collect()) == [(20, "a"), (21, "b")]
    assert sorted((r.h, r.n, r.own) for r in issues.commit_reports(units, reports, links).collect()) == [("a", 20, 0), ("b", 21, 0), ("b", 30, 1)]


def test_recency_of_fixes(spark):
    units = spark.createDataFrame([("a", 0, "start", ["x"]), ("b", 100, "fix it", ["x", "x"]), ("c", 50, "a bug", None)], "h string, t bigint, msg string, touch array<string>")
    assert {r.key: round(r.fix, 6) for r in history.fix_recency(units).collect()} == {"x": 0.5}
