"""Bounded lists that are made cell by cell, against the same made of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from evidar.operators import blocks, history, issues, rank


@pytest.fixture(scope="module")
def reports(spark):
    r = random.Random(8)
    rows = [(n, " ".join(r.choice("abcdefghijklmno") * (1 + r.randrange(2)) for _ in range(r.randrange(1, 9))), None if n == 7 else r.randrange(10)) for n in range(60)]
    return spark.createDataFrame(rows, "n int, text string, created bigint").cache()


def all_pairs(reports, queries):
    return issues.similar_reports(queries, reports, "n").where("sim > 0").cache()


def listed(df, *names):
    return sorted(tuple(r[c] for c in names) for r in df.collect())


def test_most_similar_of_those_that_fixed_something(spark, reports, monkeypatch):
    queries, among = reports.where("n % 3 = 0"), reports.where("n % 2 = 0").select(F.col("n").alias("doc"))
    want = listed(rank.ranked(all_pairs(reports, queries).join(among, "doc", "left_semi"), "n", [F.desc("sim"), F.asc("doc")], 4), "n", "doc", "sim", "rank")
    monkeypatch.setattr(issues, "similar_reports", None)  # no list of all pairs is made
    monkeypatch.setattr(blocks, "PIECE", 3)
    assert listed(issues.most_similar(queries, reports, "n", 4, among=among), "n", "doc", "sim", "rank") == want


@pytest.mark.parametrize(("cell", "hot"), [(1_000_000, 1_000), (40, 1_000), (40, 2)])
def test_elements_by_similar_reports_without_all_pairs(spark, reports, monkeypatch, cell, hot):
    queries = reports.where("n % 3 = 0")
    fixed = spark.createDataFrame([(n, f"k{(n * m) % 11}") for n in range(0, 60, 2) for m in (1, 3)], "n int, key string").distinct()
    elements = fixed.select("key").distinct().where("key <> 'k5'")
    want = listed(issues.simi_score(all_pairs(reports, queries), fixed, elements, "n", "doc", 5), "n", "key", "score", "rank")
    gathered = blocks.gathered
    monkeypatch.setattr(issues, "similar_reports", None)
    monkeypatch.setattr(blocks, "gathered", lambda *a, **k: gathered(*a, **k, cell=cell, hot=hot))
    got = listed(issues.simi_rank(queries, reports, fixed, elements, "n", depth=5), "n", "key", "score", "rank")
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_floors_hold_for_a_query_key_of_any_name(spark):
    r = random.Random(5)
    rows = [(d, f"t{r.randrange(25)}", float(r.randrange(1, 5))) for d in range(120) for _ in range(10)]
    asked = [(n, f"t{r.randrange(25)}", 1.0) for n in range(5) for _ in range(6)]
    a, b = spark.createDataFrame(asked, "n int, term string, w double"), spark.createDataFrame(rows, "d int, term string, w double")
    want = {n: {} for n in range(5)}
    for n, t, x in asked:
        for d, u, y in rows:
            if t == u:
                want[n][d] = want[n].get(d, 0.0) + x * y
    want = sorted((n, d) for n, own in want.items() for d in sorted(own, key=lambda d: (-round(own[d], 9), d))[:4])
    assert listed(blocks.products(a, b, "n", "d", 4, cell=30), "n", "d") == want  # over FIRST cells


def test_words_of_a_document_that_comes_twice_count_once_more(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PIECE", 2)
    docs = spark.createDataFrame([("b", "red fish"), ("a", "red fish blue fish"), ("b", "two fish"), ("c", None), ("d", "two"), ("e", "old hat"), ("f", "new hat")], "id string, text string")
    once = docs.groupBy("id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("text"))).alias("text"))
    queries = spark.createDataFrame([(1, "two red fish")], "n int, text string")
    got = rank.bm25(queries, docs, "n", "id", depth=3).collect()
    assert [r.id for r in sorted((r for r in got if r.n == 1), key=lambda r: r.rank)] == ["b", "a", "d"]
    assert {r.id for r in rank.bm25(queries, once, "n", "id", depth=3).where("n = 1").collect()} == {"a", "b", "d"}


def test_most_similar_of_those_written_before(spark, reports, monkeypatch):
    queries = reports.where("n % 3 = 1")
    safe = issues.known_before(all_pairs(reports, queries), queries, reports, "n", margin=2)
    want = listed(rank.ranked(safe, "n", [F.desc("sim"), F.asc("doc")], 4), "n", "doc", "sim", "rank")
    monkeypatch.setattr(issues, "similar_reports", None)
    assert listed(issues.most_similar(queries, reports, "n", 4, margin=2), "n", "doc", "sim", "rank") == want and want


def test_elements_by_commits_have_the_places_of_the_whole_list(spark):
    r = random.Random(4)
    units = [(f"h{i:02}", r.randrange(6), " ".join(r.choice("abcdefg") for _ in range(r.randrange(1, 6))), sorted({f"k{int(r.random() ** 2 * 14)}" for _ in range(3)})) for i in range(50)]
    fit = spark.createDataFrame(units, "h string, t bigint, msg string, touch array<string>")
    asked = spark.createDataFrame([(n, " ".join(r.choice("abcdefg") for _ in range(4))) for n in range(5)], "n int, text string")
    near = spark.createDataFrame([(n, f"k{(n + m) % 14}", m + 1) for n in range(5) for m in range(2)], "n int, key string, rank int")
    elements = fit.select(F.explode("touch").alias("key")).distinct()
    cos, t, touch = {(x.n, x.h): x.cos for x in history.message_scores(asked, fit, "n").collect()}, {u[0]: u[1] for u in units}, {u[0]: u[3] for u in units}
    listed_ = {(x.n, x.key): x.rank for x in near.collect()}
    want = []
    for n in range(5):
        text = sorted((h for m, h in cos if m == n), key=lambda h: (-cos[n, h], -t[h], h))
        best = {h: min(listed_[n, k] for k in touch[h] if (n, k) in listed_) for h in touch if any((n, k) in listed_ for k in touch[h])}
        code = sorted(best, key=lambda h: (best[h], -t[h], h))
        s = {h: (1 / (61 + text.index(h)) if h in text else 0) + (1 / (61 + code.index(h)) if h in code else 0) for h in {*text, *code}}
        score = {}
        for h, x in s.items():
            for k in touch[h]:
                score[k] = max(score.get(k, 0), round(x, 9))
        want += [(n, k) for k in sorted(score, key=lambda k: (-score[k], k))[:6]]
    assert listed(history.message_rank(asked, fit, near, elements, "n", 6), "n", "key") == sorted(want)
    some = history.commit_scores(asked, fit, near, "n", 6, elements, far=0)  # every element's best where the list goes deep
    assert {(x.n, x.h) for x in some.where("best is not null").collect()} == {(n, h) for n in range(5) for h in touch if any((n, k) in listed_ for k in touch[h])}


@pytest.mark.parametrize("keyed", [False, True])
def test_cells_send_on_little_more_than_what_leads_the_list(spark, monkeypatch, keyed):
    r = random.Random(3)
    rows = [(d, f"t{t}", float(r.randrange(1, 50))) for d in range(400) for t in r.sample(range(12), 5)]
    asked = [(n, f"t{t}", 1.0) for n in range(4) for t in r.sample(range(12), 4)]
    belongs = [(d, d // 2 if keyed else d) for d in range(400)]
    dot = {}
    for n, t, x in asked:
        for d, u, y in rows:
            if t == u:
                dot[n, d] = dot.get((n, d), 0.0) + x * y
    want = set()
    for n in range(4):
        seen = {}
        for d in sorted((d for m, d in dot if m == n), key=lambda d: (-dot[n, d], d)):
            seen.setdefault(belongs[d][1], d)
        want |= {(n, d) for d in list(seen.values())[:40]}
    named = {(n, d) for n in range(4) for d in range(n, 400, 9) if (n, d) in dot}
    a, b = blocks.packed(spark.createDataFrame(asked, "n int, term string, w double"), "n"), blocks.packed(spark.createDataFrame(rows, "d bigint, term string, w double"), "d")
    own = spark.createDataFrame(belongs, "d bigint, key bigint") if keyed else None
    monkeypatch.setattr(blocks, "SLICE", 2)
    got = blocks.leading(a, b, spark.createDataFrame(sorted(named), "n int, d bigint"), "n", "d", 40, own, cell=250).collect()
    assert {(x.n, x.d): x.score for x in got}.items() <= dot.items() and want | named <= {(x.n, x.d) for x in got}
    assert len(got) - len(named) < 4 * 250  # eight cells have 8 * 40 among their first 40
    given = spark.createDataFrame([(n, d, dot[n, d]) for n, d in sorted(named)], "n int, d bigint, score double")
    places = blocks.places(a, b, given, "n", "d", cell=250).collect()
    assert {(x.n, x.d): x["rank"] for x in places} == {(n, d): 1 + sum((-s, e) < (-dot[n, d], d) for (m, e), s in dot.items() if m == n) for n, d in named}


def test_greatest_of_the_rows_of_a_key_however_cells_are_cut(spark):
    r = random.Random(6)
    rows = [(f"r{d}", f"t{r.randrange(12)}", r.random()) for d in range(40) for _ in range(4)]
    asked = [(n, f"t{r.randrange(12)}", 1.0) for n in range(4) for _ in range(4)]
    belongs = sorted({(f"r{d}", f"k{int(r.random() ** 2 * 15)}") for d in range(40) for _ in range(3)})
    plus = {f"k{i}": i / 50 for i in range(15)}
    dot, best = {}, {}
    for n, t, x in asked:
        for d, u, y in rows:
            if t == u:
                dot[n, d] = dot.get((n, d), 0.0) + x * y
    for (n, d), s in dot.items():
        for e, k in belongs:
            if e == d:
                best[n, k] = max(best.get((n, k), 0.0), s + plus[k])
    want = sorted((n, k) for n in range(4) for k in sorted((k for m, k in best if m == n), key=lambda k: (-round(best[n, k], 9), k))[:5])
    a, b = spark.createDataFrame(asked, "n int, term string, w double"), spark.createDataFrame(rows, "r string, term string, w double")
    own = spark.createDataFrame([(d, k, 1.0, plus[k]) for d, k in belongs], "r string, key string, size double, plus double")
    for cell, hot in ((10_000, 1_000), (20, 1_000), (60, 3)):
        assert listed(blocks.gathered(a, b, own, "n", "r", "key", "max", 5, cell=cell, hot=hot), "n", "key") == want


def test_hunks_and_elements_go_through_the_cells_as_numbers(spark, monkeypatch):
    kinds, gathered = [], blocks.gathered
    monkeypatch.setattr(blocks, "gathered", lambda a, rows, own, *x, **k: kinds.append((dict(rows.dtypes)["o"], dict(own.dtypes)["e"])) or gathered(a, rows, own, *x, **k))
    hunks = spark.createDataFrame([("b", ["k2", "k1"], "red fish"), ("a", ["k3"], "blue fish"), ("c", ["gone"], "red")], "hunk string, ids array<string>, text string")
    units = spark.createDataFrame([("u", 5, "fix", ["k4", "gone"])], "h string, t bigint, msg string, touch array<string>")
    elements, names = spark.createDataFrame([(f"k{i}",) for i in range(1, 6)], "key string"), spark.createDataFrame([("none",)], "term string")
    none = lambda t: F.array().cast("array<string>")
    got = history.locus(spark.createDataFrame([(1, "red")], "n int, text string"), hunks, units, names, elements, "n", lambda t: F.split(t, " "), none, 3)
    assert got.columns == ["n", "key", "score", "rank"] and [(x.key, x["rank"]) for x in got.orderBy("rank").collect()] == [("k1", 1), ("k2", 2), ("k4", 3)]
    assert kinds == [("bigint", "bigint")]


def test_rows_are_not_looked_up_one_by_one_where_adding_up_all_is_faster(monkeypatch):
    r = random.Random(2)
    rows = sorted((d, t, float(r.randrange(1, 9))) for d in range(300) for t in r.sample(range(40), 8))
    post = [(d, [t for e, t, _ in rows if e == d], [w for e, _, w in rows if e == d]) for d in range(300)]
    table = blocks.pa.table({"r": blocks.pa.array([p[0] for p in post]), "h": blocks.pa.array([p[1] for p in post]), "w": blocks.pa.array([p[2] for p in post]), "x": blocks.pa.nulls(300, blocks.pa.float64())})
    cell = blocks._cell([table])
    terms, weights = blocks.np.arange(0, 40, 2), blocks.np.ones(20)
    row, s = cell.scores(terms, weights, 0.0)
    want = {int(d): x for d, x in zip(row, s) if x >= 25}
    monkeypatch.setattr(blocks.np, "searchsorted", None)
    row, s = cell.scores(terms, weights, 25.0)
    assert want and {int(d): x for d, x in zip(row, s) if x >= 25} == want


def test_python_is_started_before_the_executors_have_grown(spark, monkeypatch):
    done, ready, stored = [], blocks.ready, history.stored
    monkeypatch.setattr(blocks, "ready", lambda session: done.append("ready") or ready(session))
    monkeypatch.setattr(history, "stored", lambda df: done.append("stored") or stored(df))
    fit = spark.createDataFrame([("a", 1, "red fish", ["k"]), ("b", 2, "blue", ["k", "m"])], "h string, t bigint, msg string, touch array<string>")
    near = spark.createDataFrame([(1, "m", 1)], "n int, key string, rank int")
    got = history.message_rank(spark.createDataFrame([(1, "red")], "n int, text string"), fit, near, fit.select(F.explode("touch").alias("key")).distinct(), "n", 5)
    assert [x.key for x in got.orderBy("rank").collect()] == ["k", "m"] and done[:2] == ["ready", "stored"]


def test_cells_of_commits_leave_no_core_idle_in_the_last_round(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [blocks._rounds(spark.range(1), n) for n in (1, cores, cores + 1, 2 * cores + 1)] == [1, cores, 2 * cores, 3 * cores]
