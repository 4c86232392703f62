"""Term rules and rankings from the history against values worked out by hand."""

from math import hypot, log, sqrt

import pytest
from pyspark.sql import functions as F

from evidar.functions import terms, text
from evidar.operators import history, index, issues

UNIT = "h string, p string, t bigint, merge boolean, msg string, touch array<string>, touch_mod array<string>"


def unit(h, t, msg, touch):
    return (h, "p", t, False, msg, touch, [])


def keys(spark, *names):
    return spark.createDataFrame([(k,) for k in names], "key string")


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()[0]


def test_words_and_code(spark):
    stop = terms.stop_words(spark)
    assert one(spark, "The getUser_running is return", lambda c: terms.nl_terms(c, stop)) == ["user", "run"]
    assert one(spark, "The getUser_running is return", lambda c: terms.issue_terms(c, stop)) == ["user", "run", "return"]
    assert len(stop) == 318 and one(spark, "", lambda c: terms.nl_terms(c, stop)) == [] and one(spark, None, lambda c: terms.nl_terms(c, stop)) is None
    assert one(spark, "Call `QuerySet.filter` and get_user(x) from Model.save and Count plainword", terms.code_terms) == ["QuerySet.filter", "QuerySet", "filter", "get_user", "Model.save", "Model", "save"]
    assert one(spark, "`a b.c` runIt() plain() déjà_vu", terms.code_terms) == ["a", "b.c", "b", "c", "runIt", "plain", "déjà_vu"]


def test_weights_by_hand(spark):
    post = index.postings(spark.createDataFrame([(0, "alpha beta beta"), (1, "alpha gamma"), (2, "delta")], "d int, text string"), ["d"], F.col("text"))
    w = {(r.d, r.term): r.w for r in index.tfidf(post, index.frequencies(post), ["d"], 3).collect()}
    a, b = log(1.5), (log(2) + 1) * log(3)
    assert w[0, "alpha"] == pytest.approx(a / hypot(a, b)) and w[0, "beta"] == pytest.approx(b / hypot(a, b)) and w[2, "delta"] == 1.0


def located(spark, query, at, units, hunks, names, elements):
    stop = terms.stop_words(spark)
    units = spark.createDataFrame(units, UNIT)
    docs = history.hunk_documents(spark.createDataFrame(hunks, "u string, f string, k int, ids array<string>, text string"), units)
    got = history.locus(spark.createDataFrame([(1, query)], "n int, text string"), docs, units, spark.createDataFrame([(x,) for x in names], "term string"), keys(spark, *elements), "n", lambda c: terms.nl_terms(c, stop), terms.code_terms, at=at)
    return [(r.key, r.score) for r in got.orderBy("rank").collect()]


UNITS = [unit("u0", 0, "init", []), unit("u1", 100, "fix", ["m.py:f"]), unit("u2", 200, "omega", ["m.py:g"])]
HUNKS = [("u1", "m.py", 0, ["m.py:f"], "@@ -1 +1 @@\n-zeta\n+kappa_fn()"), ("u2", "m.py", 0, ["m.py:g"], "@@ -1 +1 @@\n-iota\n+theta")]


def test_hunks_words_names_and_fixes(spark):
    names = ["kappa_fn", "f", "g"]
    got = located(spark, "`kappa_fn`", 100, UNITS, HUNKS, names, ["m.py:f", "m.py:g"])
    assert [k for k, _ in got] == ["m.py:f"] and got[0][1] == pytest.approx(1 / sqrt(2) + 1 + 0.05, abs=1e-8)
    got = located(spark, "theta", 100, UNITS, HUNKS, names, ["m.py:f", "m.py:g"])
    assert [k for k, _ in got] == ["m.py:g", "m.py:f"] and got[0][1] == pytest.approx(1 / sqrt(3), abs=1e-8) and got[1][1] == pytest.approx(0.05, abs=1e-8)
    assert located(spark, "theta", 300, UNITS[2:], HUNKS[1:], [], ["m.py:f"]) == []


def test_messages_are_read_to_their_limit(spark):
    hunks = [("u9", "m.py", 0, ["m.py:g"], "@@ -1 +1 @@\n-iota\n+theta"), ("u8", "m.py", 0, ["m.py:h"], "@@ -1 +1 @@\n-kappa\n+lambda")]
    for words, want in (("omega " + "x" * 1995 + " zeta", []), ("omega zeta", ["m.py:g"])):
        units = [unit("u9", 0, words, ["m.py:g"]), unit("u8", 0, "omega", ["m.py:h"])]
        assert [k for k, _ in located(spark, "zeta", 1, units, hunks, [], ["m.py:g", "m.py:h"])] == want


def pool(spark, query, linked=None):
    many = [f"m.py:x{i}" for i in range(51)]
    units = spark.createDataFrame([unit("c1", 300, "kappa crash", ["m.py:f"]), unit("c2", 200, "theta", ["m.py:g"]), unit("c3", 100, "kappa", ["m.py:h"]), unit("c4", 50, "kappa big", many), unit("c5", 40, "kappa outside", ["other.py:z"])], UNIT)
    if linked:
        reports = spark.createDataFrame([(7, False, "crash failure", "steps")], "n int, pr boolean, title string, body string")
        units = units.join(history.linked_texts(units, reports, spark.createDataFrame(linked, "h string, n bigint, own int")), "h")
    elements, listed = keys(spark, "m.py:f", "m.py:g", "m.py:h", *many), spark.createDataFrame([(1, "m.py:g", 1), (1, "m.py:f", 2)], "n int, key string, rank int")
    asked = spark.createDataFrame([(1, query)], "n int, text string")
    return [x.collect() for x in (history.message_pool(asked, units, listed, elements, "n").orderBy("rank"), history.message_rank(asked, units, listed, elements, "n").orderBy("rank"))]


def test_commits_by_text_and_by_list(spark):
    best, ranked = pool(spark, "kappa")
    assert [r.h for r in best] == ["c1", "c2", "c3"] and best[0].s == pytest.approx(2 / 62, abs=1e-8) and best[0].cos == pytest.approx(log(1.5) / hypot(log(1.5), log(3)), abs=1e-8)
    assert [r.best for r in best] == [2, 1, None]
    assert [(r.key, round(r.score, 6)) for r in ranked] == [("m.py:f", round(2 / 62, 6)), ("m.py:g", round(1 / 61, 6)), ("m.py:h", round(1 / 61, 6))]


def test_linked_reports_count_as_text(spark):
    plain = {r.h: r.cos for r in pool(spark, "crash")[0]}
    told = {r.h: r.cos for r in pool(spark, "crash", [("c2", 7, 0)])[0]}
    assert plain["c2"] == 0.0 and told["c2"] > 0.0


def test_evidence_hunks_follow_the_pool(spark):
    rows = spark.createDataFrame([(1, "c1", 300, 0.5), (1, "c2", 200, 0.4)], "n int, h string, t bigint, s double")
    hunks = spark.createDataFrame([("c2", "a", 0, "x"), ("c1", "b", 1, "y"), ("c1", "b", 0, "z")], "u string, f string, k int, text string")
    assert [(r.u, r.k) for r in history.pool_hunks(rows, hunks, "n", 2).orderBy("rank").collect()] == [("c1", 0), ("c1", 1)]


def test_names_of_a_graph(spark):
    nodes = spark.createDataFrame([("Module", "src/flask/helpers.py", "src/flask/helpers.py"), ("Module", "pkg/__init__.py", "pkg/__init__.py"), ("Function", "send_file", "x.py"), ("Module", "a.js", "a.js")], "label string, name string, file string")
    assert {r.term for r in history.graph_names(nodes).collect()} == {"flask.helpers", "pkg", "send_file"}


def test_closing_words_of_the_own_repository(spark):
    units = spark.createDataFrame([
        ("a", "Merge pull request #100 from x/y"), ("b", "Add thing (#101)"), ("c", "Fixes #22, resolved pallets/flask#23 and close https://github.com/pallets/flask/issues/24"),
        ("d", "fixed #25 but also other/repo#5 and https://github.com/other/repo/issues/6"), ("e", "Mention #26 without keyword"),
    ], "h string, msg string")
    reports = spark.createDataFrame([(100, True, "PR merge", "This fixes #20 and refs #99"), (101, True, "PR squash", "Closes: #21")], "n int, pr boolean, title string, body string")
    assert sorted(map(tuple, issues.closing_links(units, reports, "pallets/flask").collect())) == [(20, "a"), (21, "b"), (22, "c"), (23, "c"), (24, "c"), (25, "d")]
    for address, want in (("https://github.com/pallets/flask", "pallets/flask"), ("git@github.com:pallets/flask.git", "pallets/flask"), ("https://gitlab.com/a/b", None), (None, None)):
        assert one(spark, address, text.slug) == want


def test_similar_reports_by_hand_and_in_time(spark):
    reports = spark.createDataFrame([(1, "kappa crash", 100), (2, "theta", 200), (3, "kappa", 300), (4, "crash theta", 1_000_000)], "n int, text string, created bigint")
    queries = spark.createDataFrame([(9, "crash", 900_000)], "n int, text string, created bigint")
    fixed = spark.createDataFrame([(1, "m.py:f"), (1, "m.py:g"), (2, "m.py:g"), (4, "m.py:g")], "n int, key string")
    stop = terms.stop_words(spark)
    near = issues.similar_reports(queries, reports, "n", lambda c: terms.issue_terms(c, stop)).cache()
    got = {r.key: r.score for r in issues.simi_score(near, fixed, keys(spark, "m.py:f", "m.py:g"), "n", "doc").collect()}
    s = 1 / sqrt(2)
    assert got == {"m.py:g": pytest.approx(s / 2 + s, abs=1e-8), "m.py:f": pytest.approx(s / 2, abs=1e-8)}
    assert [r.doc for r in issues.known_before(near, queries, reports, "n").collect()] == [1]


def test_commits_before_a_snapshot(spark):
    units = spark.createDataFrame([unit("a", 1, "", []), unit("b", 2, "", [])], UNIT)
    known = spark.createDataFrame([("s", "a"), ("o", "b")], "snapshot string, h string")
    assert [r.h for r in history.before(units, known, "s").collect()] == ["a"]
