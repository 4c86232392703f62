"""Block products, vectors, measures and search by names against brute force and values worked out by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidar.functions.text import query_text
from evidar.operators import blocks, docs, measure, rank, search, vectors


@pytest.mark.parametrize("depth", [None, 5])
def test_products_equal_brute_force_in_any_blocks(spark, depth):
    r = random.Random(3)
    rows = [(f"d{i}", f"t{int(r.random() ** 2 * 30)}", r.choice((0.0, 0.5, r.random()))) for i in range(150) for _ in range(12)]
    asked = [(q, f"t{r.randrange(40)}", float(r.randrange(1, 4))) for q in range(7) for _ in range(9)]
    a, b = spark.createDataFrame(asked, "q int, term string, w double"), spark.createDataFrame(rows, "d string, term string, w double")
    want = {}
    for q, t, x in asked:
        for d, u, y in rows:
            if t == u:
                want[q, d] = want.get((q, d), 0.0) + x * y
    want = {k: round(v, 9) for k, v in want.items() if round(v, 9) > 0}
    if depth:
        want = {(q, d): want[q, d] for q in range(7) for d in sorted((d for p, d in want if p == q), key=lambda d: (-want[q, d], d))[:depth]}
    for cell, group in ((10_000, 10_000), (60, 20)):  # the second has over FIRST cells, so floors are used
        got = {(x.q, x.d): round(x.score, 9) for x in blocks.products(a, b, "q", "d", depth, cell=cell, group=group).collect()}
        assert got == pytest.approx(want)
    assert blocks.products(a, b.where("false"), "q", "d", depth).count() == 0 and blocks.products(a.where("false"), b, "q", "d", depth).count() == 0


def test_rare_terms_decide_under_a_floor():
    import pyarrow as pa

    terms, rows = pa.array(["rare", "often"]), [("a", "often", 0.1), ("b", "often", 0.2), ("b", "rare", 3.0), ("c", "rare", 2.0)]
    cell = blocks.Cell(terms, pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows]), np.array([x[2] for x in rows]))
    row, score = cell.scores(np.array([0, 1]), np.array([1.0, 1.0]), 1.0)
    assert {cell.keys[int(i)].as_py(): round(float(s), 9) for i, s in zip(row, score)} == {"b": 3.2, "c": 2.0}


def test_inverted_file_recall_copies_and_gaps(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = np.vstack([centres[rng.integers(12)] + 0.4 * rng.normal(size=16) for _ in range(900)] + [np.tile(centres[0], (450, 1))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "id int, v array<float>")
    exact = rank.cosine(df, "id", "v", F.col("id") % 20 == 0, depth=10)
    centre = vectors.fit(df, "id", "v")
    found = vectors.search(df, "id", "v", F.col("id") % 20 == 0, centre, depth=10).cache()
    assert vectors.recall(found, exact) >= 0.9 and found.where("query = id").count() == 0 and len(centre) == 36
    assert vectors.search(df.where("false"), "id", "v", F.lit(True), centre).count() == 0 and vectors.fit(df.where("id = 5000"), "id", "v").shape == (1, 1)


def test_texts_are_encoded_once(spark):
    seen = []

    def encode(texts):
        seen.extend(texts)
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([("a", "xx"), ("b", "xx"), ("c", "yyy"), ("d", None)], "id string, text string")
    first = vectors.encoded(rows, "id", "text", encode, model="m").cache()
    assert {r.id: r.v[0] for r in first.collect()} == {"a": 2.0, "b": 2.0, "c": 3.0}
    fresh = vectors.encoded(rows.where("id <> 'd'"), "id", "text", lambda t: 1 / 0, cache=first.select("digest", "v").distinct(), model="m")
    assert fresh.count() == 3
    nodes = spark.createDataFrame([("a", "Function"), ("z", "Class"), ("m", "Module")], "id string, label string")
    assert [r.id for r in vectors.without_vector(nodes, first).collect()] == ["z"]


def test_passages_weigh_words_by_both_corpora(spark):
    code = spark.createDataFrame([("m.py:alpha", "def alpha return beta"), ("m.py:beta", "def beta return 1")], "id string, text string")
    chunks = spark.createDataFrame([("k0", "Usage Call alpha to start."), ("k1", "Other Unrelated words here.")], "id string, text string")
    asked, told = spark.createDataFrame([(1, "alpha")], "n int, text string"), spark.createDataFrame([("k0",)], "chunk string")
    near = spark.createDataFrame([(1, "k0", 1.0), (1, "k1", 0.0)], "n int, id string, cos double")
    one = search.passages(asked, code, chunks, told, near).collect()
    assert [r.id for r in one] == ["k0"] and one[0].score == pytest.approx(2 / 60, abs=1e-8)
    both = search.passages(asked, code, chunks, told.where("false"), near).orderBy("rank").collect()
    assert [(r.id, round(r.score, 6)) for r in both] == [("k0", round(2 / 60, 6)), ("k1", round(2 / 61, 6))]


def test_seeds_neighbourhoods_and_views(spark):
    nodes = spark.createDataFrame([("f", "Function", "app", "src/app.py", "a"), ("c", "Class", "Big", "src/app.py", "b"), ("m", "Module", "src/app.py", "src/app.py", "c"), ("o", "Module", "x.js", "x.js", "d")], "id string, label string, name string, file string, source string")
    names = spark.createDataFrame([(1, "app"), (1, "Big"), (2, "x.js"), (3, "none")], "n int, name string")
    got = [(r.n, r.id) for r in search.name_seeds(names, nodes).orderBy("n", "place").collect()]
    assert got == [(1, "f"), (1, "c"), (1, "m"), (2, "o")]
    words = spark.createDataFrame([(1, "f"), (1, "o")], "n int, id string")
    seeds = search.seeds(search.name_seeds(names, nodes), words)
    assert {(r.n, r.id, r.by_name) for r in seeds.where("n = 1").collect()} == {(1, "f", True), (1, "c", True), (1, "m", True), (1, "o", False)}
    edges = spark.createDataFrame([("Calls", "f", "c"), ("Imports", "o", "m")], "type string, source string, target string")
    from evidar.operators import graph

    own = spark.createDataFrame([(1, "f")], "n int, id string")
    near = search.neighbourhood(own, graph.both_ways(edges), depth=9)
    assert [(r.id, r.hop) for r in near.orderBy("place").collect()] == [("f", 0), ("c", 1)]
    assert search.graph_context(near, own, edges, nodes).first().text == "# src/app.py Function app\na\n\n# src/app.py Class Big\nb"
    assert [(r.file, r.votes) for r in search.voted_files(near, own, nodes).collect()] == [("src/app.py", 4)]
    assert [r.file for r in search.matching_files(nodes, "X.").collect()] == ["x.js"]
    shown, kept = search.visible(nodes, edges, ["Function", "Module"], ["Calls", "Imports"])
    assert shown.count() == 3 and [r.type for r in kept.collect()] == ["Imports"]
    told = search.mentions(spark.createDataFrame([(1, "run app, not Bigger but a.b.c")], "n int, text string"), spark.createDataFrame([("app",), ("Big",), ("b.c",), ("a.b",)], "name string"))
    assert {r.name for r in told.collect()} == {"app", "b.c", "a.b"}
    assert spark.range(1).select(search.plain_query(F.lit('a+b "c"  (d)'))).first()[0] == "a b c d"
    assert [r[0] for r in nodes.select(search.embed_text(nodes)).collect()] == ["a", "b", "c", "d"] and spark.range(1).select(query_text(F.lit("x"))).first()[0] == "x"


def test_neighbours_by_list_then_id(spark):
    from evidar.operators import graph

    edges = spark.createDataFrame([("x", "a"), ("y", "a"), ("z", "a"), ("a", "q"), ("x", "a")], "source string, target string")
    listed = spark.createDataFrame([(1, "z", 1), (1, "a", 2)], "n int, id string, rank int")
    got = graph.ranked_neighbours(listed.where("id = 'a'").select("n", "id"), edges, listed, "n", 2).orderBy("direction", "place").collect()
    assert [(r.direction, r.other, r.total) for r in got] == [("in", "z", 3), ("in", "x", 3), ("out", "q", 1)]


def test_measures_of_evidence(spark):
    rows = [(1, "doc", 1, 1, 10, 2, 2, ["why"]), (1, "doc", 2, 0, 20, 3, 1, ["code_location"]), (2, "issue", 1, 0, 5, 0, 0, ["no_new_information"]), (3, "issue", 1, 1, 7, 2, 3, ["why", "how"])]
    j = spark.createDataFrame(rows, "n int, kind string, pos int, useful int, tokens int, usefulness int, relevance int, info_types array<string>")
    k = measure.kept_evidence(j, (F.col("pos") == 1) & (F.col("n") < 3)).first()
    assert (k.precision, k.recall, k.f1) == (0.5, 0.5, 0.5) and k.t11u == round((2 - 1 + 0) / 3, 6) and (k.empty_has, k.empty_none, k.shown_has, k.shown_none) == (1, 0, 1, 1) and k.mean_tokens == 5.0
    assert {(r.kind, r.type): r.share for r in measure.type_shares(j).collect()}["issue", "why"] == 0.5
    assert [(r.pos, r.useful) for r in measure.quality_by_position(j).orderBy("pos").collect()] == [(1, round(2 / 3, 6)), (2, 0.0)]
    a = {r.kind: r for r in measure.audit(j).collect()}
    assert a["doc"].over == 1 and a["doc"].place_only == 1 and a["issue"].known_irrelevant == 1 and a[None].items == 4 and a["doc"].three_of_two == 1
    assert tuple(measure.complement(j, "doc", "issue").first()) == (3, 1, 1, 0, 1)
    pair = spark.createDataFrame([(["a"], ["a", "b"]), ([], [])], "x array<string>, y array<string>")
    assert tuple(measure.mean_jaccard(pair, "x", "y").first()) == (2, 0.75)
    texts = spark.createDataFrame([("a" * k,) for k in (1, 2, 3, 4)], "text string")
    assert tuple(measure.lengths(texts).first()) == (4, 2.5, 3.7, 4)
    s = spark.createDataFrame([(1, 60, 100), (1, 30, 100), (2, 5, None)], "n int, tokens int, total int")
    assert {r.n: (r["sum"], r.gap) for r in measure.token_gap(s).collect()} == {1: (90, 0.1), 2: (5, None)}
    lists = [spark.createDataFrame([(1, x, i) for i, x in enumerate(v, 1)], "n int, id string, rank int") for v in ("abc", "cbx")]
    assert measure.overlap(*lists, "n", "id", 3).first().overlap == 2


def test_effort_and_depths(spark):
    edges = [("s", "a"), ("s", "b"), ("a", "g"), ("b", "h"), ("z", "y")]
    steps = spark.createDataFrame(edges + [(b, a) for a, b in edges], "a string, b string")
    listed = spark.createDataFrame([(1, "s", 1), (2, "a", 1), (2, "g", 2), (3, "s", 1), (4, "s", 1)], "n int, id string, rank int")
    gold = spark.createDataFrame([(1, "g"), (2, "g"), (3, "y"), (4, "a"), (4, "b")], "n int, id string")
    got = {r.n: (r.effort, r.layer) for r in measure.reading_effort(listed, gold, steps, "n", 5, 99).collect()}
    # one seed and two neighbours are read before the layer of g and h; both neighbours are gold for 4
    assert got == {1: (3 + 3 / 2, 2), 2: (2.0, 0), 3: (99.0, None), 4: (1 + 3 / 3, 1)}
    e = spark.createDataFrame([("x", n, *v) for n, v in got.items()], "system string, n int, effort double, layer int")
    assert tuple(measure.effort_summary(e, ["system"]).first()) == ("x", 4, 3.25, 26.875, 0.25)
    near = spark.createDataFrame([(1, "s", 2)], "n int, id string, hop int")
    assert {(r.n, r.depth): r.share for r in measure.depth_shares(listed, near, "n").collect()} == {(1, 2): 1.0, (2, 4): 1.0, (3, 4): 1.0, (4, 4): 1.0}


def test_correlations_and_permutations(spark):
    r = random.Random(4)
    rows = [(float(r.randrange(6)), float(r.randrange(6))) for _ in range(80)] + [(None, 1.0)]
    ranks = lambda v: np.array([sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v])
    x, y = (ranks([row[k] for row in rows if row[0] is not None]) for k in (0, 1))
    df = spark.createDataFrame(rows, "x double, y double")
    assert measure.spearman(df, "x", "y") == pytest.approx(np.corrcoef(x, y)[0, 1]) and measure.spearman(df.withColumn("y", F.lit(1.0)), "x", "y") is None
    assert measure.permuted(x, x, 500) < 0.01 and measure.permuted([1, 1], [2, 3]) is None and measure.permuted(x, y, 200) > 0.01
    gap, p = measure.stratified([5, 6, 5, 6, 1, 2, 1, 2] * 3, [1, 1, 1, 1, 0, 0, 0, 0] * 3, [0] * 24, 500)
    assert gap == 4.0 and p < 0.01 and measure.stratified([1], [True], [0]) == (None, None)


def test_labels_of_judges(spark):
    types = ("why", "how", "no_new_information", "unrelated")
    good = '[{"id": "A1", "relevance": 0, "usefulness": 1, "info_types": ["why", "unrelated"]}, {"id": "A2", "relevance": 2, "usefulness": 3, "info_types": ["how", "unrelated"]}]'
    rows = [("a", good, ["A1", "A2"]), ("b", f"Here: {good} done", ["A1", "A2"]), ("c", good, ["A1", "A2", "A3"]), ("d", "nothing", ["A1"]), ("e", '[{"id": "A1", "relevance": 9, "usefulness": 1, "info_types": ["why"]}]', ["A1"]), ("f", None, ["A1"])]
    got = {(r.key, r.alias): (r.relevance, r.usefulness, r.info_types) for r in measure.labels(spark.createDataFrame(rows, "key string, answer string, aliases array<string>"), types).collect()}
    assert got == {(k, a): v for k in "ab" for a, v in (("A1", (0, 0, ["unrelated"])), ("A2", (2, 3, ["how"])))}


def test_gold_of_a_snapshot(spark):
    gold, nodes = spark.createDataFrame([(1, "a.py:f"), (1, "gone"), (2, "gone")], "n int, key string"), spark.createDataFrame([("s:a.py:f",)], "id string")
    kept, lost = measure.mapped_gold(gold, nodes)
    assert [r.id for r in kept.collect()] == ["s:a.py:f"] and {r.n: r.dropped for r in lost.collect()} == {1: 1, 2: 1}


def test_modules_hold_in_later_passages_and_documents_are_found(spark):
    nodes = spark.createDataFrame([("l:a/b.py:C:f", "Function", "f", "a/b.py"), ("l:x.py:C:f", "Function", "f", "x.py")], "id string, label string, name string, file string")
    chunks = spark.createDataFrame([("k0", "d.rst", 0, ".. currentmodule:: a.b\n"), ("k1", "d.rst", 1, ":meth:`C.f`"), ("k2", "e.rst", 0, ":meth:`C.f`"), ("k3", "d.rst", 2, ".. module:: x\n"), ("k4", "d.rst", 3, ":meth:`C.f`")], "id string, file string, idx int, text string")
    assert sorted(map(tuple, docs.resolve(chunks, nodes).collect())) == [("k1", "l:a/b.py:C:f"), ("k4", "l:x.py:C:f")]
    texts = spark.createDataFrame([("a", "docs/in/a.rst", "see :doc:`b` and :doc:`the top <../c>`, :doc:`/d`, :doc:`no`"), ("b", None, ":doc:`b`")], "id string, file string, text string")
    files = spark.createDataFrame([("docs/in/b.md",), ("docs/in/b.rst",), ("docs/c.txt",), ("docs/d.rst",)], "file string")
    assert sorted(r.file for r in docs.references(texts, files).collect()) == ["docs/c.txt", "docs/d.rst", "docs/in/b.rst"]


def test_hubs_are_joined_in_parts(spark):
    from evidar.operators import graph

    rows = [("hub", f"v{i}") for i in range(40)] + [("v1", "w"), ("w", "x")]
    steps = spark.createDataFrame(rows + [(b, a) for a, b in rows], "a string, b string")
    seeds = spark.createDataFrame([(1, "v0"), (2, "w")], "n int, id string")
    whole, cut = ({(r.n, r.id, r.hop) for r in graph.ball(seeds, steps, "n", 3, hub=h).collect()} for h in (10_000, 7))
    assert whole == cut and len(whole) > 80
    edges = spark.createDataFrame([("Calls", a, b) for a, b in rows], "type string, source string, target string")
    near = spark.createDataFrame([(1, "hub"), (1, "v3"), (2, "v4"), (1, "v9")], "n int, id string")
    a, b = ({tuple(r) for r in graph.induced(edges, near, "n", hub=h).collect()} for h in (10_000, 7))
    assert a == b == {(1, "Calls", "hub", "v3"), (1, "Calls", "hub", "v9")}


def test_stems_both_kinds_and_models(spark):
    from evidar.functions import terms

    nodes = spark.createDataFrame([("a", "run_all", "starting jobs"), ("b", "stop", "the end"), ("c", "other", "words here"), ("d", "more", "words there")], "id string, name string, source string")
    asked = spark.createDataFrame([(1, "started (running) the: job"), (2, "the")], "n int, text string")
    assert [(r.n, r.id) for r in search.english_words(asked, nodes, terms.stop_words(spark)).collect()] == [(1, "a")]
    code, chunks = spark.createDataFrame([("a", "red fish"), ("b", "blue"), ("c", "green")], "id string, text string"), spark.createDataFrame([("k", "red red")], "id string, text string")
    words = spark.createDataFrame([(1, "blue")], "n int, text string")
    assert [r.id for r in search.everything(words, code, chunks).collect()] == ["b"]
    got = search.reranked(code.withColumn("n", F.lit(1)), words, code, lambda pairs: [len(t) for _, t in pairs], top=2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("a", 8.0), ("c", 5.0)]
    assert search.covered(code.withColumn("n", F.lit(1)), code.withColumn("n", F.lit(1))).count() == 3
