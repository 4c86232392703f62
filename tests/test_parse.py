import json
import subprocess

from evidar.operators import code, context, diff, docs, evaluate
from evidar.sources import files, gitlog, reports, sinks
from evidar.streaming import incremental

SOURCE = '''import os
from .models import Base

class A(Base):
    @property
    def f(self):
        self.g()
        helper(1)

    def g(self):
        return os.path

def helper(x):
    def inner():
        pass
    return inner()
'''


def test_python_source_to_graph(spark):
    table = spark.createDataFrame([("p/a.py", SOURCE), ("p/models.py", "class Base:\n    pass\n"), ("bad.py", "def (:"), ("none.py", None)], "file string, source string")
    nodes, refs = code.extract(table)
    got = {r.id: (r.label, r.start_line, r.end_line) for r in nodes.collect()}
    assert got["local:p/a.py:A:f"] == ("Function", 5, 8) and got["local:p/a.py:helper:inner"][0] == "Function" and got["local:bad.py"][0] == "Module" and len(got) == 9
    e = {(r.type, r.source.split(":", 1)[1], r.target.split(":", 1)[1]) for r in code.resolve(nodes, refs).collect()}
    assert {("Imports", "p/a.py", "p/models.py"), ("Calls", "p/a.py:A:f", "p/a.py:A:g"), ("Calls", "p/a.py:A:f", "p/a.py:helper"), ("Inherits", "p/a.py:A", "p/models.py:Base"), ("Defines", "p/a.py", "p/a.py:A")} <= e


def test_passages_by_heading_and_length():
    text = "Title\n=====\n\nfirst\n\n# Second\n\n" + "a" * 1000 + "\n\n" + "b" * 1000
    got = docs.passages(text)
    assert [(h, len(t)) for h, t in got] == [("Title", 5), ("Second", 1000), ("Second", 1000)]


def test_names_in_passages(spark):
    nodes = spark.createDataFrame([("l:a/b.py:C:f", "Function", "f", "a/b.py"), ("l:x.py:f", "Function", "f", "x.py"), ("l:a/b.py:C", "Class", "C", "a/b.py")], "id string, label string, name string, file string")
    chunks = spark.createDataFrame([("k1", ".. currentmodule:: a.b\n\nSee :meth:`C.f` and :func:`f`."), ("k2", ":class:`~a.b.C`"), ("k3", None)], "id string, text string")
    assert sorted(map(tuple, docs.resolve(chunks, nodes).collect())) == [("k1", "l:a/b.py:C:f"), ("k2", "l:a/b.py:C")]


def test_diffs_and_spans(spark, tmp_path):
    text = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,4 +1,5 @@\n a\n-b\n+  c\n+\n d\n e\n"
    got = diff.parse(text)
    assert got == [{"old": "x.py", "new": "x.py", "removed": [2], "inserted": [(2, [(2, "  c"), (-1, "")])]}] and diff.parse("") == []
    spans = spark.createDataFrame([("o", "f", 1, 20), ("i", "f", 5, 9), ("j", "f", 5, 9), ("n", "f", None, 9)], "id string, file string, start int, end int")
    points = spark.createDataFrame([("f", 6), ("f", 15), ("f", 30), ("g", 1)], "file string, line int")
    assert sorted((r.line, r.id) for r in diff.narrowest(points, spans).collect()) == [(6, "i"), (15, "o")]
    lines = spark.createDataFrame([(1, 1, 8, "x"), (1, 2, -1, ""), (1, 3, 4, "@d"), (1, 4, -1, "")], "block int, i int, indent int, text string")
    assert [r.least for r in diff.least_indents(lines).orderBy("i").collect()] == [8, 8, 4, 4]
    assert [r.open for r in diff.only_decorators_follow(lines).orderBy("i").collect()] == [False, True, True, True]


def test_git_history(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    for i in range(3):
        (tmp_path / "a.py").write_text(f"x = {i}\n")
        run("add", ".")
        run("commit", "-qm", f"change {i}\n\nbody")
    got = gitlog.log(spark, str(tmp_path))
    assert [r.msg for r in got.collect()] == ["change 2\n\nbody", "change 1\n\nbody"]
    changes = [diff.parse(r["diff"]) for r in gitlog.diffs(got, str(tmp_path)).collect()]
    assert all(c[0]["new"] == "a.py" and c[0]["removed"] == [1] for c in changes)


def test_sources_and_sinks(spark, tmp_path):
    tree = tmp_path / "tree"
    for name, text in (("src/a.py", "x = 1"), ("tests/t.py", ""), ("docs/i.rst", "Hi"), ("docs/_build/x.rst", ""), ("docs/requirements.txt", "")):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(text)
    assert [r.file for r in files.source_files(spark, str(tree)).collect()] == ["src/a.py"]
    assert [r.file for r in files.doc_files(spark, str(tree / "docs")).collect()] == ["i.rst"]
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "1.json").write_text(json.dumps([{"number": 1, "title": "old", "body": None, "created_at": "2024-01-01T00:00:00Z", "updated_at": "1"}, {"number": 2, "title": "p", "pull_request": {"url": "u"}, "updated_at": "1"}]))
    (pages / "2.json").write_text(json.dumps([{"number": 1, "title": "new", "body": "b", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2"}]))
    got = {r.n: (r.title, r.body, r.pr, r.created) for r in reports.from_pages(spark, str(pages)).collect()}
    assert got == {1: ("new", "b", False, 1704067200), 2: ("p", "", True, None)}
    assert [reports.backoff(i) for i in range(5)] == [5, 10, 20, 40, 60] and reports.limited(403, "0", None) and not reports.limited(404, None, None)
    nodes = spark.createDataFrame([("a", "Module", 1), ("b", "Class", 2)], "id string, label string, n int")
    edges = spark.createDataFrame([("Calls", "a", "b", 1), ("Calls", "a", "b", 1), ("Calls", "a", "z", 1)], "type string, source string, target string, line int")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == 1
    m = sinks.manifest(nodes, edges, "now").first()
    assert m.labels == {"Module": 1, "Class": 1} and m.types == {"Calls": 1} and m.raw_edges == 3
    assert sinks.consistent(nodes, {"Module": 1, "Class": 1}) == [] and sinks.consistent(nodes, {"Module": 2, "Class": 1}) == ["Module: stored 2, live 1"]


def test_stream_keeps_the_latest(spark, tmp_path):
    schema = "n int, title string, fetched_at timestamp"
    write = lambda rows, k: spark.createDataFrame(rows, "n int, title string, s string").selectExpr("n", "title", "cast(s as timestamp) fetched_at").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    write([(1, "a", "2024-01-01"), (2, "b", "2024-01-01"), (1, "a", "2024-01-01")], "x")
    for k, rows in (("y", None), ("z", [(1, "c", "2024-01-02")])):
        if rows:
            write(rows, k)
        stream = incremental.arriving(spark, f"{tmp_path}/in/*", schema)
        incremental.keep_latest(stream, f"{tmp_path}/t", ["n"], "fetched_at", f"{tmp_path}/cp").awaitTermination()
    assert sorted((r.n, r.title) for r in incremental.current(spark, f"{tmp_path}/t").collect()) == [(1, "c"), (2, "b")]


def test_evidence_and_citations(spark):
    pools = spark.createDataFrame([(1, "D", f"k{i}", i) for i in range(1, 8)] + [(1, "C", "c", 1)], "n int, section string, id string, rank int")
    shown = context.assemble(pools)
    assert shown.where("in_context").count() == 6
    answers = spark.createDataFrame([(1, "see [D1, D7] and [C1]; `f` in `a.py:4`, `g` in `a.py:40-50`")], "n int, answer string")
    cited = context.citations(answers, shown)
    assert {r.tag: r.valid for r in cited.collect()} == {"D1": True, "D7": False, "C1": True}
    spans = spark.createDataFrame([(1, "a.py", 1, 9)], "n int, file string, start int, end int")
    assert {r.symbol: r.valid for r in context.cited_symbols(answers, spans).collect()} == {"f": True, "g": False}
    assert {r.section: (r.shown, r.cited) for r in context.run_summary(shown, cited).collect()} == {"D": (5, 1), "C": (1, 1)}
    assert context.format_sections(shown, spark.createDataFrame([("c", "text")], "id string, text string")).first().text.startswith("[C1] c\ntext")


def test_metrics(spark):
    lists = spark.createDataFrame([("s", 1, "a", 1), ("s", 1, "b", 2), ("s", 1, "c", 3)], "system string, n int, key string, rank int")
    gold = spark.createDataFrame([(1, "b"), (1, "z")], "n int, key string")
    r = evaluate.list_metrics(lists, gold, ["n"]).first()
    assert (r.gold, r.best, r.mrr, r.map, r.top1, r.top5, r.acc5) == (2, 2, 0.5, 0.25, 0, 1, 0)
    p = evaluate.precision_recall(spark.createDataFrame([(1, "a"), (1, "a")], "n int, f string"), spark.createDataFrame([(1, "a"), (2, "b")], "n int, f string"), "n", "f")
    assert {x.n: (x.tp, x.precision, x.recall) for x in p.collect()} == {1: (1, 0.5, 1.0), 2: (0, 0.0, 0.0)}
    assert evaluate.mcnemar_p(0, 0) == 1.0 and abs(evaluate.mcnemar_p(1, 5) - 0.21875) < 1e-9
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "test string, p double")
    assert [x.adjusted for x in evaluate.holm(tests).orderBy("test").collect()] == [0.03, 0.06, 0.06]
    k = evaluate.kappa(spark.createDataFrame([(0, 0), (1, 1), (0, 1), (1, 1)], "a int, b int"), "a", "b").first()
    assert (k.n, k.agreement, k.kappa) == (4, 0.75, 0.5)
    assert evaluate.sign_flips([1, 1, 1, 1, 1, 1, 1, 1]) < 0.02 and evaluate.sign_flips([]) == 1.0
