"""Sources, sinks, records and the formats of evidence."""

import json
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidar.operators import context, runs
from evidar.sources import files, reports, repositories, sinks


def one(spark, row, schema, expression):
    return spark.createDataFrame([row], schema).select(expression.alias("y")).first()[0]


def test_formats_of_evidence(spark):
    assert one(spark, ("D1", "docs/a.rst", "Usage", "Body"), "tag string, file string, heading string, text string", context.format_passage()) == "[D1] Documentation passage\nFile: docs/a.rst\nSection: Usage\nText:\nBody"
    told = one(spark, ("H2", "0123456789abcdef", 1700000000, "Fix crash\n\nlong", [(9, "PR nine", "pr body"), (3, "Crash", "trace")]), "tag string, h string, t bigint, msg string, linked array<struct<n: int, title: string, body: string>>", context.format_commit())
    assert told == "[H2] Past commit 01234567, committed 2023-11-14\nCommit message:\nFix crash\n\nlong\nLinked ticket or pull request #3: Crash\ntrace\nLinked ticket or pull request #9: PR nine\npr body"
    assert one(spark, ("I1", 7, 1700000000, "Bug", "B"), "tag string, n int, created bigint, title string, body string", context.format_report()) == "[I1] Past bug report #7, created 2023-11-14: Bug\nB"
    row = ("C1", "Function", "local:m.py:A:f", "m.py", 1, 3, [], 0, ["`g` (m.py:5)"], 3, "x")
    code = one(spark, row, "tag string, label string, id string, file string, start_line int, end_line int, callers array<string>, n_callers int, callees array<string>, n_callees int, source string", context.format_code())
    assert code == "[C1] Function `A.f` in `m.py:1-3`\nCalled by: none found in the call graph\nCalls: `g` (m.py:5) (+2 more)\n```python\nx\n```"
    assert one(spark, (None,), "t bigint", context.day(F.col("t"))) == "unknown date"
    entity = "tag string, label string, id string, file string, start_line int, matched string, in_code string, with_source boolean, source string"
    assert one(spark, ("E1", "Class", "l:m.py:A", "m.py", 4, "A", "C2", False, ""), entity, context.format_entity()) == "[E1] Class `A` in `m.py:4` (matched `A`), same element as [C2]"


def test_links_quotas_and_reasons(spark):
    items = spark.createDataFrame([(1, "D", "D1", True, ["a", "b"]), (1, "D", "D2", True, ["z"]), (1, "D", "D9", False, ["a"]), (2, "D", "D1", False, ["a"])], "n int, section string, tag string, in_context boolean, targets array<string>")
    code = spark.createDataFrame([(1, "C1", "a"), (1, "C2", "b")], "n int, tag string, id string")
    links = context.linked(items, code)
    assert sorted(map(tuple, links.collect())) == [(1, "D1", "C1"), (1, "D1", "C2")]
    assert {r.n: r.ratio for r in context.linked_ratio(items, links).collect()} == {1: 0.5, 2: None}
    h = spark.createDataFrame([(1, 1, [5, 6]), (1, 11, [7])], "n int, rank int, links array<int>")
    i = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (1, 9, 6)], "n int, rank int, report int")
    assert context.shared_reports(h, i).collect()[0].overlap == 1
    ents = spark.createDataFrame([(1, f"e{k}", "Module" if k == 2 else "Function", k) for k in range(1, 9)], "n int, id string, label string, place int")
    got = {r.id: (r.in_code, r.with_source) for r in context.entity_sources(ents, spark.createDataFrame([(1, "C1", "e1")], "n int, tag string, id string"), most=3).collect()}
    assert got["e1"] == ("C1", False) and got["e2"] == (None, False) and [k for k, v in got.items() if v[1]] == ["e3", "e4", "e5"]
    prompts = spark.createDataFrame([(1,), (2,)], "n int")
    why = {(r.n, r.section): r.reason for r in context.empty_reasons(prompts, prompts.where("n = 1"), ents, prompts, prompts.where("false"), prompts.where("false"), {"history": True, "reports": True}).collect()}
    assert why[1, "E"] is None and why[2, "E"].startswith("no identifier") and why[1, "D"] is None and why[1, "H"].startswith("no commit touches") and why[2, "I"].startswith("no closed report")
    lines = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "n int, rank int, line string")
    assert {r.n: r.text for r in context.joined(lines, prompts).collect()} == {1: "a\n\nb", 2: "(none)"}


def found(spark):
    return lambda prompt: (spark.createDataFrame([(1, "C", "C1", "a", 1, True), (1, "C", "C2", "b", 2, True), (1, "D", "D7", "k", 7, False)], "n int, section string, tag string, id string, rank int, in_context boolean"), spark.createDataFrame([("a", "text a")], "id string, text string"))


def test_records_whatever_happens(spark, tmp_path):
    record = runs.run("why?", found(spark), {"k": 60}, {"head_sha": "a"}, lambda text: {"answer": "see [C2, D7]", "finish_reason": "STOP", "prompt_token_count": 100}, lambda s: {k: len(v) for k, v in s.items()}, head="b")
    assert [k for k in record if not k.startswith("_")] == list(runs.BLOCKS) and record["citations"] == {"cited_items": ["C2", "D7"], "invalid_items": ["D7"]} and record["index"]["stale"]
    assert record["retrieval"][1]["cited"] and record["llm"]["section_tokens_gap"] == round((100 - record["llm"]["section_tokens_sum"]) / 100, 4)
    place = sinks.write_run(spark, record, str(tmp_path))
    assert json.loads(open(f"{place}/record.json").read())["run"]["prompt"] == "why?" and "[C1] a" in open(f"{place}/prompt.txt").read()
    sinks.write_run(spark, record, str(tmp_path))
    assert [json.loads(r.value)["items"] for r in spark.read.text(f"{tmp_path}/runs/index").collect()] == [{"C": 2, "D": 0}] * 2
    failed = runs.run("x", lambda p: 1 / 0, {})
    assert failed["llm"]["finish_reason"] == "NOT_RUN" and "ZeroDivisionError" in failed["warnings"][0] and failed["retrieval"] is None
    broken = runs.run("x", found(spark), {"model": "a"}, answer=lambda t: {"error": "401", "finish_reason": "ERROR"})
    assert broken["warnings"] == ["LLM call failed: 401"] and broken["config"]["config_sha"] != runs.run("x", found(spark), {"model": "b"})["config"]["config_sha"]


def test_seeds_orders_and_ablations(spark):
    rows = spark.createDataFrame([("django__1",)], "i string")
    assert runs.seeds_of(rows, "i").first().seed == runs.seed_of("django__1")
    items = spark.createDataFrame([(1, f"x{i}") for i in range(8)], "n int, id string")
    a, b = ([r.id for r in runs.judge_requests(items, seed=s).orderBy("place").collect()] for s in (0, 1))
    assert a != b and sorted(a) == sorted(b) and a == [r.id for r in runs.judge_requests(items.repartition(3)).orderBy("place").collect()]
    lists = {k: spark.createDataFrame([(1, x, i) for i, x in enumerate(v, 1)], "n int, id string, rank int") for k, v in (("AST", "abc"), ("HIST", "cd"), ("DOC", "e"))}
    got = runs.ablations(lists).collect()
    assert {r.system for r in got} == {"AST", "+HIST", "+DOC", "+ALL", "ALL-HIST", "ALL-DOC"} and [r.id for r in sorted((x for x in got if x.system == "+HIST"), key=lambda r: r.rank)] == ["c", "a", "b", "d"]


def item(n, title, pr=False):
    return {"number": n, "title": title, "body": None, "created_at": f"2024-01-0{n}T00:00:00Z", "html_url": f"u{n}", **({"pull_request": {}} if pr else {})}


def test_fetching_goes_on_where_it_stopped(spark, tmp_path):
    calls, limits = [], {"P2"}
    fetch = reports.Fetch("a/b", str(tmp_path / "f"), host="H", http=lambda url, token: answer(url))
    pages = {fetch.first: ([item(1, "a"), item(2, "b", True)], "P2"), "P2": ([item(3, "c")], None)}

    def answer(url):
        calls.append(url)
        if url in limits:
            limits.discard(url)
            raise reports.Exhausted(123.0)
        rows, after = pages[url]
        return json.dumps(rows), ({"Link": f'<{after}>; rel="next"'} if after else {})

    assert fetch.run() == {"complete": False, "pages": 1, "rows": 2, "reset": 123.0}
    assert fetch.run() == {"complete": True, "pages": 1, "rows": 1, "reset": None} and calls == [fetch.first, "P2", "P2"]
    assert sorted((r.n, r.pr, r.title) for r in fetch.reports(spark).collect()) == [(1, False, "a"), (2, True, "b"), (3, False, "c")]
    since = f"{fetch.first}&since={fetch.state['fetched']}"
    pages[since] = ([item(2, "b edited", True), item(4, "d")], None)
    assert fetch.run()["rows"] == 2 and calls[-1] == since
    assert {r.n: r.title for r in fetch.reports(spark).collect()} == {1: "a", 2: "b edited", 3: "c", 4: "d"}


def test_pages_are_asked_for_again():
    import io
    import urllib.error

    waits, answers = [], [urllib.error.URLError("x"), urllib.error.HTTPError("u", 502, "", {}, None), "ok"]

    class Answer(io.BytesIO):
        headers = {"Link": "<n>; rel=\"next\""}

    def opener(request, timeout):
        got = answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return Answer(got.encode())

    assert reports.get("http://h", wait=waits.append, opener=opener)[0] == "ok" and waits == [5, 10]
    for code, headers, want in ((404, {}, None), (429, {"X-RateLimit-Reset": "7"}, reports.Exhausted), (401, {}, urllib.error.HTTPError)):
        answers[:] = [urllib.error.HTTPError("u", code, "", headers, None)]
        if want is None:
            assert reports.get("http://h", opener=opener) == (None, {})
        else:
            with pytest.raises(want):
                reports.get("http://h", opener=opener)
    assert reports.next_page({"Link": '<a>; rel="prev", <b>; rel="next"'}) == "b" and reports.next_page({}) is None


def test_tickets_and_titles(spark):
    got = one(spark, ("Fixed #1, #2 and #3 -- words. Refs #3, #9.",), "m string", reports.tickets(F.col("m")))
    assert [(r.n, r.type) for r in got] == [(1, "fixed"), (2, "fixed"), (3, "fixed"), (9, "refs")]
    assert one(spark, ("  [Bug]  A   Title! ",), "m string", reports.plain_title(F.col("m"))) == "bug] a title"


def test_trees_vectors_and_damaged_lines(spark, tmp_path):
    tree = tmp_path / "tree"
    for name, text in (("src/a.py", "x"), ("tests/t.py", ""), ("documentation/i.rst", "Hi"), ("new.py", "y"), ("skip.py", "z")):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(text)
    assert {r.file for r in files.tracked_files(spark, str(tree)).collect()} == {"src/a.py", "new.py", "skip.py"}
    subprocess.run(["git", "init", "-q"], cwd=tree, check=True)
    (tree / ".gitignore").write_text("skip.py\n")
    assert {r.file: r.source for r in files.tracked_files(spark, str(tree)).collect()} == {"src/a.py": "x", "new.py": "y"}
    assert [r.file for r in files.documentation(spark, str(tree)).collect()] == ["documentation/i.rst"] and files.documentation(spark, str(tree / "src")).count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    assert [r.line for r in files.damaged(spark, str(tmp_path / "x.jsonl"), "a int").collect()] == ['{"a": ']
    files.write_jsonl(spark.createDataFrame([("é",)], "s string"), str(tmp_path / "out"))
    assert files.jsonl(spark, str(tmp_path / "out"), "s string").first().s == "é"
    np.save(tmp_path / "v.npy", np.arange(12, dtype=np.float32).reshape(6, 2))
    (tmp_path / "ids.json").write_text(json.dumps(list("abcdef")))
    assert {r.id: r.v for r in files.npy_vectors(spark, str(tmp_path / "v.npy"), str(tmp_path / "ids.json"), rows=4).collect()}["e"] == [8.0, 9.0]
    patch = "--- a/m.py\n+++ b/m.py\n@@ -1 +1 @@\n-a\n+b\n"
    (tmp_path / "b.jsonl").write_text(json.dumps({"instance_id": "i", "repo": "r", "base_commit": "c", "problem_statement": "p", "patch": patch}) + "\n" + json.dumps({"instance_id": "j"}) + "\n")
    assert {r.instance_id: r.gt_files for r in files.benchmark(spark, str(tmp_path / "b.jsonl")).collect()} == {"i": ["m.py"], "j": []}


def test_working_copies(tmp_path):
    origin = tmp_path / "origin"
    origin.mkdir()
    run = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", *a], cwd=origin, check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q")
    names = []
    for i in range(2):
        (origin / "a.txt").write_text(str(i))
        run("add", "-A")
        run("commit", "-qm", str(i))
        names.append(run("rev-parse", "HEAD"))
    place = repositories.at_commit(str(origin), str(tmp_path / "c"), "own/er", names[0])
    assert place.endswith(f"own_er_{names[0][:8]}") and open(f"{place}/a.txt").read() == "0" and repositories.at_commit(str(origin), str(tmp_path / "c"), "own/er", names[0]) == place
    with pytest.raises(RuntimeError):
        repositories.at_commit(str(origin), str(tmp_path / "c"), "own/er", "f" * 40)
    assert not repositories.place_of(str(tmp_path / "c"), "own/er", "f" * 40).exists()
    assert repositories.clone(str(origin), str(tmp_path / "d")) == names[1] and repositories.head(str(tmp_path / "d"))["head_sha"] == names[1]
    assert repositories.with_token("https://h.example/a", "T") == "https://oauth2:T@h.example/a" and repositories.with_token("git@h:a", "T") == "git@h:a" and "T@" not in repositories.without_token("fatal: https://oauth2:T@h.example/a")


def test_stored_graphs(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "Function", "run", "def run(): pass"), ("b", "Module", "m", "run")], "id string, label string, name string, source string")
    edges = spark.createDataFrame([("Calls", "a", "b", 1), ("Documents", "b", "a", None)], "type string, source string, target string, line int")
    at = str(tmp_path / "g")
    sinks.write_graph(nodes, edges, at)
    sinks.write_word_index(nodes, at)
    assert {(r.id, r.term) for r in spark.read.parquet(f"{at}/words").collect()} == {("a", "run"), ("a", "def"), ("a", "pass")}
    sinks.refresh_edges(spark.createDataFrame([("Documents", "a", "a", None)], edges.schema), at, ["Documents"])
    assert {(r.type, r.source) for r in spark.read.parquet(f"{at}/edges").collect()} == {("Calls", "a"), ("Documents", "a")}
    assert sinks.same_rows(nodes, nodes.union(nodes), ["id"]) and not sinks.same_rows(nodes, nodes.where("id = 'a'"), ["id"])
    before = spark.createDataFrame([("commit", "1")], "kind string, key string")
    after = spark.createDataFrame([("commit", "1"), ("commit", "2"), ("report", "9")], "kind string, key string")
    assert tuple(sinks.update_summary(before, after, spark.createDataFrame([(True,), (False,)], "known boolean")).first()) == (2, 1, 1, 0.5)
    m = sinks.run_manifest({"a": 1, "github_token": "x", "inner": {"password": "y"}}, spark.createDataFrame([("f", "s"), ("g", "t")], "file string, source string"))
    assert m["config"] == {"a": 1, "github_token": "***", "inner": {"password": "***"}} and m["files"] == 2
    sinks.clear(spark, at)
    assert not (tmp_path / "g" / "nodes").exists()
