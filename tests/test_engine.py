"""A small repository from its working tree to evidence, twice."""

import json
import subprocess

from evidar import __main__ as command
from evidar import engine


def git(where, *arguments):
    return subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", *arguments], cwd=where, check=True, capture_output=True, text=True).stdout.strip()


FILES = {
    "lib/base.py": "class Store:\n    def load_table(self, name):\n        return read_rows(name)\n\n\ndef read_rows(name):\n    return [name]\n",
    "lib/main.py": "from lib.base import Store\n\n\ndef run():\n    store = Store()\n    return store.load_table('x')\n",
    "docs/index.rst": "Guide\n=====\n\nCall :func:`run` to start. :doc:`more`\n",
    "docs/more.rst": "More\n====\n\n.. module:: lib.base\n\nSee :meth:`Store.load_table`.\n",
    "tests/test_x.py": "def test(): pass\n",
}


def test_build_update_and_search(spark, tmp_path, capsys):
    encode = lambda texts: [[float("table" in t), float("start" in t), 0.1] for t in texts]
    tree, index = tmp_path / "tree", str(tmp_path / "index")
    tree.mkdir()
    git(tree, "init", "-q")
    for i, change in enumerate(("", "    # fixed\n    name = name.strip()\n")):
        for name, text in FILES.items():
            (tree / name).parent.mkdir(parents=True, exist_ok=True)
            (tree / name).write_text(text.replace("    return [name]", change + "    return [name]"))
        git(tree, "add", "-A")
        git(tree, "commit", "-qm", "start" if not i else "Fixes #3: table names with blanks")
    reports = spark.createDataFrame([(3, False, "load_table fails on blanks", "table names", 100, "u"), (4, False, "other words", None, 200, "u")], "n int, pr boolean, title string, body string, created bigint, url string")
    first = engine.build(spark, str(tree), index, reports=reports, encode=encode, model="m")
    assert (first["commits"], first["new_commits"], first["reports_new"], first["reuse"]) == (1, 1, 2, 0.0)
    e = engine.Engine.load(spark, index, encode=encode)
    assert e.check() == [] and engine.Engine.load(spark, index) is e
    edges = {(r.type, r.source.split(":", 1)[1], r.target.split(":", 1)[1]) for r in e.table("edges").collect()}
    assert {("Calls", "lib/main.py:run", "lib/base.py:Store:load_table"), ("Documents", "docs/index.rst:0", "lib/main.py:run"), ("Documents", "docs/more.rst:0", "lib/base.py:Store:load_table"), ("References", "docs/index.rst:0", "docs/more.rst")} <= edges
    assert [r.touch for r in e.table("units").collect()] == [["lib/base.py:read_rows"]]
    prompts = spark.createDataFrame([(1, "load_table fails for a table with blanks"), (2, "zzz")], "n int, text string")
    got = {(r.n, r.section, r.tag): r.id for r in e.search(prompts).collect()}
    assert got[1, "H", "H1"] and got[1, "I", "I1"] == "3" and got[1, "E", "E1"] == "local:lib/base.py:Store:load_table" and {got[1, "D", "D1"], got[1, "D", "D2"]} == {"chunk:docs/index.rst:0", "chunk:docs/more.rst:0"}
    assert {got[1, "C", f"C{k}"] for k in (1, 2, 3)} >= {"local:lib/base.py:Store:load_table", "local:lib/base.py:read_rows"} and (2, "I", "I1") not in got
    record = e.ask("load_table fails", lambda text: {"answer": "see [C1]", "finish_reason": "STOP"}, source="text")
    assert record["citations"]["invalid_items"] == [] and record["index"]["head_sha"] == git(tree, "rev-parse", "HEAD")
    files, told = e.legacy(prompts)
    assert files.where("n = 1").orderBy("place").first().file == "lib/base.py" and "def load_table" in told.where("n = 1").first().text
    (tree / "lib/main.py").write_text(FILES["lib/main.py"] + "\n\ndef stop():\n    return None\n")
    git(tree, "add", "-A")
    git(tree, "commit", "-qm", "stop")
    again = engine.build(spark, str(tree), index, engine.DETAILED, reports=reports, encode=encode, model="m")
    assert (again["commits"], again["new_commits"], again["reports_new"]) == (2, 1, 0) and again["reuse"] > 0.5
    later = engine.Engine.load(spark, index)
    assert later is not e and later.check() == [] and {"CLASS", "METHOD", "FUNCTION", "Module"} <= {r.label for r in later.table("nodes").collect()}
    assert {"HAS_METHOD", "USES", "CONTAINS", "IMPORTS"} <= {r.type for r in later.table("edges").select("type").distinct().collect()}
    assert command.main(["check", index], spark) == 0 and json.loads(capsys.readouterr().out) == []
    assert engine.Engine(spark, str(tmp_path / "none")).check() == ["there is no index"]
