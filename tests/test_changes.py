"""What a change touches: real diffs of a small repository against expected elements, touch sets, hunks."""

import subprocess

import pytest
from pyspark.sql import functions as F

from evidar.operators import code, diff
from evidar.sources import gitlog

TEXT = """import sys

LIMIT = 9


class Store:
    size = 4

    def put(self):
        key = 7
        return key

    @property
    def full(self):
        return True


def scan():
    row = 0
    return row


def drop():
    return 8
"""


def git(where, *arguments):
    done = subprocess.run(["git", "-C", str(where), "-c", "user.name=x", "-c", "user.email=x@x", "-c", "core.autocrlf=false", *arguments], check=True, capture_output=True)
    return done.stdout.decode()


def commit(where, files, message="change", moved=None):
    if moved:
        git(where, "mv", *moved)
    for name, text in files.items():
        (where / name).parent.mkdir(parents=True, exist_ok=True)
        (where / name).write_bytes(text.encode())
    git(where, "add", "-A")
    git(where, "commit", "-q", "-m", message)
    return git(where, "rev-parse", "HEAD").strip()


M = "lib/a.py"
CASES = {
    "inside a method": ({M: TEXT.replace("key = 7", "key = 6")}, None, ["lib/a.py:Store:put"], False),
    "line of a class": ({M: TEXT.replace("size = 4", "size = 5")}, None, ["lib/a.py:Store"], False),
    "line of the module": ({M: TEXT.replace("LIMIT = 9", "LIMIT = 1")}, None, [], True),
    "last line": ({M: TEXT.replace("    return 8\n", "    pass\n")}, None, ["lib/a.py:drop"], False),
    "decorator changed": ({M: TEXT.replace("@property", "@cached")}, None, ["lib/a.py:Store:full"], False),
    "added in a body": ({M: TEXT.replace("    row = 0\n", "    row = 0\n    col = row\n")}, None, ["lib/a.py:scan"], False),
    "added to the end of a body": ({M: TEXT.replace("    return row\n", "    return row\n    log(row)\n")}, None, ["lib/a.py:scan"], False),
    "a new function": ({M: TEXT.replace("    return row\n", "    return row\n\n\ndef more():\n    return 5\n")}, None, [], True),
    "a new decorator": ({M: TEXT.replace("def drop():", "@cached\ndef drop():")}, None, ["lib/a.py:drop"], False),
    "blank line in a body": ({M: TEXT.replace("    row = 0\n", "    row = 0\n\n")}, None, ["lib/a.py:scan"], False),
    "blank line between": ({M: TEXT.replace("\n\ndef drop", "\n\n\ndef drop")}, None, [], True),
    "a renamed file": ({"lib/b.py": TEXT.replace("return row", "return row + 1")}, (M, "lib/b.py"), ["lib/a.py:scan"], False),
    "a new file": ({"lib/n.py": "def new():\n    return 1\n"}, None, [], None),
    "two elements": ({M: TEXT.replace("key = 7", "key = 6").replace("return 8", "return 9")}, None, ["lib/a.py:Store:put", "lib/a.py:drop"], False),
    "no newline at the end": ({M: TEXT.rstrip("\n")}, None, ["lib/a.py:drop"], False),
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    """What the oracle says of every case, each a change of its own in one table."""
    rows, parents = [], []
    for name, (files, moved, _, _) in CASES.items():
        where = tmp_path_factory.mktemp("case")
        git(where, "init", "-q")
        base = commit(where, {M: TEXT}, "base")
        commit(where, files, moved=moved)
        rows.append((name, git(where, "diff", "-U0", "-M", base, "HEAD", "--", "*.py")))
        parents.append((name, str(where), base))
    changes = spark.createDataFrame(rows, "change string, diff string")
    changed = diff.lines(changes).cache()
    spans = None
    for name, where, base in parents[:1]:
        one = code.spans_at(spark.createDataFrame([(name, base, M)], "change string, commit string, file string"), where)
        # every case begins with the same file
        spans = one.drop("change").join(changes.select("change"))
    return changed, diff.oracle(changed, spans).collect(), spans


@pytest.mark.parametrize("name", CASES)
def test_elements_a_change_touches(found, name):
    own = [r for r in found[1] if r.change == name]
    _, _, ids, module = CASES[name]
    assert sorted(r.id for r in own if r.id) == ids and (any(r.module for r in own) is bool(module))


def test_renamed_and_added_files(found):
    changed = found[0]
    assert [tuple(r) for r in diff.renames(changed).collect()] == [("a renamed file", M, "lib/b.py")]
    assert [tuple(r) for r in diff.added_files(changed).collect()] == [("a new file", "lib/n.py")]
    sets = {r.change: (r.touch, r.touch_mod) for r in diff.touch_sets(changed, found[2]).collect()}
    assert sets["a renamed file"] == (["lib/b.py:scan"], []) and sets["line of the module"] == ([], [M]) and sets["a new file"] == ([], []) and len(sets) == len(CASES)


def test_spans_have_decorators_and_indents(found):
    spans = {r.id: r for r in found[2].where("change = 'two elements'").collect()}
    assert (spans["lib/a.py:Store:full"].start, spans["lib/a.py:Store:full"].defined, spans["lib/a.py:Store:put"].indent) == (13, 14, 4) and spans["lib/a.py"].label == "Module"


def test_history_and_hunks_of_a_repository(spark, tmp_path):
    git(tmp_path, "init", "-q")
    body = "def f():\n    x = 1\n    return x\n\n\nclass A:\n    def m(self):\n        return 1\n\n\ndef g():\n    return 3\n"
    later = body.replace("x = 1", "x = 2").replace("return 1", "return 2").replace("return 3", "return 4")
    commit(tmp_path, {"p/m.py": body, "tests/t.py": "a = 1\n"}, "base")
    commit(tmp_path, {"p/m.py": body.replace("x = 1", "x = 2")}, "Fix f bug\n\nwith a body\n")
    commit(tmp_path, {"docs/a.rst": "Doc\n===\n", "tests/t.py": "a = 2\n"}, "words only")
    commit(tmp_path, {"p/m.py": later}, "change g and m")
    units = gitlog.history(spark, str(tmp_path)).cache()
    got = {r.msg: (r.touch, r.touch_mod, r.merge) for r in units.collect()}
    assert got == {"change g and m": (["p/m.py:A:m", "p/m.py:g"], [], False), "words only": ([], [], False), "Fix f bug\n\nwith a body": (["p/m.py:f"], [], False)}
    hunks = gitlog.hunks(units, str(tmp_path)).cache()
    assert sorted(tuple(r.ids) for r in hunks.collect()) == [("p/m.py:A:m", "p/m.py:g"), ("p/m.py:f",)]
    head = commit(tmp_path, {"p/m.py": later.replace("    x = 2\n", "    x = 2\n    # a note\n")}, "comment in f")
    more = gitlog.history(spark, str(tmp_path), known=units)
    assert {r.msg: r.touch for r in more.collect()}["comment in f"] == ["p/m.py:f"] and more.count() == 4
    assert gitlog.hunks(more, str(tmp_path), done=hunks).count() == 0
    assert gitlog.ancestors(spark.createDataFrame([(head,)], "snapshot string"), str(tmp_path)).count() == 5
    was = gitlog.blobs(spark.createDataFrame([(head, "p/m.py"), (head, "none.py")], "commit string, file string"), str(tmp_path))
    assert {r.file: r.source and "# a note" in r.source for r in was.collect()} == {"p/m.py": True, "none.py": None}
    with pytest.raises(Exception, match="git"):
        gitlog.log(spark, str(tmp_path), head="nowhere").collect()


def test_gold_files_of_a_patch(spark):
    patch = "diff --git a/astro/x.py b/astro/x.py\n--- a/astro/x.py\n+++ b/astro/x.py\n@@ -1 +1 @@\n-a\n+b\ndiff --git a/new.py b/new.py\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n+c\n"
    assert [tuple(r) for r in diff.gold_files(spark.createDataFrame([("i", patch), ("j", None)], "change string, diff string")).collect()] == [("i", "astro/x.py")]


SOURCES = {
    "app/base.py": "class Root:\n    def ping(self):\n        return 1\n\nclass Left(Root):\n    pass\n\nclass Right(Root):\n    def pong(self):\n        return 2\n",
    "app/core.py": (
        "from app.base import Left, Right as R\nimport app.tools\n\nclass Both(Left, R):\n    kind: R\n\n    def __init__(self):\n        self.left = Left()\n\n    def go(self, other: 'Right'):\n"
        "        self.ping()\n        self.pong()\n        self.left.ping()\n        self.kind.pong()\n        other.pong()\n        x = Left()\n        x.ping()\n        helper()\n        print(1)\n        R().pong()\n"
    ),
    "app/tools.py": "def helper():\n    def inner():\n        return helper()\n    return inner()\n",
    "web/a.js": "import b from './b.js';\nconst c = require('../lib/c');\n// class No { x() {} }\nexport class Box extends Base {\n  open(x) { if (x) { return '}'; } }\n  static of() { return `{`; }\n}\nfunction run() { return 1; }\nconst go = async (a) => { return a; };\n",
    "ios/A.swift": "import Foundation\nstruct Point {\n  func move() -> Int {\n    return 1\n  }\n  init(x: Int) { }\n}\nfunc top() { }\n",
}


def test_names_are_resolved_through_types_and_ancestors(spark):
    nodes, refs = code.extract(spark.createDataFrame(list(SOURCES.items()), "file string, source string"))
    ids = {r.id.split(":", 1)[1] for r in nodes.collect()}
    assert {"web/a.js:Box", "web/a.js:Box:open", "web/a.js:Box:of", "web/a.js:run", "web/a.js:go", "ios/A.swift:Point:move", "ios/A.swift:Point:init", "ios/A.swift:top", "app/tools.py:helper:inner"} <= ids and not any("No" in i for i in ids)
    edges = {(r.type, r.source.split(":", 1)[1], r.target.split(":", 1)[1]): r.line for r in code.resolve(nodes, refs).collect()}
    go = "app/core.py:Both:go"
    assert ("Inherits", "app/core.py:Both", "app/base.py:Right") in edges and ("Imports", "app/core.py", "app/tools.py") in edges and ("Imports", "app/core.py", "app/base.py") in edges
    assert {t for k, s, t in edges if k == "Calls" and s == go} == {"app/base.py:Root:ping", "app/base.py:Right:pong", "app/base.py:Left", "app/base.py:Right", "app/tools.py:helper"}
    assert edges["Calls", go, "app/base.py:Root:ping"] == 11
    jump = [(r.name, r.line) for r in refs.where("kind = 'imports'").where(F.col("source").endswith("a.js")).collect()]
    assert jump == [("web.b", 1), ("lib.c", 2)]


def test_ancestors_in_depth_first_order_and_cycles(spark):
    edges = spark.createDataFrame([("d", "b", 1), ("d", "c", 2), ("b", "a", 1), ("c", "a", 1), ("a", "d", 1)], "cls string, base string, place int")
    got = [r.ancestor for r in code.inheritance(edges).where("cls = 'd'").orderBy("path").collect()]
    assert got == ["d", "b", "a", "c"] and code.inheritance(edges.where("false")).count() == 0
