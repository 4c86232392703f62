"""Unified diffs, and which code elements a change touches.

A change is a row (change, diff).  It is read into flat tables: files, removed lines,
lines of inserted blocks.  Which elements it touches is decided by joins with the
spans of the old files: equality on change and file, lines compared inside.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidar.functions.text import kept_path

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
SPAN = "change string, id string, label string, file string, start int, end int, indent int"


def narrowest(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, line, id): the innermost span that holds a line, of equal ones the least id.

    An equality on the file and on a stretch of 64 lines carries the join, so that a
    file with very many lines and spans is spread over tasks; spans with a null end or
    a start behind their end hold nothing; lines in no span have no row.
    """
    cut = spans.where(F.col("start") <= F.col("end")).withColumn("cell__", F.explode(F.sequence(F.col("start").cast("bigint").bitwiseAND(F.lit(-64)), F.col("end").cast("bigint").bitwiseAND(F.lit(-64)), F.lit(64))))
    at = points.select("file", "line", F.col("line").cast("bigint").bitwiseAND(F.lit(-64)).alias("cell__"))
    inside = at.join(cut, ["file", "cell__"]).where((F.col("line") >= F.col("start")) & (F.col("line") <= F.col("end")))
    best = inside.groupBy("file", "line").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("width"), "id")).alias("x"))
    return best.select("file", "line", F.col("x.id").alias("id"))


def parse(text: str) -> list[dict]:
    """Changes per file of a unified diff: old and new path, removed lines, inserted blocks."""
    return [{k: f[k] for k in ("old", "new", "removed", "inserted")} for f in read(text)]


def read(text: str) -> list[dict]:
    """Changes per file of a unified diff: old and new path, removed lines, inserted blocks, hunks.

    Lines are of the old file; a block is (line before it, [(indentation, text)]),
    with -1 for the indentation of a blank line.  A path of /dev/null is None.  A
    hunk is (its text, the removed lines and blocks in it).
    """
    files: list[dict] = []
    current: dict | None = None
    old = 0
    block: list | None = None
    left = right = 0
    for line in (text or "").split("\n"):
        if left <= 0 and right <= 0:
            if line[:1] == "\\" and current is not None and current["hunks"]:
                current["hunks"][-1]["lines"].append(line)
                continue
            block = None
            if line.startswith("--- "):
                current = _file(_path(line[4:], "a/"), None)
            elif line.startswith("+++ ") and current is not None:
                current["new"] = _path(line[4:], "b/")
                files.append(current)
            elif line.startswith("rename from "):
                files.append(_file(line[12:], None))
            elif line.startswith("rename to ") and files:
                files[-1]["new"] = line[10:]
            elif (m := _HUNK.match(line)) and current is not None:
                old = int(m.group(1)) + (m.group(2) == "0")
                left, right = int(m.group(2) or 1), int(m.group(4) or 1)
                current["hunks"].append({"lines": [line], "removed": [], "inserted": []})
            continue
        hunk = current["hunks"][-1]
        hunk["lines"].append(line)
        mark, body = line[:1], line[1:]
        if mark == "-":
            for x in (current, hunk):
                x["removed"].append(old)
            old, left, block = old + 1, left - 1, None
        elif mark == "+":
            if block is None:
                block = []
                for x in (current, hunk):
                    x["inserted"].append((old - 1, block))
            block.append((-1 if not body.strip() else len(body) - len(body.lstrip(" \t")), body))
            right -= 1
        elif mark != "\\":
            old, left, right, block = old + 1, left - 1, right - 1, None
    return [f for f in files if f["removed"] or f["inserted"] or not any(g is not f and g["old"] == f["old"] for g in files)]


def _file(old: str | None, new: str | None) -> dict:
    return {"old": old, "new": new, "removed": [], "inserted": [], "hunks": []}


def _path(text: str, prefix: str) -> str | None:
    name = text.split("\t")[0].strip().strip('"')
    return None if name == "/dev/null" else name.removeprefix(prefix)


LINE = "change string, file string, new string, kind string, block int, i int, line int, indent int, text string"


def lines(changes: DataFrame) -> DataFrame:
    """The rows of changes (change, diff): change, file (old path, of an added file the new one), new, kind and what belongs to it.

    Kinds: ``file`` for each file there, ``added`` for one that is new, ``removed``
    with the line, ``inserted`` with the number of its block, its place in it, the
    line before the block, its indentation (-1 for blank) and text.  A null or empty
    diff has no rows.
    """

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for change, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in read(text):
                    if f["old"] is None:
                        out.append((change, f["new"], f["new"], "added", None, None, None, None, None))
                        continue
                    out.append((change, f["old"], f["new"], "file", None, None, None, None, None))
                    out += _rows(change, f)
            columns = list(zip(*out)) or [()] * 9
            kinds = [pa.string()] * 4 + [pa.int32()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in LINE.split(", ")])

    return changes.select("change", "diff").mapInArrow(run, LINE)


def _rows(change: str, part: dict, file: str | None = None, new: str | None = None) -> list[tuple]:
    file, new = file or part["old"], new or part.get("new")
    out = [(change, file, new, "removed", None, None, at, None, None) for at in part["removed"]]
    for b, (before, own) in enumerate(part["inserted"]):
        out += [(change, file, new, "inserted", b, i, before, indent, text) for i, (indent, text) in enumerate(own)]
    return out


def hunks(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hunks of changes (change, diff), and their lines as ``lines`` gives them.

    The first table is (change, file, new, k, text), k counting the hunks of a file
    from 0; added files and hunks that change comments and blank lines only are left
    out.  In the second ``change`` is ``hunk_id`` of the hunk.
    """

    def run(which):
        def inner(batches):
            for batch in batches:
                out: list[tuple] = []
                for change, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for f in read(text):
                        if f["old"] is None or f["new"] is None:
                            continue
                        for k, h in enumerate(f["hunks"]):
                            changed = [x[1:].strip() for x in h["lines"][1:] if x[:1] in "+-"]
                            if all(not x or x.startswith("#") for x in changed):
                                continue
                            if which == 0:
                                out.append((change, f["old"], f["new"], k, "\n".join(h["lines"])))
                            else:
                                me = f"{change}|{f['new']}|{k}"
                                out.append((me, f["old"], f["new"], "file", None, None, None, None, None))
                                out += _rows(me, h, f["old"], f["new"])
                if which == 0:
                    columns = list(zip(*out)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 3 + [pa.int32(), pa.string()])], ["change", "file", "new", "k", "text"])
                else:
                    columns = list(zip(*out)) or [()] * 9
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 4 + [pa.int32()] * 4 + [pa.string()])], [x.split()[0] for x in LINE.split(", ")])

        return inner

    rows = changes.select("change", "diff")
    return rows.mapInArrow(run(0), "change string, file string, new string, k int, text string"), rows.mapInArrow(run(1), LINE)


def hunk_id(change, new, k):
    """The name of a hunk as a Column."""
    return F.concat(change, F.lit("|"), new, F.lit("|"), k.cast("string"))


def least_indents(lines: DataFrame) -> DataFrame:
    """Adds ``least``: the least indentation so far in a block, blank lines (indent -1) left out.

    ``lines`` has (block, i, indent), and may have change and file.
    """
    filled = F.when(F.col("indent") >= 0, F.col("indent"))
    keys = [c for c in ("change", "file", "block") if c in lines.columns]
    return lines.withColumn("least", F.min(filled).over(Window.partitionBy(*keys).orderBy("i")))


def only_decorators_follow(lines: DataFrame) -> DataFrame:
    """Adds ``open``: whether from a line on a block has only decorators and blank lines; ``lines`` has (block, i, text)."""
    fine = F.trim("text").rlike("^(?:@.*)?$").cast("int")
    keys = [c for c in ("change", "file", "block") if c in lines.columns]
    return lines.withColumn("open", F.min(fine).over(Window.partitionBy(*keys).orderBy("i").rowsBetween(0, Window.unboundedFollowing)) == 1)


def touched(changes: DataFrame, spans: DataFrame) -> DataFrame:
    """(change, id): elements of the old file with a removed line or an insertion inside.

    ``changes`` has (change, file, line); of nested elements the innermost is
    touched; a line in no element touches the file's module, whose id is null here.
    """
    points = changes.select("file", "line").distinct()
    at = narrowest(points, spans)
    return changes.join(at, ["file", "line"], "left").select("change", "file", "id").distinct()


def oracle(changed: DataFrame, spans: DataFrame) -> DataFrame:
    """(change, file, id, module): the elements each change touches, from ``lines`` and the spans of the old files.

    ``spans`` has (change, id, label, file, start, end, indent): start is the first
    decorator's line.  A removed line touches the innermost element that holds it.
    An inserted line touches the innermost of: elements whose body goes on on both
    sides; elements that end just before its block, if every line of the block so far
    is indented deeper than they are; an element that begins just behind the block, if
    the line is a decorator at its depth and only decorators follow.  A blank line
    counts only inside a function.  A file whose changes touch nothing has one row with
    ``module`` true and a null id.  Only Python files are looked at; added files have
    no row.
    """
    own = changed.where(F.col("file").endswith(".py"))
    there = spans.where((F.col("label") != "Module") & F.col("start").isNotNull() & F.col("end").isNotNull()).select("change", "file", "id", "label", "start", "end", F.col("indent").alias("depth"))
    removed = own.where("kind = 'removed'").select("change", "file", "line").join(there, ["change", "file"]).where("start <= line and line <= end")
    removed = removed.select("change", "file", F.lit(-1).alias("block"), F.col("line").alias("i"), "id", "start", "end")
    added = own.where("kind = 'inserted'").select("change", "file", "block", "i", "line", "indent", "text")
    told = only_decorators_follow(least_indents(added))
    blank = F.col("indent") < 0
    inside = (F.col("start") <= F.col("line")) & (F.col("line") + 1 <= F.col("end")) & (~blank | (F.col("label") == "Function"))
    tail = ~blank & (F.col("end") == F.col("line")) & (F.col("least") > F.col("depth"))
    head = ~blank & (F.col("start") == F.col("line") + 1) & F.ltrim("text").startswith("@") & F.col("open") & (F.col("indent") == F.col("depth"))
    joined = told.join(there, ["change", "file"]).where(inside | tail | head).select("change", "file", "block", "i", "id", "start", "end")
    best = removed.unionByName(joined).groupBy("change", "file", "block", "i").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("width"), "id")).alias("x"))
    hit = best.select("change", "file", F.col("x.id").alias("id")).distinct()
    files = own.where("kind in ('removed', 'inserted')").select("change", "file").distinct()
    rest = files.join(hit.select("change", "file").distinct(), ["change", "file"], "left_anti")
    return hit.withColumn("module", F.lit(False)).unionByName(rest.select("change", "file", F.lit(None).cast("string").alias("id"), F.lit(True).alias("module")))


def renames(changed: DataFrame) -> DataFrame:
    """(change, file, new): files that a change gave another name."""
    return changed.where("kind = 'file' and new is not null and new <> file").select("change", "file", "new").distinct()


def added_files(changed: DataFrame) -> DataFrame:
    """(change, file): new Python files."""
    return changed.where(F.col("kind") == "added").where(F.col("file").endswith(".py")).select("change", "file").distinct()


def gold_files(changes: DataFrame) -> DataFrame:
    """(change, file): old paths of the Python files that a patch changes, new files left out."""
    return lines(changes).where("kind = 'file'").where(F.col("file").endswith(".py")).select("change", "file").distinct()


def unreachable(changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(change, file): changed Python files of which the graph knows nothing."""
    own = changed.where("kind = 'file'").where(F.col("file").endswith(".py")).select("change", "file").distinct()
    return own.join(nodes.select("file").distinct(), "file", "left_anti").select("change", "file")


def touch_sets(changed: DataFrame, spans: DataFrame) -> DataFrame:
    """(change, touch, touch_mod): ids of the functions and classes each change touches, under the files' new names, and files changed outside of all.

    Files that the graph leaves out (tests, documentation, examples) count for nothing;
    every change of ``changed`` has a row.
    """
    kept = changed.where(kept_path(F.col("file")))
    found = oracle(kept, spans)
    moved = found.where("not module").join(renames(kept), ["change", "file"], "left")
    key = F.concat(F.coalesce("new", "file"), F.expr("substring(id, length(file) + 1)"))
    touch = moved.select("change", key.alias("key")).groupBy("change").agg(F.sort_array(F.collect_set("key")).alias("touch"))
    points = kept.where("kind = 'removed' or (kind = 'inserted' and i = 0)").where(F.col("file").endswith(".py")).select("change", "file", "line").distinct()
    first = F.coalesce("defined", "start") if "defined" in spans.columns else F.col("start")
    there = spans.where((F.col("label") != "Module") & F.col("start").isNotNull()).select("change", "file", first.alias("start"), "end")
    held = points.join(there, ["change", "file"]).where("start <= line and line <= end").select("change", "file", "line").distinct()
    outside = points.join(held, ["change", "file", "line"], "left_anti").groupBy("change").agg(F.sort_array(F.collect_set("file")).alias("touch_mod"))
    none = F.array().cast("array<string>")
    rows = changed.select("change").distinct().join(touch, "change", "left").join(outside, "change", "left")
    return rows.select("change", F.coalesce("touch", none).alias("touch"), F.coalesce("touch_mod", none).alias("touch_mod"))


def hunk_index(changes: DataFrame, spans: DataFrame) -> DataFrame:
    """(u, f, k, ids, text): hunks of changes with the functions and classes each touches, under the file's new name.

    Hunks in files the graph leaves out and hunks of comments only have no row; one
    that touches no element has an empty list.
    """
    texts, inner = hunks(changes)
    kept = texts.where(F.col("file").endswith(".py") & kept_path(F.col("file")))
    # every hunk is a change of its own against the spans of its file
    named = kept.select(hunk_id(F.col("change"), F.col("new"), F.col("k")).alias("me"), F.col("change").alias("of"), "file")
    own = named.join(spans.withColumnRenamed("change", "of"), ["of", "file"]).select(F.col("me").alias("change"), "id", "label", "file", "start", "end", "indent")
    found = oracle(inner.where(kept_path(F.col("file"))), own).where("not module").select(F.col("change").alias("me"), "id").groupBy("me").agg(F.collect_set("id").alias("old"))
    rows = kept.withColumn("me", hunk_id(F.col("change"), F.col("new"), F.col("k"))).join(found, "me", "left")
    ids = F.sort_array(F.transform(F.coalesce("old", F.array().cast("array<string>")), lambda x: F.concat(F.col("new"), F.substring(x, F.length("file") + 1, F.length(x)))))
    return rows.select(F.col("change").alias("u"), F.col("new").alias("f"), "k", ids.alias("ids"), "text")
