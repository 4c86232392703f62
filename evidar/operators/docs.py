"""Documentation: passages by heading, and the code elements that passages name."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: characters a passage has at most, unless one paragraph is longer
LIMIT = 1600
_RULE = re.compile(r"^([=\-~^\"'`#*+.:_])\1{2,}\s*$")
_MARK = re.compile(r"^#{1,6}\s+(.*?)\s*#*\s*$")
_ROLE = re.compile(r":(?:\w+:)?(?:func|meth|class|mod|attr|obj|exc|data):`([^`]+)`")
_DIRECTIVE = re.compile(r"^\s*\.\. (?:\w+:)?(?:auto)?(?:function|method|class|module|classmethod|staticmethod|attribute|exception):: *([\w.]+)", re.M)
_MODULE = re.compile(r"^\s*\.\. (?:\w+:)?(?:current)?module:: *(\S+)", re.M)
_TICKED = re.compile(r"``([\w.]+(?:\(\))?)``")


def passages(text: str, limit: int = LIMIT) -> list[tuple[str, str]]:
    """(heading, text) of each passage: split at headings, long bodies at blank lines."""
    lines = text.replace("\r\n", "\n").split("\n")
    parts: list[tuple[str, list[str]]] = [("", [])]
    i = 0
    while i < len(lines):
        line = lines[i]
        if m := _MARK.match(line):
            parts.append((m.group(1), []))
        elif line.strip() and not _RULE.match(line) and i + 1 < len(lines) and _RULE.match(lines[i + 1]) and len(lines[i + 1].strip()) >= len(line.strip()):
            parts.append((line.strip(), []))
            i += 1
        else:
            parts[-1][1].append(line)
        i += 1
    out = []
    for heading, body in parts:
        whole = "\n".join(body).strip("\n")
        if not whole.strip():
            continue
        current = ""
        for block in re.split(r"\n\s*\n", whole):
            if current and len(current) + len(block) + 2 > limit:
                out.append((heading, current))
                current = block
            else:
                current = f"{current}\n\n{block}" if current else block
        out.append((heading, current))
    return out


def chunk_files(files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id, file, heading, idx, text) of files (file, text); null texts and files without text give none."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, (heading, body) in enumerate(passages(text, limit)):
                    for c, v in zip(cols, (f"chunk:{file}:{i}", file, heading, i, body)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())], ["id", "file", "heading", "idx", "text"])

    return files.where("text is not null").select("file", "text").mapInArrow(run, "id string, file string, heading string, idx int, text string")


def mentions(text: str, module: str = "") -> tuple[list[list[str]], str]:
    """Names in a passage, each as the list of forms to try in order, and the module set at its end."""
    out = []
    events = sorted([(m.start(), 0, m.group(1)) for m in _MODULE.finditer(text)] + [(m.start(), 1, m.group(1)) for p in (_ROLE, _DIRECTIVE, _TICKED) for m in p.finditer(text)])
    for _, kind, name in events:
        if kind == 0:
            module = name
            continue
        inner = re.search(r"<([^>]+)>\s*$", name)
        clean = (inner.group(1) if inner else name).strip().lstrip("~.").removesuffix("()")
        if clean:
            out.append([f"{module}.{clean}", clean] if module else [clean])
    return out, module


def name_index(nodes: DataFrame) -> DataFrame:
    """(name, target): every way to write an element: full dotted name, class and member, and last part."""
    from evidar.functions.text import module_name, qualified

    full = F.concat_ws(".", module_name(F.col("file")), qualified(F.col("id")))
    rows = nodes.where("label <> 'Module' and file is not null").select(F.col("id").alias("target"), F.explode(F.array(full, qualified(F.col("id")), F.element_at(F.split("id", ":"), -1))).alias("name"))
    return rows.select("name", "target").distinct()


def carried_modules(chunks: DataFrame) -> DataFrame:
    """(id, module): the module that an earlier passage of the same file has set last; null without one.

    Only names go through the window; rows without a file or place carry nothing.
    """
    named = F.regexp_extract_all("text", F.lit("(?m)" + _MODULE.pattern), 1)
    rows = chunks.where("id is not null").select("id", "file", "idx", F.when(F.size(named) > 0, F.element_at(named, -1)).alias("set")).distinct()
    before = Window.partitionBy("file").orderBy("idx", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.where("file is not null and idx is not null").select("id", F.last("set", True).over(before).alias("module"))
    return placed.groupBy("id").agg(F.max("module").alias("module"))


def resolve(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chunk, target): the element each name stands for; the first form that any element has decides, and only if one element has it.

    Where passages have a file and a place in it (idx), a module set in one holds in
    those that follow.
    """

    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for chunk, text, module in zip(*(c.to_pylist() for c in batch.columns)):
                for k, forms in enumerate(mentions(text, module or "")[0]):
                    for order, form in enumerate(forms):
                        for c, v in zip(rows, (chunk, k, order, form)):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.string())], ["chunk", "k", "order", "name"])

    texts = chunks.where("text is not null").select("id", "text").distinct()
    known = carried_modules(chunks) if {"file", "idx"} <= set(chunks.columns) else None
    texts = texts.withColumn("module", F.lit(None).cast("string")) if known is None else texts.join(known, "id", "left")
    tries = texts.select("id", "text", "module").mapInArrow(run, "chunk string, k int, order int, name string")
    index = name_index(nodes).groupBy("name").agg(F.count("*").alias("targets"), F.min("target").alias("target"))
    first = tries.join(index, "name").groupBy("chunk", "k").agg(F.min(F.struct("order", "targets", "target")).alias("x"))
    return first.where("x.targets = 1").select("chunk", F.col("x.target").alias("target")).distinct()


def references(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(chunk, file): documents that passages (id, file, text) refer to by :doc:, of ``files`` (file).

    A path is looked up beside the passage's own file, or from the top of the
    documentation if it begins with a slash; with the endings of documents in their
    order, then as it stands; the first that is there counts.
    """
    role = r":doc:`(?:[^`<]*<([^>`]+)>|([^`<]+))`"
    found = chunks.where("text is not null and file is not null").select("id", "file", F.explode(F.regexp_extract_all("text", F.lit(role), 0)).alias("x")).distinct()
    path = F.trim(F.coalesce(F.nullif(F.regexp_extract("x", role, 1), F.lit("")), F.regexp_extract("x", role, 2)))
    rows = found.withColumn("path", path)
    top = F.regexp_extract("file", "^([^/]+)/", 1)
    own = F.regexp_replace("file", "/?[^/]*$", "")
    base = F.when(F.col("path").startswith("/"), top).otherwise(own)
    full = F.concat_ws("/", F.filter(F.array(base, F.regexp_replace("path", "^/+", "")), lambda p: p != ""))
    tries = F.array(*[F.struct(F.lit(i).alias("order"), _normal(F.concat(full, F.lit(s))).alias("other")) for i, s in enumerate((".rst", ".md", ".txt", ""))])
    each = rows.select("id", "path", F.explode(tries).alias("t")).select("id", "path", "t.order", "t.other")
    hit = each.join(files.select(F.col("file").alias("other")).distinct(), "other").groupBy("id", "path").agg(F.min(F.struct("order", "other")).alias("x"))
    return hit.select(F.col("id").alias("chunk"), F.col("x.other").alias("file")).distinct()


def _normal(path):
    """A path without . and .. parts."""
    step = lambda done, p: F.when((p == "") | (p == "."), done).when((p == "..") & (F.size(done) > 0), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
