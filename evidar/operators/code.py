"""Sources to graph: elements, imports, calls and base classes, and their resolution by joins.

A file is read once, by the reader its ending is registered for (``READERS``), into
element rows and reference rows; both are kept in one stored table.  Names are then
resolved between files by joins alone.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidar.functions.text import module_name
from evidar.operators.braces import read_javascript, read_swift
from evidar.tables import durable, stored

#: fixed values: calls of these names are the language's own
BUILT_IN = frozenset("print len range str int float list dict set tuple super isinstance type open enumerate zip map filter sorted repr bool getattr setattr hasattr iter next min max sum any all abs".split())
NODE = ("id", "label", "name", "file", "start_line", "end_line", "defined", "indent")
REF = ("source", "kind", "name", "via", "line")


def read_python(path: str, text: str, module: str) -> tuple[list[tuple], list[tuple]]:
    """Elements (NODE) and references (REF) of a Python file; one that doesn't parse gives its module only.

    ``start_line`` is that of the first decorator, ``defined`` that of the definition.
    Kinds of references: defines (name is an id), imports (dotted; via is the local
    name), inherits, calls by name, ``self`` calls, ``typed`` calls (via is the class
    the receiver is known to be of) and ``attr`` calls (via is the receiver's name).
    Types come from annotations and from assignments of constructor calls, of local
    names and of the attributes of self.
    """
    nodes: list[tuple] = [(module, "Module", path, path, 1, text.count("\n") + 1, None, None)]
    refs: list[tuple] = []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return nodes, refs
    package = path.split("/")[:-1]

    def visit(body: list, owner: str, inside: str, attributes: dict[str, str], known: dict[str, str]) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "Class" if isinstance(node, ast.ClassDef) else "Function"
                # a class is named by its file alone, a function by all that encloses it
                me = f"{module}:{node.name}" if kind == "Class" else f"{owner}:{node.name}"
                start = min([node.lineno, *[d.lineno for d in node.decorator_list]])
                nodes.append((me, kind, node.name, path, start, node.end_lineno, node.lineno, node.col_offset))
                refs.append((owner, "defines", me, None, node.lineno))
                if kind == "Class":
                    refs.extend((me, "inherits", base, None, node.lineno) for base in map(_last, node.bases) if base)
                    visit(node.body, me, me, _attributes(node), {})
                else:
                    visit(node.body, me, inside, attributes, {**known, **_locals(node)})
                continue
            for inner in _outside(node):
                _reference(inner, owner, refs, package, attributes, known)

    visit(tree.body, module, "", {}, _locals(tree))
    return nodes, list(dict.fromkeys(refs))


def _outside(node: ast.AST):
    """A statement and what is in it, without the bodies of definitions."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(c for c in ast.iter_child_nodes(x) if not isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)))


def _last(node: ast.AST | None) -> str | None:
    """The name of a class as it is written in bases and annotations: its last part, without brackets or quotes."""
    if isinstance(node, ast.Subscript):
        if _last(node.value) in ("Optional", "Final", "ClassVar", "Annotated"):
            inner = node.slice.elts[0] if isinstance(node.slice, ast.Tuple) else node.slice
            return _last(inner)
        return _last(node.value)
    if isinstance(node, ast.BinOp):  # X | None
        return _last(node.left)
    if isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value.isidentifier():
        return node.value
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def _made(node: ast.AST | None) -> str | None:
    """The class a value was made of, by the habit of capital letters."""
    name = _last(node.func) if isinstance(node, ast.Call) else None
    return name if name and name[:1].isupper() else None


def _types(statements, target) -> dict[str, str]:
    found: dict[str, str] = {}
    for x in statements:
        if isinstance(x, ast.Assign):
            for t in x.targets:
                if (name := target(t)) and (made := _made(x.value)):
                    found.setdefault(name, made)
        elif isinstance(x, ast.AnnAssign) and (name := target(x.target)) and (made := _last(x.annotation)):
            found.setdefault(name, made)
    return found


def _locals(node: ast.AST) -> dict[str, str]:
    """Classes of the parameters and local names of a function or module."""
    found: dict[str, str] = {}
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            if made := _last(a.annotation):
                found[a.arg] = made
    inner = (x for s in node.body for x in _outside(s))
    return {**_types(inner, lambda t: t.id if isinstance(t, ast.Name) else None), **found}


def _attributes(node: ast.ClassDef) -> dict[str, str]:
    """Classes of the attributes of a class, from its body and from what its methods assign to self."""
    own = lambda t: t.attr if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self" else t.id if isinstance(t, ast.Name) and t in names else None
    names = {x.target for x in node.body if isinstance(x, ast.AnnAssign)} | {t for x in node.body if isinstance(x, ast.Assign) for t in x.targets}
    inner = [x for s in node.body for x in ([s] if not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)) else [y for z in s.body for y in _outside(z)])]
    return _types(inner, own)


def _reference(node: ast.AST, owner: str, refs: list[tuple], package: list[str], attributes: dict[str, str], known: dict[str, str]) -> None:
    if isinstance(node, ast.Import):
        refs.extend((owner, "imports", a.name, a.asname or a.name.split(".")[0], node.lineno) for a in node.names)
    elif isinstance(node, ast.ImportFrom):
        base = package[: len(package) - node.level + 1] if node.level else []
        name = ".".join([*base, *([node.module] if node.module else [])])
        refs.append((owner, "imports", name, None, node.lineno))
        refs.extend((owner, "imports", f"{name}.{a.name}".lstrip("."), a.asname or a.name, node.lineno) for a in node.names if a.name != "*")
    elif isinstance(node, ast.Call):
        f = node.func
        if isinstance(f, ast.Name) and f.id not in BUILT_IN:
            refs.append((owner, "calls", f.id, None, node.lineno))
        elif isinstance(f, ast.Attribute):
            on = f.value
            if isinstance(on, ast.Name) and on.id in ("self", "cls"):
                refs.append((owner, "self", f.attr, None, node.lineno))
            elif isinstance(on, ast.Attribute) and isinstance(on.value, ast.Name) and on.value.id == "self" and on.attr in attributes:
                refs.append((owner, "typed", f.attr, attributes[on.attr], node.lineno))
            elif isinstance(on, ast.Name) and on.id in known:
                refs.append((owner, "typed", f.attr, known[on.id], node.lineno))
            elif made := _made(on):
                refs.append((owner, "typed", f.attr, made, node.lineno))
            else:
                refs.append((owner, "attr", f.attr, on.id if isinstance(on, ast.Name) else None, node.lineno))


#: which reader reads which ending; more may be put in
READERS: dict[str, Callable[[str, str, str], tuple[list[tuple], list[tuple]]]] = {".py": read_python, ".js": read_javascript, ".swift": read_swift}


def parse(path: str, text: str, prefix: str = "local") -> tuple[list[tuple], list[tuple]]:
    """Elements and references of a file, by the reader of its ending; without one its module only."""
    module = f"{prefix}:{path}"
    dot = path.rfind(".")
    reader = READERS.get(path[dot:]) if dot >= 0 else None
    return reader(path, text, module) if reader else ([(module, "Module", path, path, 1, text.count("\n") + 1, None, None)], [])


def _read(rows: DataFrame, prefix: str, extra: str | None = None) -> DataFrame:
    """Elements and references of files (file, source) in one table, read in one pass; ``what`` tells them apart."""

    def run(batches):
        import warnings

        warnings.simplefilter("ignore", SyntaxWarning)
        for batch in batches:
            out: list[tuple] = []
            for more, f, s in zip(*(c.to_pylist() for c in batch.columns)):
                nodes, refs = parse(f, s, prefix)
                out += [(more, "node", *n, None, None, None, None) for n in nodes]
                out += [(more, "ref", None, None, name, f, None, None, None, None, source, kind, via, line) for source, kind, name, via, line in refs]
            columns = list(zip(*out)) or [()] * 14
            kinds = [pa.string()] * 6 + [pa.int32()] * 4 + [pa.string()] * 3 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["more", "what", *NODE, "source", "kind", "via", "line"])

    ready = rows.where("source is not null and file is not null").select((F.col(extra) if extra else F.lit(None).cast("string")).alias("more"), "file", "source")
    return ready.mapInArrow(run, "more string, what string, id string, label string, name string, file string, start_line int, end_line int, defined int, indent int, source string, kind string, via string, line int")


def extract(files: DataFrame, prefix: str = "local") -> tuple[DataFrame, DataFrame]:
    """Elements and references of files (file, source); null sources give none, every file is read once."""
    both = stored(_read(files, prefix))
    return both.where("what = 'node'").select("id", "label", "name", "file", "start_line", "end_line"), both.where("what = 'ref'").select("source", "kind", "name", "via", "line")


def spans_at(wanted: DataFrame, repository: str) -> DataFrame:
    """(change, id, label, file, start, end, defined, indent): elements of the files (change, commit, file) at their commits, ids without a prefix."""
    from evidar.sources import gitlog

    texts = gitlog.blobs(wanted, repository)
    found = _read(texts.where("source is not null"), "x", extra="commit").where("what = 'node'")
    return wanted.join(found.withColumnRenamed("more", "commit"), ["commit", "file"]).select("change", F.regexp_replace("id", "^[^:]*:", "").alias("id"), "label", "file", F.col("start_line").alias("start"), F.col("end_line").alias("end"), "defined", "indent")


def _module_of(name: str) -> Column:
    return F.regexp_extract(name, "^[^:]*:[^:]*", 0)


def inheritance(bases: DataFrame, depth: int = 20) -> DataFrame:
    """(cls, ancestor, path): what a class inherits from, over edges (cls, base, place), itself first.

    ``path`` sorts ancestors as a walk in depth first would meet them; a class met
    again on its own path ends it.
    """
    step = durable(bases.select("cls", "base", F.lpad(F.col("place").cast("string"), 4, "0").alias("place")).distinct())
    everyone = step.select("cls").unionByName(step.select(F.col("base").alias("cls"))).distinct()
    reached = frontier = durable(everyone.select("cls", F.col("cls").alias("ancestor"), F.lit("").alias("path")))
    for _ in range(depth):
        up = frontier.join(step.select(F.col("cls").alias("ancestor"), "base", "place"), "ancestor").where("base <> cls")
        found = up.select("cls", F.col("base").alias("ancestor"), F.concat("path", F.lit("/"), "place").alias("path")).groupBy("cls", "ancestor").agg(F.min("path").alias("path"))
        frontier = durable(found.join(reached.select("cls", "ancestor"), ["cls", "ancestor"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = durable(reached.unionByName(frontier))
    return reached.groupBy("cls", "ancestor").agg(F.min("path").alias("path"))


def resolve(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(type, source, target, line): references as edges.

    Imports go to the module of that dotted name, or of the name without its last
    part.  A base class or the class of a receiver is the one of that name in the same
    file, else the one imported under it, else the only one of that name.  A call on
    self or on a receiver of a known class goes to the method of the class, else of the
    first ancestor that has it.  A plain call goes to an element of the same file, else
    to what is imported under the name, else to the only element of that name; so does
    an attribute call, without the first.  What stays ambiguous is dropped, and so are
    edges to itself.  The first line of an edge is kept.
    """
    modules = nodes.where("label = 'Module'").select(F.col("id").alias("target"), module_name(F.col("file")).alias("name"))
    wanted = refs.where("kind = 'imports'").select(_module_of("source").alias("at"), "name", F.regexp_replace("name", r"\.[^.]*$", "").alias("outer"), "via", "line")
    direct = wanted.join(modules, "name").select("at", "target", "line")
    member = wanted.join(modules.withColumnRenamed("name", "outer"), "outer").select("at", "target", "line")
    imports = direct.unionByName(member).select(F.lit("Imports").alias("type"), F.col("at").alias("source"), "target", "line")
    # local name -> element it was imported as
    inner = nodes.where("label <> 'Module'").select(F.col("id").alias("target"), "label", F.col("name").alias("last"), _module_of("id").alias("module"), F.regexp_replace("id", ":[^:]*$", "").alias("owner"))
    bound = wanted.where("via is not null").join(modules.withColumnRenamed("name", "outer").withColumnRenamed("target", "module"), "outer")
    bound = bound.select("at", "via", "module", F.element_at(F.split("name", r"\."), -1).alias("last")).join(inner.where("owner = module").select("module", "last", "target", "label"), ["module", "last"]).groupBy("at", "via", "label").agg(F.min("target").alias("target"))

    def named(rows: DataFrame, key: str, classes: bool) -> DataFrame:
        """Adds ``target``: the element a name stands for in a file (at)."""
        pool = inner.where("label = 'Class'") if classes else inner.where("owner = module")
        names = durable(rows.select("at", F.col(key).alias("last")).where("last is not null").distinct())
        here = names.join(pool.select(F.col("module").alias("at"), "last", "target"), ["at", "last"]).select("at", "last", "target", F.lit(0).alias("near"))
        brought = names.join(bound.where("label = 'Class'" if classes else "true").select("at", F.col("via").alias("last"), "target"), ["at", "last"]).select("at", "last", "target", F.lit(1).alias("near"))
        only = names.join(inner.where("label = 'Class'" if classes else "true").groupBy("last").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target")).where("n = 1"), "last").select("at", "last", "target", F.lit(2).alias("near"))
        first = here.unionByName(brought).unionByName(only).groupBy("at", "last", "near").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"))
        best = first.groupBy("at", "last").agg(F.min(F.struct("near", "n", "target")).alias("x")).where("x.n = 1")
        return best.select("at", F.col("last").alias(key), F.col("x.target").alias("target"), F.col("x.near").alias("near"))

    every = refs.withColumn("at", _module_of("source")).withColumn("cls", F.regexp_replace("source", ":[^:]*$", ""))
    bases = every.where("kind = 'inherits'")
    bases = bases.join(named(bases, "name", True), ["at", "name"]).select("source", "target", "line")
    steps = bases.select(F.col("source").alias("cls"), F.col("target").alias("base"), F.col("line").alias("place"))
    classes = inner.where("label = 'Class'").select(F.col("target").alias("cls"))
    chain = inheritance(steps)
    chain = chain.unionByName(classes.join(chain.select("cls").distinct(), "cls", "left_anti").select("cls", F.col("cls").alias("ancestor"), F.lit("").alias("path")))
    methods = inner.where("label = 'Function'").select(F.col("owner").alias("ancestor"), F.col("last").alias("name"), "target")
    typed = every.where("kind = 'typed'")
    of_class = typed.join(named(typed, "via", True).select("at", "via", F.col("target").alias("of")), ["at", "via"]).select("source", "name", "of", "line")
    own = every.where("kind = 'self'").select("source", "name", F.col("cls").alias("of"), "line")
    met = of_class.unionByName(own).join(chain.withColumnRenamed("cls", "of"), "of").join(methods, ["ancestor", "name"])
    met = met.groupBy("source", "name", "of", "line").agg(F.min(F.struct("path", "target")).alias("x")).select("source", F.col("x.target").alias("target"), "line")
    plain = every.where("kind = 'calls'")
    plain = plain.join(named(plain, "name", False), ["at", "name"]).select("source", "target", "line")
    loose = every.where("kind = 'attr'")
    loose = loose.join(named(loose, "name", False).where("near = 2"), ["at", "name"]).select("source", "target", "line")
    calls = met.unionByName(plain).unionByName(loose)
    defines = refs.where("kind = 'defines'").select(F.lit("Defines").alias("type"), "source", F.col("name").alias("target"), "line")
    both = imports.unionByName(defines).unionByName(calls.select(F.lit("Calls").alias("type"), "source", "target", "line")).unionByName(bases.select(F.lit("Inherits").alias("type"), "source", "target", "line"))
    return both.where("source <> target").groupBy("type", "source", "target").agg(F.min("line").alias("line"))
