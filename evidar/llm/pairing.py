"""Functions paired with their documentation (problem 7).

Recursive patterns of the ``regex`` library capture the comment above, the
signature with its balanced brackets and the body in one match; strings and
comments inside are protected, so that brackets in them don't count.  Captures
that say nothing are filtered out.  Entries of documentation chunks that name a
function exactly, and are followed by a description, are joined by its dotted
name.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.tables import durable, spread, stored

from .grammars import SUFFIX, parses
from .syntax import claimed, valid

_DEFINE = r"""(?(DEFINE)
(?<pystr>[rRbBuUfF]{0,2}(?:\"\"\"(?:[^\\"]|\\.|"(?!""))*+\"\"\"|'''(?:[^\\']|\\.|'(?!''))*+'''|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'))
(?<cstr>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`)
(?<ccom>//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)
(?<pyround>\((?:[^()"'\#]|(?&pystr)|["']|\#[^\n]*+|(?&pyround))*+\))
(?<round>\((?:[^()"'`/]|(?&cstr)|(?&ccom)|["'`/]|(?&round))*+\))
(?<curly>\{(?:[^{}"'`/]|(?&cstr)|(?&ccom)|["'`/]|(?&curly))*+\})
)"""
_PYTHON = regex.compile(
    _DEFINE + r"""\s*+(?P<above>(?:[ \t]*+\#[^\n]*+\n\s*+)*+)(?:@[\w.]++[ \t]*+(?&pyround)?+[^\n]*+\n\s*+)*+(?P<between>(?:\#[^\n]*+\n\s*+)*+)
(?P<signature>(?:async\s++)?+def\s++\w++\s*+(?:\[[^\]]*+\])?+\s*+(?&pyround)[^:\n]*+:)
(?:[ \t]*+\#[^\n]*+)?+\s*+(?P<doc>[rRuU]?+(?:\"\"\"(?:[^\\"]|\\.|"(?!""))*+\"\"\"|'''(?:[^\\']|\\.|'(?!''))*+'''|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')[ \t]*+(?=[\n;\#]|\Z))?+(?P<body>.*+)""",
    regex.S | regex.X,
)
_BRACED = regex.compile(
    _DEFINE + r"""\s*+(?P<above>(?:(?:/\*(?:[^*]|\*(?!/))*+\*/|//[^\n]*+)\s*+)*+)(?:@\w++(?&round)?+\s++)*+
(?P<signature>[^{}()"'`/]*+(?&round)?+[^{}"'`/]*?)(?:=>\s*+)?+(?P<body>(?&curly)|\S.*+)""",
    regex.S | regex.X,
)

# fixed values: stand-ins, remarks for tools
_STAND_IN = re.compile(
    r"(?i)(?:to-?do|fixme|xxx|hack|wip|tbd|tba|n/?a|none|null|nil|nothing|undocumented|documentation|docstring|description|placeholder|function|method|see above|see below|same as above|ditto|lorem ipsum"
    r"|foo|bar|test|to be (?:done|documented|written)|no description|missing|comment|summary|add (?:a )?(?:docs?|description)(?: here)?|document (?:me|this)|write (?:me|this|docs?)|helper|self[- ]explanatory)"
    r"(?:\W+(?:document(?: this| me)?|docs?|describe|write(?: docs?)?|comment|later|this|here|me|fixme|todo))*\W*\Z"
)
_TOOLS = re.compile(
    r"(?i)(?:noqa\b|type:\s*ignore|pylint\b|pragma\b|mypy\b|flake8\b|isort\b|fmt:|yapf\b|nosec\b|ruff:|pyright\b|eslint|jshint|jslint|prettier-|istanbul|c8 ignore|v8 ignore|ts-|@ts-|swiftlint|swift-format|sourcery\b|mark:|region\b|endregion\b"
    r"|coding[:=]|-\*-|vim:|@(?:private|public|protected|internal|ignore|hidden|override|inheritdoc|package|api|async|static|abstract|deprecated|nocollapse|suppress|flow|jest)\b\s*(?:\{[^}]*\})?)[^\n]*\Z"
)
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: words that add nothing to the words of a name
_FILLER = frozenset("a an the this that it is of to for in on and or function method helper does do will just".split())
_CODEY = re.compile(r"[(){}\[\]=;]|^\s*(?:return|import|from|raise|throw|del|print|break|continue|pass|let|var|const|await|yield)\b")


def clean(comment: str) -> str:
    """The words of a comment block or docstring without its marks."""
    text = comment.strip()
    text = re.sub(r"\A[rRuU]?(?:\"\"\"|'''|\"|')|(?:\"\"\"|'''|\"|')\Z", "", text) if text[:1] in "rRuU\"'" and text[-1:] in "\"'" else text
    text = re.sub(r"(?m)\A/\*+|\*+/\s*$|^[ \t]*(?:#+[:!]?|//+[/!]?|\*(?!\*|/))[ \t]?", "", text)
    return text.strip()


def says_something(text: str, name: str) -> bool:
    """Whether a cleaned description is more than blank, a stand-in, a remark for tools, disabled code or the name's own words."""
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x and not _TOOLS.match(x)]
    body = " ".join(lines)
    words = _WORD.findall(body.lower())
    if not words or _STAND_IN.match(body):
        return False
    own = {w.lower() for w in _CAMEL.findall(name)}
    own |= {w + s for w in own for s in ("s", "es", "d", "ed", "ing")} | _FILLER
    if all(w in own for w in words):
        return False
    if _CODEY.search(body) and any(parses(language, "\n".join(lines), member=False, alone=True) for language in ("python", "javascript", "swift")):
        return False
    return True


def describe(text: str, language: str, name: str) -> tuple[str, str] | None:
    """(description, code) of a function's source, or None if it has no description.

    The docstring is preferred to the comment above the definition.
    """
    m = (_PYTHON if language == "python" else _BRACED).match(text)
    if not m:
        return None
    code = (m["signature"] + m["body"]).strip()
    parts = [m["doc"], m["between"], m["above"]] if language == "python" else [m["above"]]
    for part in parts:
        if part:
            words = clean(part)
            if says_something(words, name):
                return words, code
    return None


def dotted(path: str, node_id: str) -> str:
    """Module path with dots, without a leading ``src.``, then class and function."""
    for suffix in SUFFIX:
        if path.endswith(suffix):
            path = path[: -len(suffix)]
    module = path.replace("/", ".").removesuffix(".__init__").removeprefix("src.")
    return ".".join([module, *node_id.split(":")[2:]])


_MODULE = re.compile(r"^\.\. (?:py:)?(?:current)?module:: *(\S+)\s*$|^Module:? [`*]*([\w.]+)[`*]*\s*$")
_DIRECTIVE = re.compile(r"^\s*\.\. (?:\w+:)?(?:auto)?(?:function|method|classmethod|staticmethod|func|meth):: *([\w.$]+)")
_TITLE = re.compile(r"^#{1,6} +(?:def |func(?:tion)? )?[`*]{0,4}([\w.$]+)(?:\(.*\))?[`*]{0,4}:?\s*$")
_TERM = re.compile(r"^[`*]{1,4}([\w$]+(?:\.[\w$]+)+|[\w$]+(?=\())(?:\([^`]*\))?[`*]{1,4}:?\s*$")
_ITEM = re.compile(r"^[-*+] +[`*]{1,4}([\w$]+(?:\.[\w$]+)*)(?:\([^`]*\))?[`*]{1,4}\s*(?:[-–—:]+\s*(.*))?$")
_UNDERLINE = re.compile(r"^([=\-~^\"'`#*+])\1{2,}\s*$")
_PLAIN = re.compile(r"^([\w$]+(?:\.[\w$]+)+)(?:\([^)]*\))?:?\s*$")
_HEADING = re.compile(r"^[`*]*((?:[\w$]+\.)*[\w$]+)(?:\(.*\))?[`*]*:?\s*$")


def entries(heading: str | None, text: str) -> list[tuple[str, str]]:
    """(name as written, with its module if one is set; description) of a chunk's entries."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    module, found = "", []
    current: list | None = None
    inside_fence = False

    def names(name: str) -> list[str]:
        return [f"{module}.{name}", name] if module else [name]

    def close() -> None:
        nonlocal current
        if current is not None:
            body = "\n".join(current[1]).strip()
            found.extend((n, body) for n in current[0])
        current = None

    if heading and (m := _HEADING.match(heading.strip())) and "." in m.group(1):
        current = [names(m.group(1)), [], "text"]
    for i, line in enumerate(lines):
        if line.lstrip().startswith("```"):
            inside_fence = not inside_fence
        if not inside_fence:
            follows = lines[i + 1] if i + 1 < len(lines) else ""
            if m := _MODULE.match(line):
                close()
                module = m.group(1) or m.group(2)
                continue
            m, kind = _DIRECTIVE.match(line), "indented"
            if not m:
                m, kind = _TITLE.match(line), "text"
            if not m:
                m, kind = _TERM.match(line), "indented"
            if not m and _UNDERLINE.match(follows):
                m, kind = _PLAIN.match(line), "text"
            if m:
                close()
                current = [names(m.group(1)), [], kind]
                continue
            if m := _ITEM.match(line):
                # the description may go on, or begin, on the indented lines that follow
                close()
                current = [names(m.group(1)), [m.group(2) or ""], "indented"]
                continue
            if line.startswith("#") or (line.strip() and _UNDERLINE.match(follows) and not _UNDERLINE.match(line)) or (current is not None and current[2] == "indented" and line.strip() and not line[0].isspace()):
                close()
                continue
        if current is not None and not _UNDERLINE.match(line) and not re.match(r"\s*:\w+:\s*$|\s*:(?:noindex|module|async)[\w-]*:", line):
            current[1].append(line)
    close()
    return found


def own_descriptions(nodes: DataFrame, code: bool = False) -> DataFrame:
    """(id, dotted, described, description, code) of every Function that parses; description is null without one of its own.

    With ``code`` false the last two are null, and a row is as small as an id.
    """
    ending = "(?:" + "|".join(re.escape(s) for s in SUFFIX) + ")$"
    # a Function's file may be null; its path then is the second part of its id
    path = F.coalesce("file", F.get(F.split("id", ":"), 1))
    rows = nodes.where((F.col("label") == "Function") & F.col("id").isNotNull() & F.col("source").isNotNull() & path.rlike(ending)).select("id", "name", path.alias("path"), "source")
    rows = spread(rows)

    def run(batches):
        import warnings

        warnings.simplefilter("ignore", SyntaxWarning)
        for batch in batches:
            ids, dots, told, words, codes = [], [], [], [], []
            for i, name, p, text in zip(*(c.to_pylist() for c in batch.columns)):
                language = claimed(p)
                if not valid(i, "Function", language, text):
                    continue
                got = describe(text, language, name or i.rsplit(":", 1)[-1])
                ids.append(i)
                dots.append(dotted(p, i))
                told.append(got is not None)
                words.append(got[0] if got and code else None)
                codes.append((got[1] if got else text) if code else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(dots, pa.string()), pa.array(told, pa.bool_()), pa.array(words, pa.string()), pa.array(codes, pa.string())], ["id", "dotted", "described", "description", "code"])

    return rows.mapInArrow(run, "id string, dotted string, described boolean, description string, code string")


def chunk_descriptions(chunks: DataFrame) -> DataFrame:
    """(dotted, chunk, description): entries of documentation chunks that describe what they name."""
    rows = chunks.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select("id", "heading", "text")
    rows = spread(rows)

    def run(batches):
        for batch in batches:
            names, ids, words = [], [], []
            for i, heading, text in zip(*(c.to_pylist() for c in batch.columns)):
                for name, description in entries(heading, text):
                    if says_something(description, name.rsplit(".", 1)[-1]):
                        names.append(name.removeprefix("src."))
                        ids.append(i)
                        words.append(description)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (names, ids, words)], ["dotted", "chunk", "description"])

    return rows.mapInArrow(run, "dotted string, chunk string, description string")


def pairs(nodes: DataFrame, chunks: DataFrame, code: bool = True) -> DataFrame:
    """One row per function and description: func_id, origin, description, code.

    ``origin`` is the function's own id for its docstring or the comment above it,
    a chunk's id for an entry there; a function may have several.  Functions that
    don't parse, have no source or no description that says something are left out;
    equal rows count once, and a function indexed with different sources has a row
    for each; without chunks only own descriptions come out.  With ``code`` false
    there are only func_id and origin.

    Every source is read once: what it gives is stored and serves both origins.
    """
    columns = ["id", "dotted", "described", *(["description", "code"] if code else [])]
    own = own_descriptions(nodes, code).select(*columns).distinct()
    own = stored(own) if code else durable(own)
    told = chunk_descriptions(chunks).groupBy("dotted", "chunk").agg(F.max("description").alias("said")) if code else chunk_descriptions(chunks).select("dotted", "chunk").distinct()
    extra = ["description", "code"] if code else []
    inside = own.where("described").select(F.col("id").alias("func_id"), F.col("id").alias("origin"), *extra)
    outside = own.join(told, "dotted").select(F.col("id").alias("func_id"), F.col("chunk").alias("origin"), *([F.col("said").alias("description"), "code"] if code else []))
    both = inside.unionByName(outside)
    return both if code else both.distinct()
