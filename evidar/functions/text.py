"""Text rules as Column expressions: tokens, identifiers, links, citations, paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that are no identifiers
PASCAL_STOP = (
    "None True False Error Exception Type List Dict Set Tuple Optional Union Any Self Base Mixin Test Tests String Integer Float Boolean "
    "The This That For With From Import Class Return Raise Yield Async Await"
).split()
# fixed values: keywords with which a commit closes a report; merge and squash marks
CLOSES = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\b\s*:?\s*#(\d+)"
_CLOSES_IN = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\b\s*:?\s*(?:https?://github\.com/{slug}/issues/|{slug}#|#)(\d+)"
MERGED, SQUASHED = r"^Merge pull request #(\d+)", r"\(#(\d+)\)\s*$"
_WHOLE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"  # ends of words in any script
# fixed values: what a name, a quoted name and the path of a Python file look like in a report
PASCAL, SNAKE = r"[A-Z][a-zA-Z0-9]{2,}", r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+"
QUOTED, PYTHON_PATH = r"""[`'"]([a-zA-Z_][a-zA-Z0-9_]*)[`'"]""", r"[a-zA-Z0-9_/]+\.py"
# fixed values: how an answer cites items of the evidence and names files
CITED, TAG = r"\[([ECDHI]\d+(?:\s*[,;]\s*[ECDHI]\d+)*)\]", r"[ECDHI]\d+"
FILE_LINE, SOURCE_PATH = r"(?i)FILE:\s*([\w/\-.]+\.\w+)", r"`([\w/\-.]+\.(?:py|swift|js|ts|java|go|rb|rs|kt|cpp|c|h))`"


def tokenize_code(text: Column) -> Column:
    """Words and digits of a text, camel case split, in lower case; null for null."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "([A-Z])", " $1")), F.lit("[a-z0-9]+"), 0)


def identifiers(text: Column) -> Column:
    """Sorted distinct names in a text: Pascal case, snake case, quoted ones, and paths of Python files with their base names."""
    pascal = F.filter(F.regexp_extract_all(text, F.lit(_WHOLE[0] + PASCAL + _WHOLE[1]), 0), lambda x: ~x.isin(PASCAL_STOP))
    snake = F.regexp_extract_all(text, F.lit(_WHOLE[0] + SNAKE + _WHOLE[1]), 0)
    quoted = F.filter(F.regexp_extract_all(text, F.lit(QUOTED), 1), lambda x: F.length(x) > 2)
    paths = F.regexp_extract_all(text, F.lit(PYTHON_PATH), 0)
    bases = F.filter(F.transform(paths, lambda p: F.replace(F.element_at(F.split(p, "/"), -1), F.lit(".py"), F.lit(""))), lambda b: (b != "") & ~b.isin(PASCAL_STOP))
    return F.array_sort(F.array_distinct(F.concat(pascal, snake, quoted, paths, bases)))


def query_text(text: Column, limit: int = 2000) -> Column:
    """A prompt without fenced blocks, cut to what an encoder reads."""
    return F.substring(F.regexp_replace(text, r"(?s)```.*?```", " "), 1, limit)


def pr_of(message: Column) -> Column:
    """Number of a commit's pull request: a merge mark at the start or a squash mark at the end of the first line; null without."""
    merged = F.regexp_extract(message, MERGED, 1)
    squashed = F.regexp_extract(F.split(message, "\n", 2)[0], SQUASHED, 1)
    return F.coalesce(F.try_to_number(F.nullif(merged, F.lit("")), F.lit("999999999")), F.try_to_number(F.nullif(squashed, F.lit("")), F.lit("999999999"))).cast("int")


def closed_reports(text: Column, slug: str | None = None) -> Column:
    """Numbers a text closes by keyword, distinct and ascending; with a ``slug`` also in that repository's long form or address."""
    pattern = _CLOSES_IN.replace("{slug}", re.escape(slug)) if slug else CLOSES
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: x.cast("bigint"))))


def slug(remote: Column) -> Column:
    """owner/name of an address on the usual host, in any of its forms; null for others."""
    found = F.regexp_extract(remote, r"github\.com[:/]+([^/]+/[^/]+?)(?:\.git)?/?$", 1)
    return F.nullif(found, F.lit(""))


def qualified(node_id: Column) -> Column:
    """The part of an id behind prefix and path, with dots; without one the path."""
    parts = F.split(node_id, ":", 3)
    return F.when(F.size(parts) == 3, F.replace(parts[2], F.lit(":"), F.lit("."))).otherwise(F.element_at(parts, -1))


def key_of(node_id: Column) -> Column:
    """An id without its prefix, as the history names elements."""
    return F.regexp_replace(node_id, "^[^:]*:", "")


def module_name(path: Column) -> Column:
    """Dotted module name of a Python path."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("/"), F.lit(".")), r"\.py$", ""), r"\.__init__$", ""), r"^src\.", "")


def directory(path: Column) -> Column:
    """Folder of a path, a dot at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def is_bugfix(message: Column) -> Column:
    return message.rlike("(?i)fix|bug")


def clip(text: Column, limit: int, mark: str = " ... ") -> Column:
    """First 70 % and last 30 % of a text that is longer than ``limit``."""
    head = int(limit * 0.7)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(limit - head)))).otherwise(text)


def hunk_body(text: Column) -> Column:
    """Lines of a hunk without its header and without the first character of each."""
    lines = F.split(text, "\n")
    return F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.substring(x, 2, 1 << 30)), "\n")


def comment_only(text: Column) -> Column:
    """Whether every added or removed line of a hunk is blank or a comment."""
    changed = F.filter(F.split(text, "\n"), lambda x: x.rlike("^[+-]"))
    return F.forall(changed, lambda x: x.rlike(r"^[+-]\s*(?:#.*)?$"))


def cited_items(answer: Column) -> Column:
    """Tags like C2 or D1 in square brackets, in order, once each."""
    groups = F.regexp_extract_all(answer, F.lit(CITED), 1)
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(TAG), 0))))


def answered_files(answer: Column) -> Column:
    """Paths after FILE: and paths of source files in back-ticks, in order, once each."""
    named = F.regexp_extract_all(answer, F.lit(FILE_LINE), 1)
    ticked = F.regexp_extract_all(answer, F.lit(SOURCE_PATH), 1)
    return F.array_distinct(F.concat(named, ticked))


def kept_path(path: Column) -> Column:
    """Whether a source path is no test, example or set-up file."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    skip = ("tests", "test", "examples", "example", "benchmarks", "docs")
    return ~F.exists(folders, lambda p: p.isin(*skip)) & ~F.element_at(parts, -1).isin("conftest.py", "setup.py")
