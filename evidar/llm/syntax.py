"""Source that does not parse (problem 5).

The file ending claims a language.  The tokens of every text rank the languages, and
the grammars read it in that order: a text that the claimed grammar accepts is
settled once that one has read it; any other is read by all of them, and a foreign
language that accepts it shows a wrong ending, no language at all a damaged text.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidar.tables import spread

from .grammars import LANGUAGES, SUFFIX, parses

_TOKEN = re.compile(r"[A-Za-z_]\w*|=>|===|->|:=|\{|;|:\n|#|//|/\*|\$\{|`|\"\"\"|'")
#: fixed values: tokens that speak for a language
_TELLING = {
    "python": ("def", "elif", "None", "self", "import", "from", "lambda", "pass", "raise", "except", "with", "yield", ":\n", "#", '"""', ":=", "not", "and"),
    "javascript": ("function", "const", "var", "let", "=>", "===", ";", "require", "module", "exports", "new", "typeof", "null", "undefined", "//", "${", "`", "async"),
    "swift": ("func", "let", "var", "guard", "struct", "extension", "protocol", "->", "nil", "private", "public", "class", "switch", "init", "Foundation", "String", "Int", "//"),
}


def ranked(text: str) -> list[str]:
    """Languages by the share of a text's tokens that speak for them."""
    counts = Counter(_TOKEN.findall(text))
    return sorted(LANGUAGES, key=lambda name: (-sum(counts[t] for t in _TELLING[name]), LANGUAGES.index(name)))


def claimed(path: str) -> str | None:
    """The language a file ending stands for."""
    dot = path.rfind(".")
    return SUFFIX.get(path[dot:]) if dot >= 0 else None


def valid(node_id: str, label: str, language: str, text: str) -> bool:
    """Whether a node's source is valid: a Module as a file, a Function alone, a method as a member of a class."""
    if label != "Function":
        return parses(language, text)
    parts = (node_id or "").split(":")
    member = len(parts) > 3 and parts[-2][:1].isupper()
    return parses(language, text, member=member, alone=True)


def verdict(node_id: str, label: str, path: str, text: str) -> str:
    """``ok``, the language that accepts the text instead, or ``corrupt``."""
    language = claimed(path)
    foreign = None
    for name in ranked(text):
        if name == language:
            if valid(node_id, label, name, text):
                return "ok"
        elif foreign is None and text.strip() and valid(node_id, label, name, text):
            foreign = name
    return foreign or "corrupt"


def _path() -> Column:
    return F.coalesce("file", F.get(F.split("id", ":"), 1), "name")


def checked(nodes: DataFrame, all_rows: bool = True) -> DataFrame:
    """One row per Module and Function of a language with a grammar: id, label, repo, lang, verdict.

    ``lang`` is the language the file ending claims (of ``file``, else of the id's path, else of ``name``); rows
    with other endings, without source or of other labels have none.  An element
    indexed several times gives several rows; an empty source is valid Python, a
    valid script and a valid Swift file.  With ``all_rows`` false only the rows
    that don't parse come out.
    """
    ending = "(?:" + "|".join(re.escape(s) for s in SUFFIX) + ")$"
    rows = nodes.where(F.col("label").isin("Module", "Function") & F.col("source").isNotNull() & _path().rlike(ending)).select("id", "label", "repo", _path().alias("path"), "source")
    rows = spread(rows)

    def run(batches):
        import warnings

        warnings.simplefilter("ignore", SyntaxWarning)
        for batch in batches:
            got = [verdict(i, label, p, t) for i, label, p, t in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)))]
            langs = [claimed(p) for p in batch.column(3).to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(langs, pa.string()), pa.array(got, pa.string())], ["id", "label", "repo", "lang", "verdict"])
            yield out if all_rows else out.filter(pa.array([v != "ok" for v in got], pa.bool_()))

    return rows.mapInArrow(run, "id string, label string, repo string, lang string, verdict string")


def invalid(nodes: DataFrame) -> DataFrame:
    """(id, verdict) of every element whose source doesn't parse, once."""
    return checked(nodes, all_rows=False).groupBy("id").agg(F.max("verdict").alias("verdict"))


def rates(nodes: DataFrame) -> DataFrame:
    """Per repo and language: files, broken, foreign (broken, but valid in another language) and rate.

    Files are Modules, each counted once; it is broken if any of its versions is.
    """
    files = checked(nodes.where(F.col("label") == "Module")).groupBy("repo", "lang", "id").agg(F.max(F.when(F.col("verdict") == "ok", "").otherwise(F.col("verdict"))).alias("v"))
    broken = F.sum((F.col("v") != "").cast("bigint"))
    return files.groupBy("repo", "lang").agg(
        F.count("*").alias("files"), broken.alias("broken"), F.sum((~F.col("v").isin("", "corrupt")).cast("bigint")).alias("foreign"), F.round(broken / F.count("*"), 6).alias("rate")
    )
