"""Source files not written by hand in their repository (problem 3).

A random forest reads shape only: compression ratio, token entropy, lengths of
identifiers, comment density and the like, of a file without its first and last
comment lines.  Its training labels are weak: header and footer notices, which are
hidden from the features, and for the two kinds that never carry a notice, squeezed
modules and modules that are nothing but literals, their structure.  A notice only
labels; a file that has one is judged by its shape like any other.

Copies of other projects' files look hand-written, so no shape can show them.  They
are left out of the training and settled by themselves: by a package folder, by
another project's copyright notice, or by a similarity of 0.8 to a known upstream
file, from an index of all shingles of the upstream files.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.tables import durable, spread

from .forest import Forest

#: about so many files the forest is fitted on, however large the table
SAMPLE = 6_000
THRESHOLD = 0.42
#: words in a shingle and least similarity of a copy
SHINGLE, SIMILAR = 5, 0.8
#: bytes of upstream files that may be broadcast; the table is fixed
UPSTREAM_BYTES = 64 << 20

FEATURES = (
    "compression", "entropy", "name_length", "long_names", "short_names", "comments", "digits", "spaces", "line_length",
    "longest_line", "same_lines", "keywords", "signs",
)

# fixed values: notices that tools write, folders that package managers copy into, names of built files
_NOTICE = re.compile(
    r"(?i)@generated\b|\bauto-?generated\b|\bcode generated by\b|\bgenerated by \w+ [\d.]+ on\b|\bdo not modify by hand\b|\bdo not edit\b"
    r"|\bautomatically (?:created|generated)\b|\bthis file was (?:produced|generated)\b|\bchanges will be lost\b|^\W*generated [\w ]+, source \S+|\bmanual edits are overwritten\b"
)
_BANNER = re.compile(r"\A\s*/\*!|^//[#@] sourceMappingURL=", re.M)
_TRANSPILED = re.compile(r"""Object\.defineProperty\(exports, ["']__esModule["']|\b__(?:assign|awaiter|extends|importDefault)\b = \(this""")
_FOLDER = re.compile(r"(?:^|/)(?:node_modules|bower_components|vendor|_vendor|vendored|third_party|thirdparty|third-party|deps|site-packages)/")
_BUILT = re.compile(r"[.-]min\.js$|\.bundle\.js$|-[0-9a-f]{8}\.js$|_pb2(?:_grpc)?\.py$")
_TERMS = re.compile(r"(?i)\(c\) \d{4} the \w+ (?:contributors|authors)|redistribution (?:and use )?(?:is )?permitted|licensed under the|permission is hereby granted")
_LEAD = re.compile(
    r"""\s+|(?:\#|//)[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->|[rRuU]?(?:\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|"[^"\n]*"|'[^'\n]*')[ \t]*;?(?=\s|\Z)
    |(?:import|from|package)\b[^\n(;{]*(?:\([^)]*\)|\{[^}]*\}[^\n;]*)?;?|(?:const|var|let)\s+[^=\n;]+=\s*require\([^)\n]*\)[^\n;]*;?""",
    re.X,
)
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|<!--)")
_TOKEN = re.compile(r"[A-Za-z_$]\w*|\d+(?:\.\d+)?|[^\w\s]")
_WORD = re.compile(r"\w+")
_LITERAL = re.compile(r"\A(?:\s*(?:#[^\n]*)?\n)*(?:(?:const|let|var|export|default)\s+)*[\w.]+(?:\s*:[^=\n]+)?\s*=\s*[\[{(\"'][^;]*;?\s*\Z")
_CODE = re.compile(r"\b(?:def|class|func|function|return|import|require|if|for|while|lambda|new|try)\b|=>")
_KEYWORD = frozenset(
    "def class return import from if else elif for while try except with as in is not and or lambda yield raise function const let var new throw catch func guard switch case struct enum private public static".split()
)
_SHAPE = re.compile(r"\w+")


def _edges(lines: list[str]) -> tuple[int, int]:
    """Where the leading comment lines end and the trailing ones begin; blank lines and whole block comments are among them."""
    a, b = 0, len(lines)
    while a < b and (not lines[a].strip() or _COMMENT.match(lines[a])):
        x, end = lines[a].strip(), a
        if x.startswith("/*") and "*/" not in x:
            end = next((i for i in range(a + 1, b) if "*/" in lines[i]), a)
            if not (_COMMENT.match(lines[end]) or lines[end].rstrip().endswith("*/")):
                end -= 1  # code follows on its last line
        a = end + 1
    while b > a:
        x, begin = lines[b - 1].strip(), b - 1
        if x.endswith("*/") and "/*" not in x:
            i = next((i for i in range(b - 2, a - 1, -1) if "/*" in lines[i] or "*/" in lines[i]), a)
            if i < b - 1 and lines[i].strip().startswith("/*") and "*/" not in lines[i]:
                begin = i
        if begin == b - 1 and x and not _COMMENT.match(lines[b - 1]):
            break
        b = begin
    return a, b


def notice(text: str) -> bool:
    """Whether the leading or trailing comment lines hold a notice that a tool wrote the file."""
    lines = text.split("\n")
    a, b = _edges(lines)
    return any(_NOTICE.search(x) and not x.lstrip().startswith("#!") for x in lines[:a] + lines[b:])


def _head(text: str) -> str:
    """What comes before the first statement: comments, a string that opens the file, directives and imports."""
    at = 0
    while m := _LEAD.match(text, at):
        if m.end() == at:
            break
        at = m.end()
    return text[:at]


def copy_notice(text: str) -> bool:
    """Whether what precedes the first statement, or the trailing comment lines, name another project's version and terms."""
    lines = text.split("\n")
    a, b = _edges(lines)
    return any(_TERMS.search(x) for x in ("\n".join(lines[:a]), _head(text), "\n".join(lines[b:])))


def weak_label(path: str, text: str, copied: float) -> int | None:
    """1 where a notice, or the structure of a kind that never has one, says the file isn't hand-written, else 0.

    None for copies of other projects' files, since somebody wrote them by hand and
    their shape says nothing, and for files named as tools name what they build.
    """
    if notice(text) or _BANNER.search(text) or _TRANSPILED.search(text) or _squeezed(text):
        return 1
    if len(text) > 400 and _LITERAL.match(text) and not _CODE.search(text):
        return 1
    return None if copied >= SIMILAR or copy_notice(text) or _FOLDER.search(path) or _BUILT.search(path) else 0


def _squeezed(text: str) -> bool:
    """Nearly no white space between statements: several statements a line and names of one letter."""
    lines = text.count("\n") + 1
    return text.count(";") > 2 * lines and sum(map(len, text.split())) > 0.93 * len(text)


def features(text: str) -> list[float]:
    """The numbers the forest reads; comment lines at the top and bottom are left out of all of them."""
    lines = text.split("\n")
    a, b = _edges(lines)
    lines = lines[a:b]
    body = "\n".join(lines)
    size = max(1, len(body))
    tokens = _TOKEN.findall(body)
    counts = Counter(tokens)
    n = max(1, len(tokens))
    entropy = -sum(c / n * log2(c / n) for c in counts.values())
    names = [(t, c) for t, c in counts.items() if t[0].isalpha() or t[0] in "_$"]
    uses = max(1, sum(c for _, c in names))
    shapes = Counter(_SHAPE.sub("w", body).split("\n"))
    shapes.pop("", None)
    filled = max(1, sum(shapes.values()))
    data = body.encode("utf-8", "replace")
    return [
        len(zlib.compress(data, 1)) / max(1, len(data)),
        entropy / max(1.0, log2(n)),
        sum(len(t) * c for t, c in names) / uses,
        sum(c for t, c in names if len(t) > 20) / uses,
        sum(c for t, c in names if len(t) < 3) / uses,
        sum(1 for x in lines if _COMMENT.match(x)) / filled,
        sum(c * len(t) for t, c in counts.items() if t[0].isdigit()) / size,
        (body.count(" ") + body.count("\n") + body.count("\t")) / size,
        size / filled,
        float(max(map(len, lines), default=0)),
        max(shapes.values(), default=0) / filled,
        sum(counts[k] for k in _KEYWORD if k in counts) / n,
        sum(c for t, c in counts.items() if not (t[0].isalnum() or t[0] in "_$")) / n,
    ]


class _Upstream:
    """An index of the shingles of the known third-party files: exact, for any text."""

    def __init__(self, sources: list[str]):
        self.words: dict[str, int] = {}
        own = [np.unique(self._codes([self.words.setdefault(w, len(self.words) + 1) for w in _WORD.findall(s)])) for s in sources]
        self.sizes = np.array([len(x) for x in own], np.int64)
        code = np.concatenate([*own, np.empty(0, np.uint64)])
        file = np.repeat(np.arange(len(own)), self.sizes)
        order = np.argsort(code, kind="stable")
        self.file = file[order]
        self.codes, self.start = np.unique(code[order], return_index=True)
        self.end = np.append(self.start[1:], len(code))

    @staticmethod
    def _codes(ids: list[int]) -> np.ndarray:
        """A number for each five words in a row."""
        x = np.array(ids, np.uint64)
        if len(x) < SHINGLE:
            return np.empty(0, np.uint64)
        n = len(x) - SHINGLE + 1
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(SHINGLE):
                out = (out ^ x[i: i + n]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(31)
        return out

    def copied(self, text: str) -> float:
        """Shared shingles with the most similar file, as a share of the smaller of both."""
        words = _WORD.findall(text)
        if not len(self.codes) or len(words) < SHINGLE:
            return 0.0
        known = self.words
        # a word no upstream file has gets a number of this text's own
        fresh: dict[str, int] = {}
        ids = [known.get(w) or fresh.setdefault(w, len(known) + len(fresh) + 1) for w in words]
        own = np.unique(self._codes(ids))
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at = at[self.codes[at] == own]
        if not len(at) or len(own) < SHINGLE:
            return 0.0
        files = np.concatenate([self.file[self.start[i]: self.end[i]] for i in at])
        shared = np.bincount(files, minlength=len(self.sizes))
        return float((shared / np.maximum(1, np.minimum(len(own), self.sizes))).max())


def described(modules: DataFrame, upstream: DataFrame, sampled: float = 1.0) -> DataFrame:
    """(id, path, label, known, features) of every module; needs (id, path, source) with a source.

    ``label`` is the weak label of the files sampled for training (a share
    ``sampled``, by a hash of the id) and null for the others; ``known`` says that
    the file is settled as a copy of another project's.
    """
    texts = upstream.where("source is not null").select("source").distinct()
    size = texts.agg(F.sum(F.octet_length("source"))).first()[0] or 0
    if size > UPSTREAM_BYTES:
        raise ValueError(f"the upstream files have {size} bytes; more than {UPSTREAM_BYTES} may not be broadcast")
    sources = modules.sparkSession.sparkContext.broadcast([r.source for r in texts.collect()])
    limit = sampled * 2**32

    def run(batches):
        base = _Upstream(sources.value)
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            share = [base.copied(t) for _, _, t in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array([weak_label(p, t, c) if zlib.crc32(i.encode()) < limit else None for (i, p, t), c in zip(rows, share)], pa.int32()),
                pa.array([copy_notice(t) or c >= SIMILAR or bool(_FOLDER.search(p)) for (_, p, t), c in zip(rows, share)]),
                pa.array([features(t) for _, _, t in rows], pa.list_(pa.float64())),
            ], ["id", "path", "label", "known", "features"])

    return modules.select("id", "path", "source").mapInArrow(run, "id string, path string, label int, known boolean, features array<double>")


def judged(nodes: DataFrame, upstream: DataFrame, suffixes: tuple[str, ...] = (".py", ".js", ".swift"), sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per source file: id, path, score, generated.

    Files are Module rows with an id, a source and a path (``file``, else ``name``)
    that ends in one of ``suffixes``; a module indexed several times is one file,
    reported if any of its versions is, with the greatest score.  Null sources have
    no row; an empty table gives none.  The forest is fitted on about ``sample``
    files; if all of them have one label it says that one of every file; without any
    labelled file only copies are reported.
    """
    path = F.coalesce("file", "name")
    files = nodes.where((F.col("label") == "Module") & F.col("id").isNotNull() & F.col("source").isNotNull() & path.rlike("(?:" + "|".join(re.escape(s) for s in suffixes) + ")$"))
    files = spread(files.select("id", path.alias("path"), "source"))
    table = durable(described(files, upstream, sample / max(1, files.count())))
    # in the order of a hash, so that the same table gives the same forest
    chosen = table.where("label is not null").select("features", "label", F.xxhash64("id", "features").alias("h")).orderBy("h").limit(4 * sample).collect()
    x, y = np.array([r.features for r in chosen]).reshape(-1, len(FEATURES)), np.array([r.label for r in chosen])
    forest = Forest().fit(x, y) if len(y) else Forest()
    model = nodes.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            rows = np.array(batch.column(3).to_pylist(), float).reshape(-1, len(FEATURES))
            score = model.value.predict(rows)
            flag = (score >= threshold) | np.array(batch.column(2).to_pylist(), bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(score, 6)), pa.array(flag)], ["id", "path", "score", "generated"])

    scored = table.select("id", "path", "known", "features").mapInArrow(run, "id string, path string, score double, generated boolean")
    return scored.groupBy("id").agg(F.max("path").alias("path"), F.max("score").alias("score"), F.max("generated").alias("generated"))


def handwritten(nodes: DataFrame, upstream: DataFrame) -> DataFrame:
    """(id, path) of the source files that remain."""
    return judged(nodes, upstream).where("not generated").select("id", "path")
