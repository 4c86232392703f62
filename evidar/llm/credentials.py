"""Credentials in source code and configuration (problem 1).

Candidates are values in a place where a secret may stand: after a name such as
``api_key``, in the user part of an address, after ``Bearer``, on a command line,
in a log-in call, in a comment, in a key block, with the prefix of a known issuer,
or a long literal of mixed letters and digits under any name.  A logistic regression scores them from the likelihood of their characters
under two Markov models (ordinary literals, secrets), from the name and the call
around them and from the path.  It is trained on candidates and ordinary literals
of a bounded sample of files with weak labels from pattern matches, and its scores
are calibrated on files held out.  Values that score high are blanked out, letter
by letter, so that the rest of the source keeps its places.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from math import log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.tables import spread

#: about so many files the models are trained on, however large the table
SAMPLE = 3_000
#: calibrated score from which a value is a credential
THRESHOLD = 0.4
BLANK = "X"

# fixed values: names that end like this hold secrets; prefixes of known issuers; stand-ins
_SECRET = (
    r"(?:pass(?:word|wd|phrase|code)?|pwd|pw|secret|token|api_?key|secret_?key|signing_?key|access_?key(?:_?id)?|private_?key|encryption_?key"
    r"|auth_?key|master_?key|account_?key|credentials?|authorization)"
)
_NAME = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:[A-Za-z_][\w.-]*?)?{_SECRET}(?![A-Za-z0-9_-])")
#: in lower case: a line without any of these holds no candidate
_NEEDED = (
    "pass", "pwd", "pw", "secret", "token", "key", "credential", "authorization", "://", "bearer ", "basic ", "-u ", "--user", "login", "log_in", "sign_in", "signin", "authenticate", "connect(",
    ".save(", ".store(", ".add(", ".set(", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "k_live_", "xoxa-", "xoxb-", "xoxp-", "eyj",
)
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|glpat-[\w-]{18,}|[sr]k_live_[A-Za-z0-9]{16,}|xox[abp]-[\w-]{20,}"
    r"|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})(?![A-Za-z0-9_/+=-])"
)
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:(?:(?!-----BEGIN)[\s\S])*?-----END (?:[A-Z]+ )*PRIVATE KEY-----|[^\"'`]*)")
_USERINFO = re.compile(r"[A-Za-z][\w+.-]*://([^\s:/@\"'`]*):([^\s@/\"'`]+)@")
_SCHEME = re.compile(r"(?i)\b(bearer|basic)\s+([A-Za-z0-9._~+/=-]{8,})")
_USER = re.compile(r"(?:\s-u|--user)[ =]+[\"']?([^\s:\"']+):([^\s\"']+)")
_LOGIN = re.compile(r"(?i)\b(?:login|log_in|sign_?in|authenticate|connect)\(\s*([\"'`])[^\"'`\n]*\1\s*,\s*([\"'`])([^\"'`\n]+)\2")
_STORE = re.compile(r"\b(?:save|store|add|set)\(\s*\"([^\"\n]+)\"\s*,\s*(?:account|service|for|key)\w*:")
_AFTER = re.compile(r"[\"'\]]{0,2}\s*(?::\s*[A-Z]\w*[?!]?\s*(?==))?(?:\|\||\?\?|=>|:=|[:=,])\s*")
_OPENED = re.compile(r"(?:\(\s*|(?:bytes\.fromhex|(?:base64\.)?b64decode|atob|Buffer\.from|process\.env\.\w+\s*\|\||os\.environ\.get\(\s*[\"']\w+[\"']\s*,|os\.getenv\(\s*[\"']\w+[\"']\s*,)\(?\s*)*")
_LITERAL = re.compile(r"(?:[bruBRU]{0,2})(\"\"\"|'''|[\"'`])")
_JOIN = re.compile(r"\s*(?:\+|\\|\.\.|&)?\s*(?:[bru]?)(?=[\"'`])")
_BARE = re.compile(r"[^\s\"'`#,;{}()\[\]][^\s\"'`]*(?=[\"']?\s*,?\s*$)", re.M)
_OPENER = re.compile(r"(?:^|\s)(?:#|//)|^\s*(?:;|\*|--|/\*)")
_REMARK = re.compile(rf"(?i)\b((?:\w+[ _-])?{_SECRET.replace('_?', '[ _-]?')})\b")
_TOLD = re.compile(r"(?i)[^:=(){}]*[:=]\s*\Z|\s+(?:is|was|were|ist|war|là)\s*\Z")
#: a long literal in mixed letters and digits, whatever its name
_OPAQUE = re.compile(r"([\"'])([A-Za-z0-9+/_~.=-]{20,})\1")
_COMMENT = re.compile(r"\s*(?:#|//|;|\*|--|<!--)")
_CONFIG = re.compile(r"\.(?:ya?ml|json|ini|env|toml|cfg|conf|properties|xml|tf|npmrc)$|(?:^|/)\.[\w.-]+$")
_CODE = re.compile(r"\.(?:py|js|swift)$")
_TRIAL = re.compile(r"(?i)(?:^|/)(?:tests?|examples?|fixtures?|docs?|samples?)/")
_STAND_IN = re.compile(
    r"(?i)\$\{|\{\{|%\(|%s|%d|^<[^>]*>$|^\$\w+$|^%\w+%$|x{4,}|\*{3,}|\.{3}|…|\byour[_-]|_here\b|^change_?me$|replace|insert[_-]|placeholder|^todo|^dummy|^example|^none$|^null$|^true$|^false$|redacted"
    r"|^(?:env|vault|file|ssm|secretsmanager|arn|op)[:/]"
)
_CHECKSUM = re.compile(r"(?i)^(?:sha\d{1,3}|md5)[-:]|^data:|-----BEGIN (?:RSA )?PUBLIC")
_FILE = re.compile(r"^[\w.~-]*(?:/[\w.~-]+)+/?$")
_ORDINARY = re.compile(r"([A-Za-z_]\w{2,40})[\"']?\s*[:=]\s*[\"']([^\"'\n]{6,})[\"']")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_ALPHABET = 96
_FOLD = {x: x + 32 for x in range(ord("A"), ord("Z") + 1)}


@dataclass(slots=True)
class Candidate:
    """A value and where it stands; ``spans`` are its parts in the text."""

    value: str
    spans: list[tuple[int, int]]
    name: str
    place: str


def _literal(text: str, at: int) -> tuple[str, list[tuple[int, int]]] | None:
    """The string literal that begins at ``at``, with the literals joined to it."""
    parts, spans = [], []
    while m := _LITERAL.match(text, at):
        quote, start = m.group(1), m.end()
        # a literal in single quotes ends on its line
        last = text.find("\n", start) if len(quote) == 1 and quote != "`" else -1
        end = text.find(quote, start, last if last >= 0 else len(text))
        while end >= 0 and _escaped(text, start, end):
            end = text.find(quote, end + 1, last if last >= 0 else len(text))
        if end < 0:
            break
        parts.append(text[start:end])
        if end > start:
            spans.append((start, end))
        at = end + len(quote)
        j = _JOIN.match(text, at)
        if not j or "\n\n" in j.group() or ("\n" in j.group() and not j.group().strip() and not _indented(text, j)):
            break
        at = j.end()
    return ("".join(parts), spans) if spans else None


def _escaped(text: str, start: int, at: int) -> bool:
    """Whether an odd number of backslashes stands before a place."""
    before = at
    while before > start and text[before - 1] == "\\":
        before -= 1
    return (at - before) % 2 == 1


def _indented(text: str, joined: re.Match) -> bool:
    """Whether the next line's literal continues this one: alone on its line, as inside brackets."""
    start = text.rfind("\n", 0, joined.end()) + 1
    before = text.rfind("\n", 0, joined.start()) + 1
    return text[start: joined.end()].isspace() and text[before: joined.start()].lstrip()[:1] in "\"'`"


def _lines(text: str) -> set[tuple[int, int]]:
    """Begin and end of the lines in which something may stand."""
    low = text.lower()
    if len(low) != len(text):  # some letters change their length
        low = text.translate(_FOLD)
    lines = set()
    for word in _NEEDED:
        at = low.find(word)
        while at >= 0:
            end = low.find("\n", at)
            end = len(low) if end < 0 else end
            lines.add((low.rfind("\n", 0, at) + 1, end))
            at = low.find(word, end)
    return lines


def candidates(text: str, path: str) -> list[Candidate]:
    """Values that stand where a secret may stand, in the order of their places."""
    found: dict[int, Candidate] = {}
    config = bool(_CONFIG.search(path)) or not _CODE.search(path)

    def add(value: str, spans: list[tuple[int, int]], name: str, place: str) -> None:
        if spans and spans[0][0] not in found:
            found[spans[0][0]] = Candidate(value, spans, name, place)

    taken: list[tuple[int, int]] = []
    if "PRIVATE KEY-----" in text:
        for m in _BLOCK.finditer(text):
            taken.append(m.span())
            add(m.group(), [m.span()], "private_key", "block")
    for start, end in sorted(_lines(text)):
        if any(a <= start < b for a, b in taken):
            continue
        line = text[start:end]
        remark = bool(_COMMENT.match(line))
        if not (config or remark or '"' in line or "'" in line or "`" in line or "#" in line or "//" in line or line.rstrip().endswith(("(", "=", "\\"))):
            continue
        for m in _USERINFO.finditer(line):
            add(m.group(2), [(start + m.start(2), start + m.end(2))], m.group(1), "address")
        for m in _SCHEME.finditer(line):
            add(m.group(2), [(start + m.start(2), start + m.end(2))], m.group(1).lower(), "header")
        for m in _USER.finditer(line):
            add(m.group(2), [(start + m.start(2), start + m.end(2))], m.group(1), "command")
        for m in _LOGIN.finditer(line):
            add(m.group(3), [(start + m.start(3), start + m.end(3))], "login", "login")
        for m in _STORE.finditer(line):
            add(m.group(1), [(start + m.start(1), start + m.end(1))], "login", "login")
        for m in _NAME.finditer(line):
            after = _AFTER.match(text, start + m.end())
            if not after or "\n" in after.group():
                continue
            opened = _OPENED.match(text, after.end())
            if got := _literal(text, opened.end()):
                if not _BLOCK.match(got[0]):
                    add(*got, m.group(), "comment" if remark else "pair")
            elif (config or remark) and after.end() <= end and (b := _BARE.match(text, after.end(), end)):
                add(b.group(), [b.span()], m.group(), "comment" if remark else "pair")
        if got := _remark(line):
            name, at, value = got
            add(value, [(start + at, start + at + len(value))], name, "comment")
        for m in _ISSUED.finditer(line):
            if not any(a <= start + m.start() < b for c in found.values() for a, b in c.spans):
                add(m.group(), [(start + m.start(), start + m.end())], "", "issued")
    for m in _OPAQUE.finditer(text):
        value = m.group(2)
        if value.isalpha() or value.islower() or value.isupper() or not any(x.isdigit() for x in value):
            continue
        if not any(a <= m.start(2) < b for c in found.values() for a, b in c.spans):
            add(value, [m.span(2)], _named(text, m.start()), "opaque")
    return [found[k] for k in sorted(found)]


def _named(text: str, at: int) -> str:
    """The name a value at a place is given to: a word, then a colon, a sign, a comma or a bracket."""
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    if not end or text[end - 1] not in ":=(,":
        return ""
    end -= 1
    while end and text[end - 1] in " \t\"']":
        end -= 1
    begin = end
    while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.-"):
        begin -= 1
    return text[begin:end]


def _remark(line: str) -> tuple[str, int, str] | None:
    """Name, place and value of what a comment says of a secret: the last word of the line, after a name and a colon, a sign or a verb."""
    bare = line.rstrip()
    begin = max(bare.rfind(c) for c in " \t(){}") + 1
    opened = _OPENER.search(line)
    if not opened or begin <= opened.end() or begin == len(bare):
        # the value may follow its sign without a space
        begin = max(begin, bare.rfind(":") + 1, bare.rfind("=") + 1) if opened and begin < len(bare) else len(bare)
    if begin == len(bare):
        return None
    starts = [m.end() for m in _OPENER.finditer(line)]
    for m in _REMARK.finditer(line):
        sign = max(line.rfind(":", 0, m.start()), line.rfind("=", 0, m.start()))
        if not any(sign < x <= m.start() + 1 for x in starts):
            continue
        at = begin
        if not _TOLD.match(line[m.end():at]):
            # name:value in one word
            at = max(bare.find(":", m.end()), bare.find("=", m.end())) + 1
            if at < max(begin, 1) or not _TOLD.match(line[m.end():at]):
                continue
        raw = bare[at:]
        value = raw.rstrip(",;\"'").lstrip("\"'")
        return m.group(1), at + len(raw) - len(raw.lstrip("\"'")), value
    return None


def _ordinary(text: str) -> list[Candidate]:
    """Literals under other names, to train on."""
    return [Candidate(m.group(2), [m.span(2)], m.group(1), "pair") for m in _ORDINARY.finditer(text) if not _NAME.search(m.group(1))]


def weak_label(c: Candidate) -> int | None:
    """1 for what patterns take for a secret, 0 for what they take for none, None where they don't tell."""
    v = c.value
    if c.place == "block":
        return 1 if len(v) > 80 else 0
    if _STAND_IN.search(v) or _CHECKSUM.search(v) or len(v) < 4:
        return 0
    if _ISSUED.fullmatch(v):
        return 1
    letters, digits = any(x.isalpha() for x in v), any(x.isdigit() for x in v)
    if c.place == "opaque":
        return None
    if c.place == "pair" and not _NAME.search(c.name):
        return 0
    if " " in v or not (letters and digits):
        return 0
    if _FILE.match(v) and not any(x.isupper() for x in v):
        return 0
    return 1 if len(v) >= 7 else None


class Markov:
    """Likelihood of characters given the one before, with add-one smoothing."""

    def __init__(self, values: list[str]):
        counts = np.ones((_ALPHABET, _ALPHABET))
        for v in values:
            codes = self._codes(v)
            np.add.at(counts, (codes[:-1], codes[1:]), 1)
        self.logs = np.log(counts / counts.sum(1, keepdims=True))

    @staticmethod
    def _codes(v: str) -> np.ndarray:
        raw = np.frombuffer(("\x1f" + v).encode("ascii", "replace"), np.uint8).astype(int) - 31
        return np.clip(raw, 0, _ALPHABET - 1)

    def mean(self, v: str) -> float:
        codes = self._codes(v)
        return float(self.logs[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0


_PLACES = ("pair", "address", "header", "command", "login", "comment", "block", "issued", "opaque")
_BUCKETS = 48


def features(c: Candidate, path: str, ordinary: Markov, secret: Markov) -> list[float]:
    v = c.value
    n = max(1, len(v))
    counts = Counter(v)
    entropy = -sum(x / n * log2(x / n) for x in counts.values())
    plain, odd = ordinary.mean(v), secret.mean(v)
    digits, upper = sum(x.isdigit() for x in v) / n, sum(x.isupper() for x in v) / n
    signs = sum(not x.isalnum() for x in v) / n
    words = [w.lower() for w in _PARTS.findall(c.name)]
    bag = [0.0] * _BUCKETS
    for w in words[-3:]:
        bag[zlib.crc32(w.encode()) % _BUCKETS] = 1.0
    return [
        odd - plain, plain, log(n), entropy / 6, digits, upper, signs, float(digits > 0 and any(x.isalpha() for x in v)), float(digits + signs < 1),
        float(bool(_STAND_IN.search(v))), float(bool(_CHECKSUM.search(v))), float(bool(_FILE.match(v)) and upper == 0), float(" " in v),
        float(bool(_NAME.search(c.name))), float(bool(_ISSUED.search(v))), float(bool(_CONFIG.search(path))), float(bool(_TRIAL.search(path))),
        *[float(c.place == p) for p in _PLACES], *bag,
    ]


class Model:
    """Standardised logistic regression with a calibration of its scores."""

    def __init__(self, texts: list[tuple[str, str]]):
        fit, held = [], []
        for path, text in texts:
            rows = [(c, path, weak_label(c)) for c in candidates(text, path) + _ordinary(text)]
            (held if zlib.crc32(path.encode()) % 4 == 0 else fit).extend(r for r in rows if r[2] is not None)
        self.ordinary = Markov([c.value for c, _, y in fit if y == 0])
        self.secret = Markov([c.value for c, _, y in fit if y == 1])
        y = np.array([r[2] for r in fit], float)
        self.ready = 0 < y.sum() < len(y)
        if not self.ready:
            return
        x = np.array([self._row(c, p) for c, p, _ in fit])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.weights = self._solve(self._matrix(x), y, 1.0)
        # Platt scaling on the files held out
        self.slope, self.shift = 1.0, 0.0
        hy = np.array([r[2] for r in held], float)
        if 0 < hy.sum() < len(hy):
            raw = self._matrix(np.array([self._row(c, p) for c, p, _ in held])) @ self.weights
            self.slope, self.shift = self._solve(np.stack([raw, np.ones(len(raw))], 1), hy, 0.1)

    def _row(self, c: Candidate, path: str) -> list[float]:
        return features(c, path, self.ordinary, self.secret)

    def _matrix(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    @staticmethod
    def _solve(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
        """Newton's method for the penalised likelihood."""
        w = np.zeros(x.shape[1])
        penalty = np.full(x.shape[1], ridge)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return w

    def scores(self, rows: list[tuple[Candidate, str]]) -> np.ndarray:
        if not rows or not self.ready:
            return np.array([float(weak_label(c) or 0) for c, _ in rows])
        raw = self._matrix(np.array([self._row(c, p) for c, p in rows])) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the spans blanked out; line ends and all lengths stay."""
    out, at = [], 0
    for a, b in sorted(spans):
        a = max(a, at)
        if b > a:
            out += [text[at:a], re.sub(r"[^\r\n]", BLANK, text[a:b])]
            at = b
    return "".join([*out, text[at:]])


def train(nodes: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` rows with a source, chosen by a hash of their id."""
    rows = nodes.where(F.col("source").isNotNull() & F.col("id").isNotNull() & (F.col("label") == "Module"))
    share = sample / max(1, rows.count())
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    # in the order of a hash, so that the same table gives the same model
    texts = picked.select(F.coalesce("file", "name", F.lit("")).alias("path"), "source").distinct().orderBy(F.xxhash64("path", "source")).limit(2 * sample).collect()
    return Model([(r.path, r.source) for r in texts])


def scan(nodes: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, sources: bool = False) -> DataFrame:
    """Credentials per row: id, lines (1-based, ascending, distinct) and, with ``sources``, the redacted source.

    Rows of any label whose source has at least one credential; null sources have
    none.  A key block counts on its first line, a value in several parts on the
    line of the first.  A repeated row is found as often as it comes.  The path is
    ``file``, else the second part of the id, else ``name``.
    """
    model = nodes.sparkSession.sparkContext.broadcast(train(nodes, sample))
    path = F.coalesce("file", F.get(F.split("id", ":"), 1), "name", F.lit(""))
    rows = spread(nodes.where(F.col("source").isNotNull()).select("id", path.alias("path"), "source"))

    def run(batches):
        judge = model.value
        for batch in batches:
            ids, lines, texts = [], [], []
            for i, path, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = candidates(text, path)
                if not found:
                    continue
                hits = [c for c, s in zip(found, judge.scores([(c, path) for c in found])) if s >= threshold]
                if hits:
                    ids.append(i)
                    lines.append(sorted({text.count("\n", 0, c.spans[0][0]) + 1 for c in hits}))
                    texts.append(redact(text, [s for c in hits for s in c.spans]) if sources else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lines, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["id", "lines", "redacted"])

    result = rows.mapInArrow(run, "id string, lines array<int>, redacted string")
    return result if sources else result.drop("redacted")


def places(nodes: DataFrame, **parameters) -> DataFrame:
    """(id, line_no), one row per line with a credential, however often the row is repeated."""
    return scan(nodes, **parameters).select("id", F.explode("lines").alias("line_no")).distinct()
