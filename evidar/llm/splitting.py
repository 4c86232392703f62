"""Cutting oversized texts at natural boundaries (problem 2): structure-tree packing.

A text is parsed into a tree: sections by heading level, in them blocks (fenced
code, tables, lists, paragraphs), in those list items with their nested lines,
lines, sentences, words and, last, characters.  Sibling subtrees are merged from
the bottom up as long as they fit the limit; only a node that is too large is
descended into.  A piece after the first begins with up to ``overlap`` characters
of the one before, from the earliest line, sentence or word that begins there.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1600, 200

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
_MARK = re.compile(r"(#{1,6})\s+\S")
_RULE = re.compile(r"([=\-~^\"'`#*+.:_])\1{2,}\s*\Z")
_ITEM = re.compile(r"(\s*)(?:[-*+•・]|\d{1,3}[.)]|\*\*[^*]+\*\*:)\s+")
_FENCE = re.compile(r"\s*(```|~~~)")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])")
_WORD = re.compile(r"\s+")
_SPACE = re.compile(r"[^\S\r\n]+|\r\n|\n|\r")


def _lines(text: str, start: int, end: int) -> list[tuple[int, int]]:
    out, at = [], start
    while at < end:
        stop = min(_LINE.match(text, at).end(), end)
        out.append((at, stop))
        at = stop
    return out


def _cut(pattern: re.Pattern, text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans that begin after each match, together the whole."""
    ends = [m.end() for m in pattern.finditer(text, start, end) if start < m.end() < end]
    return list(zip([start, *ends], [*ends, end]))


def _sections(text: str, lines: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(line number, level) of each heading: marked ones, and lines with a rule of the same length below."""
    found, fenced, rules = [], False, []
    bare = [text[a:b].strip() for a, b in lines]
    for i, line in enumerate(bare):
        if _FENCE.match(line):
            fenced = not fenced
        if fenced or not line:
            continue
        if m := _MARK.match(line):
            found.append((i, len(m.group(1))))
        elif i + 1 < len(bare) and (m := _RULE.match(bare[i + 1])) and not _RULE.match(line) and "|" not in line and (i == 0 or not bare[i - 1]) and len(bare[i + 1]) >= len(line) * 0.6:
            if m.group(1) not in rules:
                rules.append(m.group(1))
            found.append((i, 1 + rules.index(m.group(1))))
    return found


def _blocks(text: str, lines: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Lines by block; blank lines end a block and stay with it, a fenced block is one."""
    out: list[list[tuple[int, int]]] = []
    current: list[tuple[int, int]] = []
    fenced = ended = False
    for a, b in lines:
        line = text[a:b]
        blank = not line.strip()
        fence = bool(_FENCE.match(line))
        if current and ended and not blank or (fence and not fenced and current):
            out.append(current)
            current = []
        ended = blank and not fenced
        current.append((a, b))
        if fence:
            fenced = not fenced
    if current:
        out.append(current)
    return out


def _children(text: str, kind: str, start: int, end: int, level: int) -> list[tuple[str, int, int, int]]:
    """Subtrees of a node as (kind, start, end, level)."""
    if kind == "section":
        lines = _lines(text, start, end)
        heads = _sections(text, lines)
        inner = [(i, v) for i, v in heads if i > 0 or v > level]
        if inner:
            top = min(v for _, v in inner)
            starts = [lines[i][0] for i, v in inner if v == top]
            parts = [start, *[s for s in starts if s > start]]
            return [("section" if a in starts else "body", a, b, top if a in starts else level) for a, b in zip(parts, [*parts[1:], end])]
        kind = "body"
    if kind == "body":
        return [("block", x[0][0], x[-1][1], 0) for x in _blocks(text, _lines(text, start, end))]
    if kind == "block":
        items: list[list[int]] = []
        indent = None
        for a, b in _lines(text, start, end):
            m = _ITEM.match(text, a, b)
            if m and (indent is None or len(m.group(1)) <= indent):
                indent = len(m.group(1))
                items.append([a, b])
            elif items:
                items[-1][1] = b
            else:
                items.append([a, b])
        if len(items) > 1:
            return [("item", a, b, 0) for a, b in items]
        kind = "item"
    if kind == "item":
        return [("line", a, b, 0) for a, b in _lines(text, start, end)]
    if kind == "line":
        return [("sentence", a, b, 0) for a, b in _cut(_SENTENCE, text, start, end)]
    if kind == "sentence":
        return [("word", a, b, 0) for a, b in _cut(_WORD, text, start, end)]
    return []


_NEXT = {"section": "body", "body": "block", "block": "item", "item": "line", "line": "sentence", "sentence": "word"}


def _pack(text: str, kind: str, start: int, end: int, level: int, limit: int, first: int) -> list[tuple[int, int]]:
    """Consecutive spans of at most ``limit`` characters, ``first`` for one that begins the text, that make up the node."""
    if end - start <= (limit if start else first):
        return [(start, end)]
    if kind == "word":
        out = []
        while start < end:
            stop = min(start + (limit if start else first), end)
            if stop < end and text[stop - 1] == "\r" and text[stop] == "\n":
                stop -= 1
            out.append((start, stop))
            start = stop
        return out
    parts = _children(text, kind, start, end, level)
    if len(parts) < 2:
        return _pack(text, parts[0][0], start, end, parts[0][3], limit, first) if parts else _pack(text, _NEXT[kind], start, end, level, limit, first)
    packed: list[tuple[int, int]] = []
    for k, a, b, v in parts:
        spans = _pack(text, k, a, b, v, limit, first)
        if packed and len(spans) == 1 and b - packed[-1][0] <= (limit if packed[-1][0] else first):
            packed[-1] = (packed[-1][0], b)
        else:
            packed += spans
    return packed


def _back(text: str, start: int, floor: int) -> int:
    """Where the overlap before ``start`` begins: the first line, else sentence, else word that begins at ``floor`` or later."""
    for pattern in (re.compile(r"\r\n|\r(?!\n)|\n"), _SENTENCE, _SPACE):
        for m in pattern.finditer(text, floor, start):
            if floor < m.end() < start:
                return m.end()
    return floor + (text[floor - 1: floor + 1] == "\r\n")


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces of a text as (begin with overlap, begin of what is new, end).

    A text within the limit is one piece, an empty one none.
    """
    if not text:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text))]
    out = []
    for start, end in _pack(text, "section", 0, len(text), 0, limit - overlap, limit):
        begin = start if not out or not overlap else _back(text, start, max(out[-1][0] + 1, start - overlap))
        out.append((begin, start, end))
    return out


def pieces(df: DataFrame, key: str = "id", text: str = "text", heading: str = "heading", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every row whose text is longer than ``limit`` code points.

    Columns: id, heading (the row's own, null kept), piece (from 0), new_at (where
    in the text the piece's new part begins), overlap (characters before it) and
    text.  Rows that are equal in key, heading and text give one set of pieces;
    null, empty and short texts none.  Joining each piece's text from ``overlap`` on
    gives the text back exactly.
    """
    return _split(_oversized(df, key, text, heading, limit).distinct(), limit, overlap)


def oversized(df: DataFrame, key: str = "id", text: str = "text", heading: str = "heading", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id): keys of the rows that were cut, once each; texts are cut where they lie and only keys are shuffled."""
    return _split(_oversized(df, key, text, heading, limit), limit, overlap, texts=False).select("id").distinct()


def _oversized(df: DataFrame, key: str, text: str, heading: str, limit: int) -> DataFrame:
    return df.select(df[key].alias("id"), df[heading].alias("heading"), df[text].alias("text")).where(F.length("text") > limit)


def _split(rows: DataFrame, limit: int, overlap: int, texts: bool = True) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                take, number, at, over, out = [], [], [], [], []
                for row, t in enumerate(part.column(2).to_pylist()):
                    for n, (a, b, c) in enumerate(split(t, limit, overlap)):
                        take.append(row)
                        number.append(n)
                        at.append(b)
                        over.append(b - a)
                        out.append(t[a:c] if texts else None)
                keep = part.take(pa.array(take, pa.int32()))
                yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1), pa.array(number, pa.int32()), pa.array(at, pa.int32()), pa.array(over, pa.int32()), pa.array(out, pa.string())], ["id", "heading", "piece", "new_at", "overlap", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, heading string, piece int, new_at int, overlap int, text string")
