"""Keyword-stuffed pages and link lists (problem 10): pointwise mutual information of neighbouring words.

A text is cut into segments (lines, and sentences in them).  For every pair of
neighbouring words the pointwise mutual information comes from the occurrences of
the pair and of each word in the whole corpus, without the document itself and its
copies.  A segment is stuffing if its pairs mean little to one another (word salad),
if most of them are collocations the document repeats although the corpus hardly
knows them, or if it is made of links or tags.  A document is reported if such
segments hold more than half of its characters.

The counts are exact (words and pairs are told apart by hashes of 64 bits) and stay
distributed.  Distinct texts are put into blocks of about equal size; a block states
how often it has each word and pair, the sums over all blocks go back to the blocks
that have them, and a block's texts are judged with its own part of the counts.  So
no table of the corpus is broadcast or collected, whatever its vocabulary, and every
document is judged.  Copies of a text count once and are judged once.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidar.operators.skew import lookup
from evidar.tables import durable, spread

#: bytes of text in a block
BLOCK_BYTES = 8 << 20
#: a segment whose pairs have a lower mean is word salad, if it has so many pairs and this share of them come together no more often than chance would have it
SALAD, SALAD_PAIRS, ODD = 1.9, 4, 0.1
#: a pair found so often in one document, but elsewhere with a smaller share of all words, is a repeated collocation
REPEATED, COMMON = 3, 2e-5
#: share of repeated pairs that makes a segment stuffing
STUFFED = 0.34
#: lines of fewer words, if no sentence ends there, are read together
SHORT = 6
#: share of the characters that makes a document stuffing
MOST = 0.5

_SEGMENT = re.compile(r"(?:[^\n.!?。！？]+|[.!?](?!\s))*[.!?。！？]?[^\S\n]*\n?")
_ENDED = re.compile(r"[.!?。！？{};:]\s*\Z")
_CUT = "\x00"
_LETTERS = "[^\\W\\d_\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+|[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"
_WORD = re.compile(_LETTERS)
_TOKEN, _ASCII_TOKEN = re.compile(_LETTERS + "|\x00"), re.compile("[a-z]+|\x00")
_URL = re.compile(r"(?:https?|ftp)://[^\s<>\"')\]]+|\bwww\.[^\s<>\"')\]]+")
_ANCHOR = re.compile(r"<a\s[^>]*>[^<]*</a>|\[[^\]\n]*\]\([^)\n]*\)|`[^`<\n]*<[^>\n]*>`_{1,2}")
_HASHTAG = re.compile(r"(?<!\S)#[^\W\d]\w*")
_TAGS = re.compile(r"(?i)(?:\b(?:tags?|keywords?|labels?|schlagwörter|stichworte|từ khóa|thẻ)|タグ|キーワード)\s*[:：]")
_PRICE = re.compile(r"[$€£¥]\s?\d[\d.,]*|\d[\d.,]*\s?[€₫]")
_CODE = re.compile(r"[{}()\[\]=<>\\]|\w[._]\w|::|->")
_LOG = re.compile(r"\s*(?:\[?\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d|(?:INFO|WARN|ERROR|DEBUG)\b)")
_ROW = re.compile(r"\s*\|.*\|\s*\Z|\s*[+|:=\-]{3,}")
_DEFINED = re.compile(r"\s*(?:\*\*[^*\n]{1,60}\*\*|`[^`\n]{1,60}`|:?[^\n:,|·]{1,40}:|[^\n,|·]{1,40} [–—-] )")
_SEPARATOR = re.compile(r"[,|·/;]")
_FENCE = re.compile(r"\s*(?:```|~~~)")


class _Ids(dict):
    """A hash of each word, kept; 0 is kept for the number of all words."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) | 1
        return h


@cache
def _ids() -> _Ids:
    return _Ids()


def segments(text: str) -> list[str]:
    """Lines, and sentences in them; runs of lines of a few words are one segment.  Together the whole text."""
    out: list[str] = []
    short = False
    for x in _SEGMENT.findall(text):
        if not x:
            continue
        brief = len(x) < 48 and x[-1] == "\n" and x.count(" ") < SHORT and not _ENDED.search(x)
        if brief and short and not x.isspace():
            out[-1] += x
        else:
            out.append(x)
        short = brief and not x.isspace()
    return out


def _hashes(text: str) -> np.ndarray:
    ids = _ids()
    if len(ids) > 500_000:
        ids.clear()
    found = (_ASCII_TOKEN if text.isascii() else _TOKEN).findall(text.lower())
    return np.fromiter(map(ids.__getitem__, found), np.uint64, len(found))


def words(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts in lower case, and which text each is in.

    Words are runs of letters, and single characters of scripts without spaces.
    """
    text = _CUT.join(parts)
    if text.count(_CUT) >= len(parts):
        text = _CUT.join(p.replace(_CUT, " ") for p in parts)
    hashed = _hashes(text)
    cut = hashed == _ids()[_CUT]
    owner = np.cumsum(cut)[~cut]
    return hashed[~cut], owner


def _batches(texts: list[str]) -> list[list[int]]:
    """Positions of texts to be read together: those in ASCII, which are read faster, and the others, up to 512 KB each."""
    kinds: list[list[int]] = [[], []]
    for i, t in enumerate(texts):
        kinds[not t.isascii()].append(i)
    out = []
    for kind in kinds:
        size = 1 << 30
        for i in kind:
            if size > 1 << 19:
                out.append([])
                size = 0
            out[-1].append(i)
            size += len(texts[i])
    return out


def _pairs(w: np.ndarray) -> np.ndarray:
    """A hash of every two words that follow one another; even, as those of words are odd."""
    with np.errstate(over="ignore"):
        mixed = w[:-1] * np.uint64(0x9E3779B97F4A7C15) + (w[1:] ^ (w[1:] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(32)
    return mixed & ~np.uint64(1) | np.uint64(2)


def _bare(text: str) -> str:
    return _URL.sub(" ", text) if "://" in text or "www." in text else text


def _tally(keys: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums per key."""
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(back, np.concatenate(ns), len(key)).astype(np.int64)


def tally(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often texts have each word and pair, by hash; under 0 the number of their words.  Addresses are left out."""
    keys, ns = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)]
    for part in _batches(texts):
        bare = ["".join(map(_bare, segments(t))) if "://" in t or "www." in t else t for t in (texts[i] for i in part)]
        w, owner = words(bare)
        ns[0][0] += len(w)
        for x in (w, _pairs(w)[owner[:-1] == owner[1:]] if len(w) else w):
            key, n = np.unique(x, return_counts=True)
            keys.append(key)
            ns.append(n)
        if len(keys) > 64:
            key, n = _tally(keys, ns)
            keys, ns = [np.zeros(1, np.uint64), key[1:]], [n[:1].copy(), n[1:]]
    return _tally(keys, ns)


class Judge:
    """Applies the counts of a corpus that hold for the words and pairs of some of its texts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.counts = keys[order], counts[order]
        self.total = float(max(2, self.counts[0] if len(keys) and self.keys[0] == 0 else 2))

    def _count(self, keys: np.ndarray) -> np.ndarray:
        """Occurrences in the corpus; keys it hasn't have none."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)

    def scores(self, texts: list[str]) -> list[tuple[float, float]]:
        """Of each text the share of its characters in stuffing segments, and the mean information of its pairs."""
        out = [(0.0, 0.0)] * len(texts)
        for part in _batches(texts):
            for i, got in zip(part, self._scores([texts[i] for i in part])):
                out[i] = got
        return out

    def _elsewhere(self, keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each key is in its own text, and how often in the rest of the corpus."""
        distinct, back = np.unique(keys, return_inverse=True)
        # texts of a batch are few and their keys numbered, so own occurrences are counted in a table if it isn't large
        slots, cell = len(distinct) * (int(text[-1]) + 1), back.astype(np.int64) * (int(text[-1]) + 1) + text
        if slots < 1 << 24:
            often = np.bincount(cell, minlength=slots)[cell]
        else:
            _, own, often = np.unique(cell, return_inverse=True, return_counts=True)
            often = often[own]
        return often, np.maximum(self._count(distinct)[back] - often, 0)

    def _scores(self, texts: list[str]) -> list[tuple[float, float]]:
        segs, of_text = [], []
        for i, t in enumerate(texts):
            own = segments(t)
            segs += own
            of_text += [i] * len(own)
        sizes = np.array([len(s.strip()) for s in segs], np.int64)
        of_text = np.array(of_text, np.int64)
        whole = np.maximum(np.bincount(of_text, sizes, len(texts)), 1)
        w, segment = words([_URL.sub(" ", s) if "://" in s or "www." in s else s for s in segs]) if segs else (np.empty(0, np.uint64), np.empty(0, np.int64))
        k = len(segs)
        pairs, mean, again, odd, information = np.zeros(k, np.int64), np.zeros(k), np.zeros(k), np.zeros(k), np.zeros(len(texts))
        if len(w) > 1:
            text = of_text[segment]
            at = np.flatnonzero(text[:-1] == text[1:])
            often, other = self._elsewhere(_pairs(w)[at], text[at]) if len(at) else (np.empty(0, np.int64),) * 2
            single = self._elsewhere(w, text)[1] + 1.0
            pmi = np.log((other + 0.02) * self.total / (single[at] * single[at + 1]))
            # a pair no other document has says nothing in favour of it
            pmi = np.where(other > 0, pmi, np.minimum(pmi, 0.0))
            repeated = (often >= REPEATED) & (other < COMMON * self.total)
            n = np.bincount(text[at], minlength=len(texts))
            information = np.bincount(text[at], pmi, len(texts)) / np.maximum(n, 1)
            inside = segment[at] == segment[at + 1]
            of = segment[at][inside]
            pairs = np.bincount(of, minlength=k)
            mean = np.bincount(of, pmi[inside], k) / np.maximum(pairs, 1)
            again = np.bincount(of, repeated[inside], k) / np.maximum(pairs, 1)
            odd = np.bincount(of, pmi[inside] <= 0, k) / np.maximum(pairs, 1)
        stuffed = np.zeros(len(texts), np.int64)
        fenced, last = False, -1
        told = zip(segs, of_text.tolist(), sizes.tolist(), pairs.tolist(), mean.tolist(), again.tolist(), odd.tolist())
        for s, i, size, n, m, a, o in told:
            if i != last:
                fenced, last = False, i
            if "`" in s or "~" in s:
                if _FENCE.match(s):
                    fenced = not fenced
                    continue
            if size and not fenced and self._stuffing(s, n, m, a, o):
                stuffed[i] += size
        return list(zip((stuffed / whole).tolist(), information.tolist()))

    def _stuffing(self, s: str, pairs: int, mean: float, again: float, odd: float) -> bool:
        if "://" in s or "www." in s:
            rest = _WORD.findall(_URL.sub("", _ANCHOR.sub("", s)).lower())
            return len(rest) < 8 or mean < SALAD
        if "#" in s and sum(map(len, _HASHTAG.findall(s))) > 0.6 * len(s.strip()):
            return True
        if ("$" in s or "€" in s or "£" in s or "¥" in s or "₫" in s) and (n := len(_PRICE.findall(s))) and pairs < 8 * n and not _ENDED.search(s):
            return True
        if (":" in s or "：" in s) and mean < SALAD + 0.5 and _TAGS.search(s):
            return True
        if s.count(",") + s.count("|") + s.count("·") + s.count("/") + s.count(";") > 4:
            items = [x for x in (" ".join(y.lower().split()) for y in _SEPARATOR.split(s)) if x]
            if len(items) > 5 and pairs < 5 * len(items) and not _CODE.search(s):
                # a list of short items most of which begin like another one
                heads = Counter(" ".join(x.split(" ")[:2]) for x in items)
                if sum(n for n in heads.values() if n > 1) > 0.5 * len(items):
                    return not (_LOG.match(s) or _ROW.match(s))
        if pairs >= 2 and again >= STUFFED:
            return not (_LOG.match(s) or _ROW.match(s))
        if pairs < SALAD_PAIRS or mean >= SALAD or odd < ODD:
            return False
        return not (_LOG.match(s) or _ROW.match(s) or _DEFINED.match(s) or len(_CODE.findall(s)) > 1)


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per distinct key with a text: key, stuffed (share of characters), information (mean), found.

    Null texts have no row; an empty or blank text has shares of 0 and isn't found;
    a repeated key is reported if any of its texts is.
    """
    session = docs.sparkSession
    rows = spread(docs.where(docs[text].isNotNull()).select(docs[key].alias("key"), docs[text].alias("text")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def once(batches):
        """Each text of a task once, with the number of times it came."""
        seen: dict[bytes, list] = {}
        for batch in batches:
            fresh, marks = [], []
            for i, t in enumerate(batch.column(0).to_pylist()):
                mark = hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
                if mark in seen:
                    seen[mark] += 1
                else:
                    seen[mark] = 0
                    fresh.append(i)
                    marks.append(mark)
            yield _texts(marks, batch.column(0).take(pa.array(fresh, pa.int32())), [1] * len(marks))
        more = [(m, n) for m, n in seen.items() if n]
        for i in range(0, len(more), 10_000):
            part = more[i: i + 10_000]
            yield _texts([m for m, _ in part], pa.nulls(len(part), pa.string()), [n for _, n in part])

    def _texts(marks, texts, n):
        place = [int.from_bytes(m[:8], "big") % blocks for m in marks]
        return pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(marks, pa.binary()), texts, pa.array(n, pa.int64())], ["block", "mark", "text", "n"])

    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), blocks)
    # the only time texts are shuffled; all that follows groups by block
    placed = rows.select("text").mapInArrow(once, "block int, mark binary, text string, n bigint").repartition(parts, "block")
    texts = placed.where("text is not null").select("block", "mark", "text").distinct()

    def count(batches):
        found: dict[int, list] = {}
        for batch in batches:
            by: dict[int, list] = {}
            for b, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                by.setdefault(b, []).append(t)
            for b, own in by.items():
                key, n = tally(own)
                keys, ns = found.setdefault(b, [[], []])
                keys.append(key)
                ns.append(n)
                if len(keys) > 16:
                    key, n = _tally(keys, ns)
                    keys[:], ns[:] = [key], [n]
        for b, (keys, ns) in found.items():
            key, n = _tally(keys, ns)
            for i in range(0, len(key), 100_000):
                part = key[i: i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), b, np.int32)), pa.array(part.view(np.int64)), pa.array(n[i: i + 100_000])], ["block", "slot", "n"])

    told = texts.mapInArrow(count, "block int, slot bigint, n bigint")
    # a word or pair has at most one row per block here
    known = told.select("block", "slot", F.sum("n").over(Window.partitionBy("slot")).alias("n"))

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        judge = Judge(right.column("slot").to_numpy().view(np.uint64), right.column("n").to_numpy())
        marks, got = left.column("mark"), []
        for batch in left.select(["text"]).to_batches(max_chunksize=2_000):
            got += judge.scores(batch.column(0).to_pylist())
        return pa.table({"mark": marks, "stuffed": pa.array([round(a, 6) for a, _ in got], pa.float64()), "information": pa.array([round(b, 6) for _, b in got], pa.float64()), "found": pa.array([a > MOST for a, _ in got], pa.bool_())})

    result = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(judged, "mark binary, stuffed double, information double, found boolean")
    copies = placed.groupBy("mark").agg(F.sum("n").alias("copies"))
    result = durable(result.join(copies, "mark"))
    marked = rows.select("key", F.unhex(F.md5("text")).alias("mark"))
    full = lookup(marked, result, ["mark"], "copies")
    return full.groupBy("key").agg(F.max("stuffed").alias("stuffed"), F.min("information").alias("information"), F.max("found").alias("found")).withColumnRenamed("key", key)
