"""Encoding of whole tables with a public byte-level BPE (problem 8).

The rank file's vocabulary is serialised as a sentencepiece BPE model: every token
becomes a piece written in one printable character per byte, its score is the
negative rank, and the normaliser is the identity.  A text is split into
pre-tokens by the tokenizer's public pattern, each pre-token is written in those
characters and encoded by the model; a piece's id is its rank.  Decoding maps the
characters back to bytes.

Defined results: an empty text and a null text have an empty list of ids.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import re
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evidar.tables import spread

#: fixed value: the folder of the public tokenizers; a parameter of every function here
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: words kept in a worker's table before it is emptied
WORDS_KEPT = 400_000

# the pattern that splits a text before the merges, with its classes left open (fixed value)
_PATTERN = r" ?[{L}]+|'(?:[stmd]|re|ve|ll)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if it is printable Latin-1, else one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@functools.cache
def _class(prop: str, last: int) -> str:
    """The characters of a general category up to ``last`` as the inside of a character class."""
    import regex

    letters = [c for c in map(chr, itertools.chain(range(0xD800), range(0xE000, last + 1)))]
    found = [ord(c) for c in regex.findall(rf"\p{{{prop}}}", "".join(letters))]
    runs, start = [], 0
    for i in range(1, len(found) + 1):
        if i == len(found) or found[i] != found[i - 1] + 1:
            runs.append(f"\\U{found[start]:08x}-\\U{found[i - 1]:08x}")
            start = i
    return "".join(runs)


@functools.cache
def _splitter(last: int) -> re.Pattern:
    """The public pattern for texts of characters up to ``last``; small classes make the standard engine fast."""
    return re.compile(_PATTERN.replace("{L}", _class("L", last)).replace("{N}", _class("N", last)).replace("{S}", _SPACE))


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def split(text: str) -> list[str]:
    """The pre-tokens of a text."""
    last = 127 if text.isascii() else sys.maxunicode if _ASTRAL.search(text) else 0xFFFF
    return _splitter(last).findall(text)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a protocol buffer: bytes, a float or a number."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


@functools.cache
def model(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """A sentencepiece processor with the vocabulary of a rank file."""
    import sentencepiece

    letters = byte_characters()
    ranks = {}
    with open(os.path.join(folder, vocabulary), "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[int(rank)] = "".join(letters[b] for b in base64.b64decode(token))
    count = max(ranks) + 1
    # ModelProto: 1 pieces (1 text, 2 score, 3 type), 2 trainer, 3 normalizer; types 1 normal, 2 unknown, 5 unused
    out = bytearray()
    for rank in range(count):
        piece = ranks.get(rank)
        kind = 1 if piece else 5
        out += _field(1, _field(1, (piece or f"<unused{rank}>").encode()) + _field(2, -float(rank)) + _field(3, kind))
    out += _field(1, _field(1, b"<unk>") + _field(2, -float(count)) + _field(3, 2))
    minus_one = (1 << 64) - 1
    # trainer: 3 model type (2 BPE), 4 size, 40 unk, 41 bos, 42 eos and 43 pad id
    out += _field(2, _field(3, 2) + _field(4, count + 1) + _field(40, count) + _field(41, minus_one) + _field(42, minus_one) + _field(43, minus_one))
    # normalizer: 1 name, 3 dummy prefix, 4 extra white space, 5 escaping
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(out))


class _Words(dict):
    """Ids of pre-tokens, encoded when first asked for."""

    def __init__(self, folder: str, vocabulary: str):
        super().__init__()
        self.encode = model(folder, vocabulary).encode
        self.table = {b: c for b, c in enumerate(byte_characters())}

    def __missing__(self, word: str) -> tuple[int, ...]:
        # bytes as Latin-1 characters, then translated to the pieces' alphabet
        ids = self[word] = tuple(self.encode(word.encode("utf-8", "replace").decode("latin-1").translate(self.table)))
        return ids


@functools.cache
def _words(folder: str, vocabulary: str) -> _Words:
    return _Words(folder, vocabulary)


def encode(text: str | None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> list[int]:
    """Ids of one text; none for an empty or null text."""
    words = _words(folder, vocabulary)
    return list(itertools.chain.from_iterable(map(words.__getitem__, split(text or ""))))


def decode(ids: list[int], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> str:
    """The text of a list of ids."""
    sp = model(folder, vocabulary)
    back = {c: b for b, c in enumerate(byte_characters())}
    return bytes(back[c] for i in ids for c in sp.id_to_piece(int(i))).decode("utf-8", "replace")


def _batches(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, counts: bool) -> Iterator[pa.RecordBatch]:
    """The last column of each batch, a text, becomes its ids or their number."""
    words = _words(folder, vocabulary)
    get, chain = words.__getitem__, itertools.chain.from_iterable
    for batch in batches:
        if len(words) > WORDS_KEPT:
            words.clear()
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            lists = [np.fromiter(chain(map(get, split(t))), np.int32) if t else np.empty(0, np.int32) for t in part.column(part.num_columns - 1).to_pylist()]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            if counts:
                result = pa.array(sizes)
            else:
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                result = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], result], part.schema.names)


def encode_table(df: DataFrame, keep: list[str], text: str, out: str = "ids", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: the columns ``keep`` and ``out``, the ids of ``text`` as array<int>.

    Null and empty texts give an empty list, null keys stay null, repeated rows
    stay repeated, other columns are not read, an empty table gives an empty one.
    No shuffle, unless most cores would have nothing of the table.
    """
    return _apply(df, keep, text, out, folder, vocabulary, False)


def count_table(df: DataFrame, keep: list[str], text: str, out: str = "tokens", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: the columns ``keep`` and ``out``, the number of ids of ``text`` as bigint."""
    return _apply(df, keep, text, out, folder, vocabulary, True)


def _apply(df: DataFrame, keep: list[str], text: str, out: str, folder: str, vocabulary: str, counts: bool) -> DataFrame:
    source = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], df[text].alias("value"))
    kind = T.LongType() if counts else T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("value", kind)])

    def run(batches):
        return _batches(batches, folder, vocabulary, counts)

    return spread(source).mapInArrow(run, schema).toDF(*keep, out)
