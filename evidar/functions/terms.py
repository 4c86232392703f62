"""Terms of texts in natural language and of code, as Columns: stop words, stems, names."""

from __future__ import annotations

import keyword

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .porter import stem
from .text import tokenize_code

# fixed values: English stop words besides those Spark knows by default, and those of Spark's that are none here
MORE = (
    "across afterwards almost alone along already also although always among amongst amoungst amount another anyhow anyone anything anyway anywhere around back became become becomes becoming "
    "beforehand behind beside besides beyond bill bottom call cant co con couldnt cry de describe detail done due eg eight either eleven else elsewhere empty enough etc even ever every everyone "
    "everything everywhere except fifteen fifty fill find fire first five former formerly forty found four front full get give go hasnt hence hereafter hereby herein hereupon however hundred ie inc "
    "indeed interest keep last latter latterly least less ltd made many may meanwhile might mill mine moreover mostly move much must name namely neither never nevertheless next nine nobody none noone "
    "nothing nowhere often one onto others otherwise part per perhaps please put rather re see seem seemed seeming seems serious several show side since sincere six sixty somehow someone something "
    "sometime sometimes somewhere still system take ten thence thereafter thereby therefore therein thereupon thick thin third though three throughout thru thus together top toward towards twelve "
    "twenty two un upon us via well whatever whence whenever whereafter whereas whereby wherein whereupon wherever whether whither whoever whole whose within without yet"
).split()
FEWER = "did does doing don having just ought s t theirs".split()
# fixed values: what counts as a word of code, and the names in it
_WORD = r"[\p{L}\p{N}_]"
NAME = rf"[A-Za-z_]{_WORD}*(?:\.[A-Za-z_]{_WORD}*)*"
CODE = rf"`[^`\n]+`|{NAME}\(?"


def stop_words(spark: SparkSession) -> list[str]:
    """English stop words: those Spark knows by default, with ``MORE`` and without ``FEWER``."""
    known = spark._jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords("english")
    return sorted({str(w) for w in known if str(w).isalnum()} - set(FEWER) | set(MORE))


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Each word's stem; a word is stemmed once for a batch of texts."""
    seen: dict[str, str] = {}

    def one(word: str) -> str:
        got = seen.get(word)
        if got is None:
            got = seen[word] = stem(word)
        return got

    return words.map(lambda own: [one(w) for w in own] if own is not None else None)


def issue_terms(text: Column, stop: list[str]) -> Column:
    """Stems of the words of a text that are no stop words, in their order."""
    return stems(F.filter(tokenize_code(text), lambda w: ~w.isin(stop)))


def nl_terms(text: Column, stop: list[str]) -> Column:
    """The same without the keywords of Python."""
    return issue_terms(text, sorted({*stop, *(k.lower() for k in keyword.kwlist)}))


def code_terms(text: Column) -> Column:
    """Words that look like code, whole and, if dotted, in parts: in back-ticks, before a bracket, with a dot or underscore, or with a capital inside."""

    def told(word: Column) -> Column:
        bare = F.regexp_replace(word, r"\($", "")
        looks = word.endswith("(") | bare.contains("_") | bare.contains(".") | F.substring(bare, 2, 1 << 30).rlike(r"\p{Lu}")
        return F.when(word.startswith("`"), F.regexp_extract_all(word, F.lit(NAME), 0)).when(looks, F.array(bare)).otherwise(F.array().cast("array<string>"))

    words = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CODE), 0), told))
    return F.flatten(F.transform(words, lambda w: F.when(w.contains("."), F.concat(F.array(w), F.split(w, r"\."))).otherwise(F.array(w))))
