"""Inverted indices: postings, document frequencies and the weights built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidar.functions.text import tokenize_code

#: parameters of BM25: saturation, length normalisation, floor of negative rarities
K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(docs: DataFrame, key: list[str], text: Column, terms=tokenize_code) -> DataFrame:
    """(key, term, tf): how often each term comes in each document; ``terms`` makes an array of terms from the text.

    Documents without terms and null texts have no rows; rows with equal keys are one document.
    Texts are shuffled by key before they become terms: a text is smaller than its
    postings, and these are then counted where they are.
    """
    rows = docs.select(*key, text.alias("text__")).repartition(*key)
    return rows.select(*key, F.explode(terms(F.col("text__"))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))


def frequencies(post: DataFrame) -> DataFrame:
    """(term, df)."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def bm25_idf(df: DataFrame, count: int) -> DataFrame:
    """(term, df, idf): probabilistic rarity; negative ones become EPSILON times the mean over the vocabulary."""
    raw = df.withColumn("raw", F.log(F.lit(count + 0.5) - F.col("df")) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))


def tfidf(post: DataFrame, df: DataFrame, key: list[str], count: int, smooth: bool = False) -> DataFrame:
    """(key, term, w): (ln tf + 1) * rarity with rows of unit length.

    The rarity is ln(N / df), or with ``smooth`` ln((1 + N) / (1 + df)) + 1.  A row
    of zeros stays zero.
    """
    rarity = F.log((1.0 + F.lit(count)) / (1.0 + F.col("df"))) + 1 if smooth else F.log(F.lit(float(count)) / F.col("df"))
    raw = post.join(df, "term").withColumn("raw", (F.log("tf") + 1) * rarity)
    norm = raw.groupBy(*[F.col(k).alias(f"{k}__key") for k in key]).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    on = [F.col(k) == F.col(f"{k}__key") for k in key]
    return raw.join(norm, on).select(*key, "term", F.when(F.col("norm") > 0, F.col("raw") / F.col("norm")).otherwise(0.0).alias("w"))
