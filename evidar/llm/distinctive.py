"""How distinctive each term is of its record (problem 4): graph-of-words weighting.

In every record the terms within ``window`` places of one another are joined by an
edge; a term's weight is the number of its distinct neighbours instead of its
frequency, times the rarity ln(records / records with the term).
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.operators.graph import last_version
from evidar.operators.skew import lookup
from evidar.tables import stored

#: places within which two terms are neighbours
WINDOW = 3
_RUN = re.compile(r"[A-Za-z0-9]+")
_SCHEMA = "kind string, rec string, term string, tf bigint, degree bigint"


def terms(text: str) -> list[str]:
    """Maximal runs of ASCII letters and digits that are letters only, at least four, in lower case."""
    return [r.lower() for r in _RUN.findall(text) if len(r) > 3 and r.isalpha()]


def graph(words: list[str], window: int = WINDOW) -> dict[str, list[int]]:
    """Frequency and degree of every term; a term is no neighbour of itself."""
    near: dict[str, set] = defaultdict(set)
    seen: dict[str, int] = defaultdict(int)
    for i, w in enumerate(words):
        seen[w] += 1
        for v in words[max(0, i - window): i]:
            if v != w:
                near[w].add(v)
                near[v].add(w)
    return {w: [n, len(near[w])] for w, n in seen.items()}


def records(units: DataFrame, reports: DataFrame) -> DataFrame:
    """(kind, rec, text): commits by h, and of each report the version fetched last.

    A null title, body or message counts as empty.  A commit loaded twice is one
    record; of versions that differ though loaded at the same time the greatest
    text is taken.  Rows with a null key are no records.
    """
    blank = F.lit("")
    commits = units.where("h is not null").select(F.col("h").alias("key"), F.coalesce("msg", blank).alias("text"), F.col("loaded_at").alias("at"))
    issues = reports.where("n is not null").select(F.col("n").cast("string").alias("key"), F.concat(F.coalesce("title", blank), F.lit("\n"), F.coalesce("body", blank)).alias("text"), F.col("fetched_at").alias("at"))
    # only the texts of records that come several times are compared; the others aren't moved for it
    newest = lambda rows, kind: last_version(rows, ["key"], F.col("at")).select(F.lit(kind).alias("kind"), F.col("key").alias("rec"), "text")
    return newest(commits, "unit").unionByName(newest(issues, "report"))


def postings(recs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(kind, rec, term, tf, degree), one row per term of a record; records need (kind, rec, text)."""

    def build(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                cols = [[], [], [], [], []]
                for kind, rec, text in zip(*(c.to_pylist() for c in part.columns)):
                    for term, (tf, degree) in graph(terms(text or ""), window).items():
                        for c, v in zip(cols, (kind, rec, term, tf, degree)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), *(pa.array(c, pa.int64()) for c in cols[3:])], ["kind", "rec", "term", "tf", "degree"])

    return recs.select("kind", "rec", "text").mapInArrow(build, _SCHEMA)


def scores(recs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(kind, rec, term, tf, degree, df, score) for every term of every record.

    ``df`` is the number of records of all kinds that have the term; ``score`` is
    degree * ln(records / df), 0 for a term that all records have or that stands
    alone.  Records without terms have no rows; an empty table gives none.
    """
    count = max(1, recs.count())
    # more rows than the input has words would be read three times: written once, column by column
    found = stored(postings(recs, window))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    df = df.withColumn("rows", F.col("df"))
    joined = lookup(found, df, ["term"], "rows")
    return joined.select("kind", "rec", "term", "tf", "degree", "df", F.round(F.col("degree") * F.log(F.lit(float(count)) / F.col("df")), 6).alias("score"))


def shared_rare(scored: DataFrame, least_tf: int = 3, least_df: int = 2, most_df: int = 8) -> DataFrame:
    """(kind, rec, term): terms that a record repeats and that few other records share."""
    return scored.where((F.col("tf") >= least_tf) & F.col("df").between(least_df, most_df)).select("kind", "rec", "term")
