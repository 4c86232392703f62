"""Mixing records of several sources to target shares of the total size (problem 9).

A low-discrepancy schedule: slot n of the mix gets the point frac(n * golden ratio),
and the source into whose interval of the cumulative weights it falls.  The k-th
slot of a source takes the k-th block of it; blocks are runs of about equal token
numbers of the source's records in the order of a hash, and begin anew when all
have been used, at most ``max_repeat`` times.

Sizes are counted in tokens.  By default the mix is the largest in which every
source that has records reaches its share (shares divided by their sum over those
sources) within its cap on repetition; its size follows the data.  A larger mix
may be asked for; a source that cannot fill its slots then leaves them empty, and
the report shows it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.operators.prefix import running_total
from evidar.tables import durable

from . import tokenizer

#: most sources with a target; the schedule holds their weights
SOURCES = 10_000
#: blocks the smallest source's part of the mix is cut into; a block shorter than a record may have none
BLOCKS = 256
#: rows of a source that meet in one task while its records are put in order
CELL_ROWS = 20_000
_GOLDEN = 0x9E3779B97F4A7C15  # 2^64 / golden ratio (fixed value)


def sizes(records: DataFrame, key: str, text: str, source: str, folder: str = tokenizer.TOKENIZERS) -> DataFrame:
    """Tokens of every record: (key, source, tokens)."""
    return tokenizer.count_table(records, [key, source], text, "tokens", folder).toDF("key", "source", "tokens")


def plan(sized: DataFrame, targets: DataFrame, size: int | None = None) -> tuple[list[dict], int]:
    """Weights, blocks and caps of each source, and the number of slots.

    ``targets`` has (source, share, max_repeat); a source named twice counts once
    with its largest share.  Shares that are null or not positive are none.
    """
    have = sized.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("tokens"))
    wanted = targets.where("source is not null and share > 0 and max_repeat > 0").groupBy("source").agg(F.max("share").alias("share"), F.max("max_repeat").alias("max_repeat"))
    rows = [r.asDict() for r in wanted.join(have, "source").orderBy("source").limit(SOURCES + 1).collect()]
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources with a target")
    if not rows:
        return [], 0
    whole = sum(r["share"] for r in rows)
    most = min(r["tokens"] * r["max_repeat"] * whole / r["share"] for r in rows)
    total = most if size is None else size
    block = max(1.0, total * min(r["share"] for r in rows) / whole / BLOCKS)
    for r in rows:
        r["blocks"] = max(1, round(r["tokens"] / block))
        r["block"] = r["tokens"] / r["blocks"]
        r["weight"] = r["share"] / whole / r["block"]
        r["target"] = r["share"] / whole * total
    slots = sum(r["weight"] for r in rows) * total
    return rows, max(1, round(slots))


def schedule(spark, rows: list[dict], slots: int) -> DataFrame:
    """(slot, source, k): which source each slot belongs to, and the how-manieth of the source it is."""
    bounds = np.cumsum([r["weight"] for r in rows])
    bounds = bounds / bounds[-1]

    def place(batches):
        for batch in batches:
            n = batch.column(0).to_numpy().astype(np.uint64)
            at = ((n + np.uint64(1)) * np.uint64(_GOLDEN)).astype(np.float64) / 2.0**64
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.minimum(np.searchsorted(bounds, at, "right"), len(bounds) - 1).astype(np.int32))], ["slot", "place"])

    placed = spark.range(slots).toDF("slot").mapInArrow(place, "slot bigint, place int")
    return running_total(placed, "place", F.col("slot") * F.lit((1 << 62) // slots), F.lit(1), "k", cells=max(16, slots // 100_000))


def mix(records: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", size: int | None = None, seed: int = 42, folder: str = tokenizer.TOKENIZERS) -> DataFrame:
    """One row per use of a record: slot, source, ``key``, use (0 for the first), tokens.

    Records without tokens (null or empty text) and records of a source without a
    target, null included, are not used; a source without records is not in the
    result; equal rows are records of their own.  An empty table gives an empty mix.
    """
    spark = records.sparkSession
    sized = durable(sizes(records, key, text, source, folder))
    rows, slots = plan(sized, targets, size)
    if not rows:
        return sized.where("false").select(F.lit(0).cast("bigint").alias("slot"), "source", F.col("key").alias(key), F.lit(0).alias("use"), "tokens")
    table = spark.createDataFrame([(i, r["source"], float(r["block"]), r["blocks"], r["max_repeat"]) for i, r in enumerate(rows)], "place int, source string, block double, blocks bigint, max_repeat int")
    # the plan is bounded by SOURCES, so it may be broadcast
    own = sized.where("tokens > 0").join(F.broadcast(table.select("place", "source", "block", "blocks")), "source")
    own = running_total(own, "place", F.xxhash64(F.lit(seed), "key").bitwiseAND(F.lit((1 << 62) - 1)), F.col("tokens"), "start", cells=max(16, sized.count() // CELL_ROWS), tie=["key"])
    own = own.withColumn("number", F.least(F.floor(F.col("start") / F.col("block")), F.col("blocks") - 1))
    turns = (
        schedule(spark, rows, slots)
        .join(F.broadcast(table.select("place", "blocks", "max_repeat")), "place")
        .select("slot", "place", F.expr("k div blocks").cast("int").alias("use"), F.expr("k % blocks").alias("number"), "max_repeat")
        .where("use < max_repeat")
    )
    mixed = durable(turns.join(own, ["place", "number"]).select("place", "slot", "source", "key", "use", "tokens"))
    return _trimmed(mixed, rows).select("slot", "source", F.col("key").alias(key), "use", "tokens")


def _trimmed(mixed: DataFrame, rows: list[dict]) -> DataFrame:
    """The mix without, of each source, the one use of a record that brings it nearest to its share.

    Blocks end with the record that passes their end, so a source has up to a record
    too much; of all its uses the one is left out whose size is nearest to that.
    """
    over = mixed.groupBy("place").agg(F.sum("tokens").alias("tokens")).collect()  # a row per source of the plan
    over = [(r.place, float(r.tokens - rows[r.place]["target"])) for r in over]
    table = mixed.sparkSession.createDataFrame([x for x in over if x[1] > 0], "place int, over double")
    off = F.abs(F.col("tokens") - F.col("over"))
    spare = mixed.join(F.broadcast(table), "place").where(off < F.col("over")).groupBy("place").agg(F.min(F.struct(off, "slot", "key")).alias("x"))
    return mixed.join(F.broadcast(spare.select("x.slot", "x.key")), ["slot", "key"], "left_anti")


def shares(mixed: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reached against target shares: one row per source of ``targets``.

    Columns: source, target_share, reached_share, tokens, records (distinct ones
    used), most_uses.  A source without records has 0 everywhere.
    """
    per_record = durable(mixed.groupBy("source", key).agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens")))
    got = per_record.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"), F.max("uses").alias("most_uses"))
    total = got.agg(F.sum("tokens")).first()[0] or 1
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("share").alias("target_share"))
    zero = F.lit(0).cast("bigint")
    return wanted.join(got, "source", "left").select(
        "source", "target_share", F.round(F.coalesce(F.col("tokens"), zero) / F.lit(total), 6).alias("reached_share"),
        F.coalesce("tokens", zero).alias("tokens"), F.coalesce("records", zero).alias("records"), F.coalesce("most_uses", zero).alias("most_uses"),
    )
