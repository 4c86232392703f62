"""The pN_ queries: each operator of this subpackage on the whole of its tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidar.tables import read

from . import credentials, distinctive, fusion, handwritten, mixing, pairing, splitting, stuffing, syntax, tokenizer


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.places(read(spark, d, "node"))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every row that held a credential, with its source blanked out."""
    return credentials.scan(read(spark, d, "node"), sources=True).select("id", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"), "redacted").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(read(spark, d, "chunk"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(read(spark, d, "chunk"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.judged(read(spark, d, "node"), read(spark, d, "upstream_file")).where("generated").select("id")


def p3_handwritten(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.handwritten(read(spark, d, "node"), read(spark, d, "upstream_file"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.shared_rare(p4_scores(spark, d))


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.scores(distinctive.records(read(spark, d, "unit"), read(spark, d, "report")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid(read(spark, d, "node")).select("id")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(read(spark, d, "node"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fused(read(spark, d, "cand")).where("best_tenth").select("n", "section", "id").distinct()


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    return fusion.ranked(fusion.fused(read(spark, d, "cand"))).select("n", "section", "id", F.round("combined", 6).alias("combined"), "rank")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pairing.pairs(read(spark, d, "node"), read(spark, d, "chunk"), code=False)


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairing.pairs(read(spark, d, "node"), read(spark, d, "chunk"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_table(read(spark, d, "documents"), ["doc_id"], "text")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_target"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    mixed = mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_target"))
    return mixing.shares(mixed, read(spark, d, "mix_target"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.scored(read(spark, d, "documents")).where("found").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_redacted, p2_found, p2_pieces, p3_found, p3_handwritten, p4_found, p4_scores, p5_found, p5_rates, p6_found, p6_ranking,
        p7_found, p7_pairs, p8_ids, p9_mix, p9_shares, p10_found,
    )
}
