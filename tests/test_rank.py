import random

from pyspark.sql import functions as F

from evidar.operators import rank
from evidar.operators.prefix import running_total
from evidar.operators.skew import greater_counts, lookup, medians


def lists(spark, *ids):
    return [spark.createDataFrame([(1, k, i) for i, k in enumerate(x, 1)], "n int, id string, rank int") for x in ids]


def test_fusion_breaks_ties_by_first_list_then_id(spark):
    got = rank.rrf(lists(spark, "abc", "cd"), "n", "id").orderBy("rank").collect()
    assert [r.id for r in got] == ["c", "a", "b", "d"] and abs(got[0].score - (1 / 63 + 1 / 61)) < 1e-8
    assert [r.id for r in rank.rrf(lists(spark, "a", "z", "y"), "n", "id").orderBy("rank").collect()] == ["a", "y", "z"]


def test_bm25_lists_documents_without_hits_too(spark):
    docs = spark.createDataFrame([("a", "red fish"), ("b", "blue"), ("c", None), ("d", "red red")], "id string, text string")
    queries = spark.createDataFrame([(1, "red"), (2, "nothing"), (3, None)], "n int, text string")
    got = rank.bm25(queries, docs, "n", "id", depth=3).collect()
    by = {n: [r.id for r in sorted((x for x in got if x.n == n), key=lambda r: r.rank)] for n in (1, 2, 3)}
    assert by[2] == ["a", "b", "c"] and by[3] == ["a", "b", "c"] and len(by[1]) == 3
    assert rank.bm25(queries, docs.where("false"), "n", "id").count() == 0


def test_cosine_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.choice((-1.0, 0.0, 1.0)) for _ in range(4)]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got = {(x.query, x.id): x.rank for x in rank.cosine(df, "id", "v", F.col("id") % 20 == 0, depth=7, block=16).collect()}
    want = {}
    for q in (0, 20, 40):
        order = sorted((-sum(a * b for a, b in zip(rows[q][1], v)), i) for i, v in rows[:60] if i != q)
        want |= {(q, i): k for k, (_, i) in enumerate(order[:7], 1)}
    assert got == want


def test_running_totals_of_a_hot_key(spark):
    r = random.Random(5)
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else f"k{i % 4}", r.randrange(1 << 61), r.choice((0, 1, 2, None)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o bigint, a bigint, i int")
    got = {x.i: x.total for x in running_total(df, "k", F.col("o"), F.col("a"), "total", cells=16, tie=["i"]).collect()}
    for k, o, _, i in rows:
        assert got[i] == sum(b or 0 for q, p, b, j in rows if q == k and (p, j) < (o, i))


def test_order_statistics_with_ties_nulls_and_large_groups(spark):
    r = random.Random(7)
    rows = [(r.choice((1, 1, 2, None)), r.choice((None, float(r.randrange(40)), 3.0))) for _ in range(600)]
    df = spark.createDataFrame(rows, "g int, v double")
    for large in (5, 50_000):
        counted = greater_counts(df, ["g"], "v", large=large)
        for x in counted.collect():
            own = [v for g, v in rows if g == x.g and v is not None]
            assert x.greater == sum(v > x.v for v in own) and x.ties == own.count(x.v)
        for x in medians(counted, ["g"], "v", "m").collect():
            own = sorted(v for g, v in rows if g == x.g and v is not None)
            assert x.m == (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2


def test_lookup_with_hot_and_null_keys(spark):
    big = spark.createDataFrame([("hot" if i % 3 else None if i % 5 else f"k{i}", i) for i in range(400)], "k string, i int")
    small = big.groupBy("k").agg(F.count("*").alias("rows")).withColumn("x", F.col("rows") * 2)
    got = lookup(big, small, ["k"], "rows", share=10, least=20)
    assert got.columns == ["k", "i", "x"] and got.count() == 400 and got.select(F.sum("x")).first()[0] == small.select(F.sum(F.col("rows") * F.col("x"))).first()[0]


def test_files_in_order_of_first_element(spark):
    listed = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "n int, id string, rank int")
    files = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "id string, file string")
    assert [(r.file, r.best_pos) for r in rank.file_rank(listed, files, "n", "id").orderBy("position").collect()] == [("x", 1), ("y", 2)]
