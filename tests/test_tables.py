"""Where intermediate results lie, and how small tables are spread."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from evidar import tables
from evidar.operators.graph import last_version


def test_a_cluster_must_name_its_folder():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1024]", "k8s://h"):
        session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: None)))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            tables.shared_folder(session)


def test_results_are_kept_and_released(spark):
    df = tables.durable(spark.range(10))
    place = tables._place(df).removeprefix("file:")
    assert df.count() == 10 and os.path.exists(place) and tables._place(spark.range(3)) is None
    tables.release(df, spark.range(3))
    assert not os.path.exists(place)
    assert tables.stored(spark.range(4)).count() == 4


def test_small_tables_are_spread_and_shuffled_ones_left(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    one = tables.read(spark, str(tmp_path), "t")
    many = tables.spread(one)
    assert many.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and many.count() == 100
    grouped = one.groupBy((F.col("id") % 3).alias("k")).count()
    assert tables.spread(grouped) is grouped


def test_newest_versions_with_ties_nulls_and_no_other_columns(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "p"), ("b", 5, "q"), ("c", 7, None), (None, 1, "m"), (None, 3, "n"), ("d", None, "r"), ("d", None, "s"), ("e", 1, "t"), ("e", 1, "t")]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    assert sorted(map(str, map(tuple, last_version(df, ["k"], F.col("t")).collect()))) == sorted(map(str, [("a", 2, "z"), ("b", 5, "q"), ("c", 7, None), (None, 3, "n"), ("d", None, "s"), ("e", 1, "t")]))
    assert last_version(df.select("k"), ["k"], F.lit(1)).count() == 6 and last_version(df.where("false"), ["k"], F.col("t")).count() == 0
