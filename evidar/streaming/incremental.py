"""Tables kept up to date from files that arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidar.operators.graph import last_version


def arriving(spark: SparkSession, folder: str, schema: str, late: str = "90 days", key: str = "n", time: str = "fetched_at") -> DataFrame:
    """A stream of Parquet files in which a row that comes again within ``late`` of event time counts once."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(folder)
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key, time])


#: parts a table is cut into by a hash of its keys
BUCKETS = 64


def keep_latest(stream: DataFrame, table: str, keys: list[str], order: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Runs the stream until its files are used up; ``table`` then holds the newest version of each key.

    A batch rewrites only the parts its keys are in, into a folder of its own number; a
    part is where its newest whole folder is, so a batch that is run again replaces only
    its own.  Of a part the version before the newest is kept for readers, older ones go.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket__", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = sorted(r[0] for r in rows.select("bucket__").distinct().collect())  # at most ``buckets``
        if not touched:
            return
        known = _read(spark, table, _parts(spark, table, before=number), touched)
        if known is not None:
            rows = rows.unionByName(known.withColumn("bucket__", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
        newest = last_version(rows, keys, F.col(order))
        newest.write.mode("overwrite").partitionBy("bucket__").parquet(f"{table}/version={number:012d}")
        _prune(spark, table)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, table: str, before: int | None = None) -> dict[int, list[str]]:
    """Folders of each part, newest last, of versions that are whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return {}
    found: dict[int, list[str]] = {}
    for version in sorted(files.listStatus(path), key=lambda s: s.getPath().getName()):
        name, at = version.getPath().getName(), version.getPath()
        if "=" not in name or not files.exists(hadoop.Path(at, "_SUCCESS")) or (before is not None and int(name.split("=")[1]) >= before):
            continue
        for part in files.listStatus(at):
            if part.getPath().getName().startswith("bucket__="):
                found.setdefault(int(part.getPath().getName().split("=")[1]), []).append(part.getPath().toString())
    return found


def _read(spark: SparkSession, table: str, parts: dict[int, list[str]], wanted: list[int] | None = None) -> DataFrame | None:
    paths = [own[-1] for k, own in sorted(parts.items()) if wanted is None or k in wanted]
    return spark.read.parquet(*paths) if paths else None


def _prune(spark: SparkSession, table: str, keep: int = 2) -> None:
    """Removes versions of parts before the newest ``keep``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for own in _parts(spark, table).values():
        for old in own[:-keep]:
            place = hadoop.Path(old)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def current(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a table kept by ``keep_latest``."""
    return _read(spark, table, _parts(spark, table, before))


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, events): counts per window of event time, batch or stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), "event_type", "events")
