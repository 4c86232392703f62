"""Reading source trees, documentation, graph files and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidar.functions.text import kept_path

#: folders that hold what a build made, and the order of documentation formats
BUILT = ("_build", "build", "_static", "_templates", "node_modules", ".git")
FORMATS = {".rst": 0, ".md": 1, ".txt": 2}


def _relative(root: str):
    return F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + root.rstrip("/").replace(".", "\\.") + "/", "")


def source_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".py", ".js", ".swift")) -> DataFrame:
    """(file, source) of a tree: files with these endings that are no tests, examples or set-up files; not UTF-8 is replaced."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = rows.select(_relative(root).alias("file"), F.decode("content", "UTF-8").alias("source"))
    return rows.where(F.regexp_extract("file", r"\.\w+$", 0).isin(*suffixes) & kept_path(F.col("file")))


def doc_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, text, place) of the documentation of a tree, by format and path; requirement and robot lists are none."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(_relative(root).alias("file"), F.decode("content", "UTF-8").alias("text"))
    suffix = F.regexp_extract("file", r"\.\w+$", 0)
    base = F.element_at(F.split("file", "/"), -1)
    rows = rows.where(suffix.isin(*FORMATS) & ~F.exists(F.split("file", "/"), lambda p: p.isin(*BUILT)) & ~(base.endswith(".txt") & base.rlike("^(?:requirements|robots)")))
    order = F.lit(0)
    for s, i in FORMATS.items():
        order = F.when(suffix == s, i).otherwise(order)
    return rows.withColumn("place", order)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, damaged ones dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def graph_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph stored as one JSON object with ``nodes`` and ``edges``."""
    schema = (
        "nodes array<struct<labels: array<string>, id: string, properties: struct<name: string, file: string, start_line: int, end_line: int, source: string>>>,"
        "edges array<struct<type: string, source: string, target: string, line: int>>"
    )
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    n = whole.select(F.explode("nodes").alias("n"))
    nodes = n.select("n.id", F.element_at("n.labels", 1).alias("label"), "n.properties.*").withColumn("file", F.coalesce("file", "name"))
    return nodes, whole.select(F.explode("edges").alias("e")).select("e.*")


def latest_index(spark: SparkSession, pattern: str) -> str | None:
    """Folder of the newest ``index_state.json`` by its ``built_at``; unreadable ones are skipped."""
    rows = spark.read.schema("built_at string").option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern)
    got = rows.where("built_at is not null").agg(F.max(F.struct("built_at", F.col("_metadata.file_path").alias("p"))).alias("x")).first()[0]
    return got.p.rsplit("/", 1)[0] if got else None


def tracked_files(spark: SparkSession, repository: str, suffixes: tuple[str, ...] = (".py",)) -> DataFrame:
    """(file, source) of what git knows of a working tree and what it would add, by these endings and without tests, examples and set-up files.

    A folder without git is walked.  The list of names is made in one task; files are
    read where the names go, so the tree must be on a shared path.
    """
    import os
    import subprocess

    import pyarrow as pa

    def names(batches):
        for batch in batches:
            for root in batch.column(0).to_pylist():
                done = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True)
                if done.returncode == 0:
                    found = [x.decode("utf-8", "replace") for x in done.stdout.split(b"\0") if x]
                else:
                    found = [os.path.relpath(os.path.join(at, f), root).replace(os.sep, "/") for at, _, inner in os.walk(root) for f in inner]
                found = sorted({f for f in found if f.endswith(suffixes)})
                for i in range(0, len(found), 10_000):
                    part = found[i: i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([root] * len(part), pa.string()), pa.array(part, pa.string())], ["root", "file"])

    def texts(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                read = []
                for root, file in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    try:
                        with open(os.path.join(root, file), "rb") as f:
                            read.append(f.read().decode("utf-8", "replace"))
                    except OSError:  # listed, but gone or a folder
                        read.append(None)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(read, pa.string())], ["file", "source"])

    listed = spark.createDataFrame([(repository,)], "root string").mapInArrow(names, "root string, file string").where(kept_path(F.col("file")))
    return listed.repartition("file").mapInArrow(texts, "file string, source string").where("source is not null")


#: fixed values: folders documentation is looked for in, the first that is there counts
DOC_FOLDERS = ("docs", "doc", "documentation", "Documentation")


def documentation(spark: SparkSession, root: str) -> DataFrame:
    """``doc_files`` of the first documentation folder of a tree, paths beginning at the tree; none if there is no such folder."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in DOC_FOLDERS:
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(base, name)):
            return doc_files(spark, f"{root.rstrip('/')}/{name}").withColumn("file", F.concat(F.lit(f"{name}/"), "file"))
    return spark.createDataFrame([], "file string, text string, place int")


def write_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines in UTF-8, null columns left out; what was there is replaced."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def damaged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line) of the JSON lines that can't be read under a schema; blank lines are none."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where("trim(line) <> ''")
    read = F.from_json("line", f"{schema}, damaged__ string", {"columnNameOfCorruptRecord": "damaged__"})
    return lines.where(read["damaged__"].isNotNull())


def npy_vectors(spark: SparkSession, matrix: str, ids: str, rows: int = 10_000) -> DataFrame:
    """(id, v) of a matrix stored as .npy and a JSON list of the ids of its rows, read in stretches of ``rows`` rows from a shared path."""
    import json

    import numpy as np
    import pyarrow as pa

    with open(ids, encoding="utf-8") as f:
        count = len(json.load(f))
    shape = np.load(matrix, mmap_mode="r").shape
    if shape[0] != count:
        raise ValueError(f"{matrix} has {shape[0]} rows, {ids} has {count}")

    def read(batches):
        for batch in batches:
            x = np.load(matrix, mmap_mode="r")
            with open(ids, encoding="utf-8") as f:
                names = json.load(f)
            for start in batch.column(0).to_pylist():
                part = np.ascontiguousarray(x[start: start + rows], np.float32)
                offsets = np.arange(0, part.size + 1, max(1, part.shape[1]), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([str(n) for n in names[start: start + rows]], pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()))], ["id", "v"])

    return spark.range(0, count, rows).mapInArrow(read, "id string, v array<float>")


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, repo, base_commit, problem_statement, gt_files) of a benchmark's JSON lines; gt_files are the files its patches change, sorted."""
    from evidar.operators.diff import gold_files

    rows = spark.read.schema("instance_id string, repo string, base_commit string, problem_statement string, patch string").json(path).where("instance_id is not null")
    files = gold_files(rows.select(F.col("instance_id").alias("change"), F.col("patch").alias("diff"))).groupBy("change").agg(F.sort_array(F.collect_set("file")).alias("gt_files"))
    full = rows.drop("patch").join(files.withColumnRenamed("change", "instance_id"), "instance_id", "left")
    return full.withColumn("gt_files", F.coalesce("gt_files", F.array().cast("array<string>")))
