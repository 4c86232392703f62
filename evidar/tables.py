"""Reading tables, and cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of a directory of Parquet tables."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, a table as it is read, dealt out over the cores if most of them would have nothing of it.

    A small file of one row group is read by one task, whatever is then done to its
    rows.  A table that comes in more partitions than half the number of cores stays as it is.
    """
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("AdaptiveSparkPlan"):  # not just read: it is shuffled already
        return df
    return df.repartition(cores) if 2 * plan.execute().getNumPartitions() <= cores else df


def shared_folder(session: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` of the session names it.

    Without one a session that runs on this machine alone, as in tests, gets a
    temporary folder; any other raises ``RuntimeError``, since a folder of one
    machine is lost with it.
    """
    context = session.sparkContext
    folder = session.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = context.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder when the master is {master}")
    folder = tempfile.mkdtemp(prefix="evidar-")
    context._conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back from there.

    ``release`` deletes what was written; the rest is deleted when the program ends.
    """
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    kept = df.checkpoint(eager=True)
    path = _place(kept)
    if path:
        atexit.register(_remove, df.sparkSession, path)
    return kept


def release(*frames: DataFrame) -> None:
    """Deletes the files of results of ``durable`` that nothing will read any more."""
    for df in frames:
        path = _place(df)
        if path:
            _remove(df.sparkSession, path)


def _place(df: DataFrame) -> str | None:
    """Where the rows of a checkpointed table lie; None for any other table."""
    try:
        found = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        return found.get() if found.isDefined() else None
    except Exception:  # a plan of another kind has no such rows
        return None


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, for results larger than their input.

    Columns are compressed and can be read one by one, unlike those of a
    checkpoint.  The table is removed when the program ends.
    """
    session = df.sparkSession
    path = f"{shared_folder(session)}/evidar-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, session, path)
    return session.read.parquet(path)


def _remove(session: SparkSession, path: str) -> None:
    try:
        place = session._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(session._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session may have ended; then the folder is the cluster's to clear
        pass
