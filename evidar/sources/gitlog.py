"""The history of a local repository: commits, changes and files at a commit.

Every step is a table made in the executors, which need the repository on a shared
path.  One git process serves a batch of rows: names go in by standard input, objects
come out one after the other (``git cat-file --batch``, ``git diff-tree --stdin``).
A process that fails ends the job with what git said.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidar.tables import durable, stored

YEAR = 365 * 86400
SCHEMA = "h string, p string, t bigint, merge boolean, msg string"


def _git(repository: str, *arguments: str, given: bytes = b"") -> bytes:
    done = subprocess.run(["git", "-C", repository, *arguments], input=given, capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git {arguments[0]} ended with {done.returncode}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout


def _objects(raw: bytes) -> Iterator[bytes | None]:
    """The objects in an answer of ``cat-file --batch``; None for one that is missing."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\n", at)
        head = raw[at:end].rsplit(b" ", 2)
        if head[-1] == b"missing" or not head[-1].isdigit():
            yield None
            at = end + 1
            continue
        size = int(head[-1])
        yield raw[end + 1: end + 1 + size]
        at = end + 2 + size


def _commit(raw: bytes) -> tuple[int, str]:
    """Time and message of a commit object."""
    head, _, message = raw.partition(b"\n\n")
    stamp = re.search(rb"(?m)^committer .*> (-?\d+) [+-]\d{4}$", head)
    return int(stamp.group(1)), message.decode("utf-8", "replace").replace("\r\n", "\n").strip()


def log(spark: SparkSession, repository: str, head: str = "HEAD", years: int = 5) -> DataFrame:
    """(h, p, t, merge, msg) along first parents, newest first, up to ``years`` before the head; the root is left out.

    The list of commits is walked in one task and passed on in batches; their texts
    are read in as many tasks as there are partitions.
    """

    def walk(batches):
        for batch in batches:
            for where, start in zip(*(c.to_pylist() for c in batch.columns)):
                newest, _ = _commit(next(_objects(_git(where, "cat-file", "--batch", given=f"{start}^{{commit}}\n".encode()))))
                listing = _git(where, "rev-list", "--first-parent", "--parents", f"--max-age={newest - years * YEAR}", start, "--").decode()
                rows = [(n, where, *x.split(" ")) for n, x in enumerate(listing.splitlines())]
                rows = [(n, w, x[0], x[1], len(x) > 2) for n, w, *x in rows if len(x) > 1]
                for i in range(0, len(rows), 5_000):
                    columns = list(zip(*rows[i: i + 5_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:4]), pa.array(columns[4], pa.bool_())], ["n", "at", "h", "p", "merge"])

    def read(batches):
        for batch in batches:
            if batch.num_rows:
                asked = "".join(f"{h}\n" for h in batch.column(2).to_pylist()).encode()
                told = [_commit(x) for x in _objects(_git(batch.column(1)[0].as_py(), "cat-file", "--batch", given=asked))]
                yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array([t for t, _ in told], pa.int64()), batch.column(4), pa.array([m for _, m in told], pa.string())], ["h", "p", "t", "merge", "msg"]).append_column("n", batch.column(0))

    start = spark.createDataFrame([(repository, head)], "at string, head string")
    return start.mapInArrow(walk, "n bigint, at string, h string, p string, merge boolean").repartition("h").mapInArrow(read, SCHEMA + ", n bigint").orderBy("n").drop("n")


def diffs(units: DataFrame, repository: str, context: int = 3, blind: bool = False) -> DataFrame:
    """(h, diff): the change of every commit against its first parent, with ``context`` lines around; ``blind`` to white space on request.

    Line ends of both kinds count as one; what isn't UTF-8 is replaced.
    """

    def run(batches):
        for batch in batches:
            own, parents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            given = "".join(f"{h} {p}\n" for h, p in zip(own, parents)).encode()
            options = ["diff-tree", "--stdin", "-r", "-p", "-M", "--no-color", "--no-ext-diff", f"-U{context}", *(["-w"] if blind else [])]
            text = _git(repository, *options, given=given).decode("utf-8", "replace").replace("\r\n", "\n")
            # a line of a diff never is a bare name, so the names of the commits part the answer
            asked, parts, name = set(own), {}, None
            for line in text.split("\n"):
                if line in asked:
                    name = line
                    parts[name] = []
                elif name is not None:
                    parts[name].append(line)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["\n".join(parts.get(h, [])) for h in own], pa.string())], ["h", "diff"])

    return units.where("p is not null").select("h", "p").mapInArrow(run, "h string, diff string")


def blobs(wanted: DataFrame, repository: str) -> DataFrame:
    """(commit, file, source): files (commit, file) as they were at a commit; one that wasn't there has a null source."""

    def run(batches):
        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            given = "".join(f"{c}:{f}\n" for c, f in names).encode()
            found = list(_objects(_git(repository, "cat-file", "--batch", given=given))) if names else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.decode("utf-8", "replace") if x is not None else None for x in found], pa.string())], ["commit", "file", "source"])

    return wanted.where("commit is not null and file is not null").select("commit", "file").distinct().mapInArrow(run, "commit string, file string, source string")


def ancestors(snapshots: DataFrame, repository: str) -> DataFrame:
    """(snapshot, h): every commit a snapshot (snapshot) comes from, itself included."""

    def run(batches):
        for batch in batches:
            for s in batch.column(0).to_pylist():
                found = _git(repository, "rev-list", s, "--").decode().split()
                for i in range(0, len(found), 50_000):
                    part = found[i: i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([s] * len(part), pa.string()), pa.array(part, pa.string())], ["snapshot", "h"])

    return snapshots.where("snapshot is not null").select("snapshot").distinct().mapInArrow(run, "snapshot string, h string")


def history(spark: SparkSession, repository: str, head: str = "HEAD", years: int = 5, known: DataFrame | None = None) -> DataFrame:
    """(h, p, t, merge, msg, touch, touch_mod): commits with the elements they touch; commits in ``known`` are taken from there.

    Only new commits are compared with their parents and only the files these change are parsed.
    """
    from evidar.operators import code, diff

    # what git and the parsers give is stored at once, so that nothing asks them twice
    units = durable(log(spark, repository, head, years))
    fresh = units if known is None else durable(units.join(known.select("h"), "h", "left_anti"))
    changed = stored(diff.lines(diffs(fresh, repository, context=0).withColumnRenamed("h", "change")))
    spans = stored(code.spans_at(parents_of(changed, fresh), repository))
    sets = diff.touch_sets(changed, spans)
    none = F.array().cast("array<string>")
    new = fresh.join(sets.withColumnRenamed("change", "h"), "h", "left").select("h", "p", "t", "merge", "msg", F.coalesce("touch", none).alias("touch"), F.coalesce("touch_mod", none).alias("touch_mod"))
    return new if known is None else units.select("h").join(known, "h").select(*new.columns).unionByName(new)


def hunks(units: DataFrame, repository: str, done: DataFrame | None = None) -> DataFrame:
    """(u, f, k, ids, text): hunks of the commits that touch elements, without those whose ``u`` is in ``done`` already."""
    from evidar.operators import code, diff

    own = units.where(F.size("touch") > 0)
    if done is not None:
        own = own.join(done.select(F.col("u").alias("h")).distinct(), "h", "left_anti")
    changes = stored(diffs(own, repository, context=3, blind=True).withColumnRenamed("h", "change"))
    spans = stored(code.spans_at(parents_of(diff.lines(changes), own), repository))
    return diff.hunk_index(changes, spans)


def parents_of(changed: DataFrame, units: DataFrame) -> DataFrame:
    """(change, commit, file): the Python files of changes, and the commits they are to be read at."""
    files = changed.where("kind = 'file'").where(F.col("file").endswith(".py")).select("change", "file").distinct()
    return files.join(units.select(F.col("h").alias("change"), F.col("p").alias("commit")), "change")
