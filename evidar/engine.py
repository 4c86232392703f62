"""From a repository to an index, and from prompts to evidence.

An index is a folder of Parquet tables: nodes, edges, chunks, units, hunks, reports,
links and, if an encoder is given, vectors.  ``build`` makes it, taking over what an
earlier index knows of the same commits; ``Engine`` answers batches of prompts (n, text).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidar.functions import terms
from evidar.functions.text import identifiers, key_of
from evidar.operators import code, context, docs, graph, history, issues, rank, runs, search, vectors
from evidar.sources import files, gitlog, repositories, sinks
from evidar.tables import durable, stored


@dataclass(frozen=True)
class Schema:
    """Names of labels and edge types; a method is a function that stands in a class."""

    module: str = "Module"
    cls: str = "Class"
    function: str = "Function"
    method: str = "Function"
    types: dict[str, str] = field(default_factory=lambda: {"Defines": "Defines", "Imports": "Imports", "Calls": "Calls", "Inherits": "Inherits"})


SIMPLE = Schema()
# fixed values: names of the schema with methods of their own
DETAILED = Schema("Module", "CLASS", "FUNCTION", "METHOD", {"Defines": "CONTAINS", "Imports": "IMPORTS", "Calls": "USES", "Inherits": "INHERITS"})
SCHEMAS = {"simple": SIMPLE, "detailed": DETAILED}
#: characters of an element's source that are kept
SOURCE = 8_000


def labelled(nodes: DataFrame, edges: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges under the names of a schema."""
    classes = nodes.where("label = 'Class'").select(F.col("id").alias("owner__")).distinct()
    owned = nodes.withColumn("owner__", F.regexp_replace("id", ":[^:]*$", "")).join(classes.withColumn("inside__", F.lit(True)), "owner__", "left")
    label = F.when(F.col("label") == "Module", schema.module).when(F.col("label") == "Class", schema.cls).when(F.col("inside__"), schema.method).otherwise(schema.function)
    kind = F.col("type")
    for plain, name in schema.types.items():
        kind = F.when(F.col("type") == plain, name).otherwise(kind)
    member = F.when((F.col("type") == "Defines") & F.lit(schema.method != schema.function) & F.col("method__"), "HAS_METHOD")
    shown = owned.withColumn("label", label).drop("owner__", "inside__")
    methods = shown.where(F.col("label") == schema.method).select(F.col("id").alias("target"), F.lit(True).alias("method__")).distinct()
    return shown, edges.join(methods, "target", "left").withColumn("type", F.coalesce(member, kind)).select(*edges.columns)


def build(spark: SparkSession, repository: str, folder: str, schema: Schema = SIMPLE, suffixes: tuple[str, ...] = (".py",), years: int = 5, reports: DataFrame | None = None, slug: str | None = None, encode: Callable | None = None, model: str = "") -> dict:
    """Builds the index of a repository in a folder on a shared path; returns what an update brought.

    Commits, hunks and vectors that the folder knows already are taken over.
    """
    old = Engine(spark, folder)
    sources = stored(files.tracked_files(spark, repository, suffixes))
    raw, refs = code.extract(sources)
    edges = durable(code.resolve(raw, refs))
    lines = sources.select("file", F.split("source", "\n").alias("lines"))
    text = F.substring(F.array_join(F.slice("lines", F.col("start_line"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1)), "\n"), 1, SOURCE)
    # an element that is found twice under one id is the last one
    single = graph.last_version(raw, ["id"], F.col("start_line"))
    nodes = single.join(lines, "file", "left").withColumn("source", F.when(F.col("label") != "Module", text)).drop("lines")
    chunks = durable(docs.chunk_files(files.documentation(spark, repository)))
    told = docs.resolve(chunks, raw).select(F.lit("Documents").alias("type"), F.col("chunk").alias("source"), "target", F.lit(None).cast("int").alias("line"))
    cited = docs.references(chunks, chunks.select("file").distinct()).select(F.lit("References").alias("type"), F.col("chunk").alias("source"), F.concat(F.lit("doc:"), "file").alias("target"), F.lit(None).cast("int").alias("line"))
    held = chunks.select(F.lit("HasChunk").alias("type"), F.concat(F.lit("doc:"), "file").alias("source"), F.col("id").alias("target"), F.lit(None).cast("int").alias("line"))
    known = old.table("units")
    units = durable(gitlog.history(spark, repository, years=years, known=known))
    before = old.table("hunks")
    hunks = durable(gitlog.hunks(units, repository, done=before) if before is None else before.join(units.select(F.col("h").alias("u")), "u", "left_semi").unionByName(gitlog.hunks(units, repository, done=before)))
    reports = reports if reports is not None else spark.createDataFrame([], "n int, pr boolean, title string, body string, created bigint, url string")
    links = issues.closing_links(units, reports, slug).select(F.col("n").cast("int").alias("n"), F.col("h").alias("u"), F.lit("fixed").alias("type"))
    shown, named = labelled(nodes, edges, schema)
    places = shown.select("id", "label", "name", "file", "start_line", "end_line", "source")
    passages = chunks.select("id", F.lit("DocChunk").alias("label"), F.col("heading").alias("name"), "file", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.col("text").alias("source"))
    documents = chunks.select("file").distinct().select(F.concat(F.lit("doc:"), "file").alias("id"), F.lit("Document").alias("label"), F.col("file").alias("name"), "file", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("source"))
    whole = durable(places.unionByName(passages).unionByName(documents))
    everything = named.unionByName(told).unionByName(cited).unionByName(held)
    head = repositories.head(repository)
    summary = sinks.update_summary(_seen(spark, known, old.table("reports")), _seen(spark, units, reports))
    if encode is not None:
        texts = whole.where(F.col("label") != schema.module).select("id", F.when(F.col("label") == "DocChunk", F.concat_ws("\n", "name", "source")).otherwise(search.embed_text(whole)).alias("text"))
        cache = old.table("vectors")
        made = stored(vectors.encoded(texts, "id", "text", encode, None if cache is None else cache.select("digest", "v").distinct(), model))
        summary = sinks.update_summary(_seen(spark, known, old.table("reports")), _seen(spark, units, reports), texts.select("id").join(made.select("id", "digest"), "id").join((cache if cache is not None else made.where("false")).select("digest", F.lit(True).alias("known")).distinct(), "digest", "left").select(F.coalesce("known", F.lit(False)).alias("known")))
        made.write.mode("overwrite").parquet(f"{folder}/vectors")
    sinks.write_graph(whole, everything, folder)
    sinks.write_word_index(shown, folder)
    for name, table in (("chunks", chunks), ("units", units), ("hunks", hunks), ("reports", reports), ("links", links)):
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    state = sinks.manifest(whole, everything, datetime.now(timezone.utc).isoformat())
    for key, value in {**head, "schema": next((k for k, s in SCHEMAS.items() if s == schema), "own")}.items():
        state = state.withColumn(key, F.lit(value).cast("string"))
    sinks.write_state(state, folder)
    return summary.first().asDict()


def _seen(spark: SparkSession, units: DataFrame | None, reports: DataFrame | None) -> DataFrame:
    rows = spark.createDataFrame([], "kind string, key string")
    if units is not None:
        rows = rows.unionByName(units.select(F.lit("commit").alias("kind"), F.col("h").alias("key")))
    return rows if reports is None else rows.unionByName(reports.select(F.lit("report").alias("kind"), F.col("n").cast("string").alias("key")))


class Engine:
    """An index, and the search in it.  Tables are read when they are asked for and stay with the engine."""

    _loaded: dict[tuple[str, str], Engine] = {}

    def __init__(self, spark: SparkSession, folder: str, encode: Callable | None = None, schema: Schema = SIMPLE):
        self.spark, self.folder, self.encode, self.schema = spark, folder, encode, schema
        self._tables: dict[str, DataFrame | None] = {}

    @classmethod
    def load(cls, spark: SparkSession, folder: str, **options) -> Engine:
        """The engine of a folder; the same one as long as the index is the same."""
        state = cls(spark, folder).state()
        key = (folder, str(state.get("built_at")))
        if key not in cls._loaded:
            cls._loaded[key] = cls(spark, folder, schema=SCHEMAS.get(state.get("schema", "simple"), SIMPLE), **options)
        return cls._loaded[key]

    def table(self, name: str) -> DataFrame | None:
        """A table of the index; None if there is none."""
        if name not in self._tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
            # what an index is built from may be what it replaces, so it is kept apart
            self._tables[name] = stored(self.spark.read.parquet(f"{self.folder}/{name}")) if there else None
        return self._tables[name]

    def state(self) -> dict:
        try:
            row = self.spark.read.json(f"{self.folder}/state").first()
        except Exception:  # there is no index
            return {}
        return row.asDict(recursive=True) if row else {}

    def check(self) -> list[str]:
        """What speaks against the stored tables being those of the manifest; empty if nothing does."""
        state, nodes = self.state(), self.table("nodes")
        if nodes is None or not state:
            return ["there is no index"]
        return sinks.consistent(nodes, {k: v for k, v in (state["labels"] or {}).items() if v is not None})

    def code(self) -> DataFrame:
        """Elements with labels of the simple schema."""
        s = self.schema
        label = F.when(F.col("label") == s.module, "Module").when(F.col("label") == s.cls, "Class").when(F.col("label").isin(s.function, s.method), "Function")
        return self.table("nodes").withColumn("label", label).where("label is not null").withColumn("file", F.coalesce("file", "name"))

    def _calls(self) -> DataFrame:
        return self.table("edges").where(F.col("type") == self.schema.types["Calls"])

    def _vectors(self, prompts: DataFrame, ids: DataFrame) -> DataFrame | None:
        """(n, id, cos) of prompts and the vectors of some nodes; None without an encoder or vectors."""
        if self.encode is None or self.table("vectors") is None:
            return None
        from evidar.functions.text import query_text

        asked = vectors.encoded(prompts.select("n", query_text(F.col("text")).alias("t")), "n", "t", self.encode)
        have = self.table("vectors").join(ids.select("id"), "id", "left_semi").select("id", "v")
        both = asked.select(F.concat(F.lit("?"), F.col("n").cast("string")).alias("id"), F.col("v"), F.lit(True).alias("q")).unionByName(have.select("id", "v", F.lit(False).alias("q")))
        found = rank.cosine(both, "id", "v", F.col("q"))
        return found.where(~F.col("id").startswith("?")).select(F.substring("query", 2, 20).cast("int").alias("n"), "id", F.col("score").alias("cos"))

    def elements(self, prompts: DataFrame) -> DataFrame:
        """(n, id, score, rank): functions and classes by words and, with an encoder, by vector."""
        nodes = self.code()
        texts = nodes.select("id", F.when(F.length(F.trim("source")) >= 5, F.col("source")).otherwise(F.concat_ws(" ", "label", "name", "file")).alias("text"))
        words = rank.bm25(prompts, texts, "n", "id").select("n", "id", (F.col("rank") - 1).alias("rank"))
        fc = nodes.where("label <> 'Module'").select("id")
        near = self._vectors(prompts, fc)
        lists = [words] + ([rank.ranked(near, "n", [F.desc("cos"), F.asc("id")], rank.DEPTH, base=0).select("n", "id", "rank")] if near is not None else [])
        fused = rank.rrf(lists, "n", "id").drop("rank").join(fc, "id", "left_semi")
        return rank.ranked(fused, "n", [F.desc("score"), F.asc("id")])

    def search(self, prompts: DataFrame, at: int | None = None, source: str = "locus") -> DataFrame:
        """(n, section, tag, id, rank, in_context): the evidence of prompts (n, text), tagged and with quotas.

        Code is the fusion of the elements with what the history says, by hunks
        (``locus``) or by commit texts (``text``); then passages, commits, reports and
        the elements a prompt names.
        """
        stop = terms.stop_words(self.spark)
        words = lambda t: terms.nl_terms(t, stop)
        nodes, units = self.code(), self.table("units")
        keys = nodes.where("label <> 'Module'").select("id", key_of(F.col("id")).alias("key"))
        elements = durable(self.elements(prompts))
        listed = elements.join(keys, "id").select("n", "key", "rank")
        linked = units.join(history.linked_texts(units, self.table("reports"), issues.commit_reports(units, self.table("reports"), self.table("links").select(F.col("n").cast("bigint").alias("n"), F.col("u").alias("h")))), "h")
        if source == "locus":
            told = history.locus(prompts, history.hunk_documents(self.table("hunks"), units), units, history.graph_names(nodes), keys.select("key"), "n", words, terms.code_terms, at=at)
        else:
            told = history.message_rank(prompts, linked, listed, keys.select("key"), "n", terms=words)
        by_history = told.join(keys, "key").select("n", "id", "rank")
        code_ = rank.rrf([elements.select("n", "id", "rank"), by_history], "n", "id")
        chunks, edges = self.table("chunks"), self.table("edges")
        described = edges.where("type = 'Documents'").select(F.col("source").alias("chunk")).distinct()
        both = F.trim(F.concat(F.coalesce("heading", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
        passages = search.passages(prompts, nodes.select("id", F.coalesce("source", F.concat_ws(" ", "label", "name", "file")).alias("text")), chunks.select("id", both.alias("text")), described, self._vectors(prompts, chunks.select("id")))
        commits = history.message_pool(prompts, linked, listed, keys.select("key"), "n", terms=words)
        fixed = issues.fixed_elements(self.table("links"), units)
        reports = self.table("reports").where("not pr").withColumn("text", F.concat_ws("\n", "title", "body"))
        similar = issues.similar_reports(prompts, reports, "n", lambda t: terms.issue_terms(t, stop)).where("sim > 0").join(fixed.select(F.col("n").alias("doc")).distinct(), "doc", "left_semi")
        named = search.name_seeds(prompts.select("n", F.explode(identifiers(F.col("text"))).alias("name")), nodes)
        pool = lambda df, s, key, order="rank": df.select("n", F.lit(s).alias("section"), F.col(key).cast("string").alias("id"), F.col(order).cast("int").alias("rank")).where(F.col("rank") <= (30 if s == "E" else context.POOL))
        found = pool(code_, "C", "id").unionByName(pool(passages, "D", "id")).unionByName(pool(commits, "H", "h")).unionByName(pool(rank.ranked(similar, "n", [F.desc("sim"), F.asc("doc")], context.POOL), "I", "doc")).unionByName(pool(named, "E", "id", "place"))
        return context.assemble(found)

    def texts(self) -> DataFrame:
        """(id, text): what an item of evidence says."""
        nodes = self.table("nodes").select("id", F.coalesce("source", "name").alias("text"))
        commits = self.table("units").select(F.col("h").alias("id"), F.col("msg").alias("text"))
        return nodes.unionByName(commits).unionByName(self.table("reports").select(F.col("n").cast("string").alias("id"), F.concat_ws("\n", "title", "body").alias("text")))

    def ask(self, prompt: str, answer: Callable[[str], dict] | None = None, config: dict | None = None, **options) -> dict:
        """The record of one prompt, written to the index's list of runs."""
        def retrieve(text: str):
            found = durable(self.search(self.spark.createDataFrame([(0, text)], "n int, text string"), **options))
            return found, self.texts()

        record = runs.run(prompt, retrieve, config or {}, self.state(), answer)
        sinks.write_run(self.spark, record, self.folder)
        return record

    def legacy(self, prompts: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        """The older search: seeds by name and words, what is around them, files by votes, and their sources; ((n, file, votes, place), (n, text))."""
        nodes = self.code()
        by_name = search.name_seeds(prompts.select("n", F.explode(identifiers(F.col("text"))).alias("name")), nodes)
        by_words = search.english_words(prompts, nodes.where("label <> 'Module'"), terms.stop_words(self.spark))
        seeds = durable(search.seeds(by_name, by_words))
        near = durable(search.neighbourhood(seeds, graph.both_ways(self.table("edges").select("source", "target")), depth=depth))
        return search.voted_files(near, seeds, nodes), search.graph_context(near, seeds, self.table("edges"), nodes)

