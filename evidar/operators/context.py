"""The evidence of a prompt: sections with tags and quotas, their text, and the citations of an answer.

Every table has the prompt's number (``group``), so that many prompts are one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidar.functions.text import cited_items, qualified

#: how many items a pool has and how many of each kind are shown; entities shown with their source
POOL, QUOTA, ENTITY_SOURCES = 10, {"E": 30, "C": 10, "D": 5, "H": 10, "I": 5}, 5
#: fixed values: how an answer cites a symbol with its place
CITED_SYMBOL = r"`([^`\n]+)`\s+in\s+`([^`\n]+?):(\d+)(?:-\d+)?`"
# fixed values: why a section is empty
REASONS = {
    "no_names": "no identifier extracted from the prompt", "no_match": "no extracted identifier matches a node name or file", "no_passages": "the repository has no documentation chunks",
    "no_passage_score": "no documentation chunk scored for the prompt", "no_history": "history layer not built", "no_touch": "no commit touches a function/class of the graph",
    "no_commit": "no commit text matches and no commit touches the AST list", "no_reports": "issue layer not built (no GitHub remote or fetch failed)", "no_links": "no closed report is linked to a commit",
    "no_report_terms": "no linked report shares terms with the prompt",
}


def assemble(pools: DataFrame, group: str = "n", quota: dict[str, int] | None = None) -> DataFrame:
    """(group, section, tag, id, rank, in_context): pools (group, section, id, rank) with tags and quotas."""
    shown = F.lit(0)
    for section, n in (quota or QUOTA).items():
        shown = F.when(F.col("section") == section, n).otherwise(shown)
    rows = pools.withColumn("rank", F.row_number().over(Window.partitionBy(group, "section").orderBy("rank", "id")))
    return rows.select(group, "section", F.concat("section", F.col("rank").cast("string")).alias("tag"), "id", "rank", (F.col("rank") <= shown).alias("in_context"))


def linked(items: DataFrame, code: DataFrame, group: str = "n") -> DataFrame:
    """(group, tag, code_tag): shown evidence (group, tag, in_context, targets) and the shown elements (group, tag, id) its targets are."""
    each = items.where("in_context").select(group, "tag", F.explode(F.array_distinct("targets")).alias("id"))
    return each.join(code.select(group, F.col("tag").alias("code_tag"), "id"), [group, "id"]).select(group, "tag", "code_tag").distinct()


def linked_ratio(items: DataFrame, links: DataFrame, group: str = "n") -> DataFrame:
    """(group, section, ratio): share of shown evidence (group, section, tag, in_context) that is linked to code; null where none is shown."""
    told = links.select(group, "tag").distinct().withColumn("hit", F.lit(1))
    rows = items.join(told, [group, "tag"], "left")
    shown = F.sum(F.col("in_context").cast("int"))
    return rows.groupBy(group, "section").agg(F.round(F.when(shown > 0, F.sum(F.when(F.col("in_context"), F.coalesce("hit", F.lit(0))).otherwise(0)) / shown), 4).alias("ratio"))


def shared_reports(history: DataFrame, issues: DataFrame, group: str = "n", quota: dict[str, int] | None = None) -> DataFrame:
    """(group, overlap): reports linked to shown commits (group, rank, links) that are shown reports (group, rank, report) too."""
    q = quota or QUOTA
    a = history.where(F.col("rank") <= q["H"]).select(group, F.explode("links").alias("report")).distinct()
    b = issues.where(F.col("rank") <= q["I"]).select(group, "report").distinct()
    return a.join(b, [group, "report"]).groupBy(group).agg(F.count("*").alias("overlap"))


def entity_sources(entities: DataFrame, code: DataFrame, group: str = "n", most: int = ENTITY_SOURCES) -> DataFrame:
    """(group, id, label, place, in_code, with_source): entities, the tag of those already among the code, and whether the source is shown.

    Of the functions and classes that aren't among the code the first ``most`` are shown.
    """
    rows = entities.select(group, "id", "label", "place").join(code.select(group, "id", F.col("tag").alias("in_code")), [group, "id"], "left")
    fit = F.col("label").isin("Function", "Class") & F.col("in_code").isNull()
    so_far = F.sum(fit.cast("int")).over(Window.partitionBy(group).orderBy("place"))
    return rows.select(group, "id", "label", "place", "in_code", (fit & (so_far <= most)).alias("with_source"))


def day(seconds: Column) -> Column:
    """A time in seconds as a day, UTC; "unknown date" for null and 0."""
    return F.when(F.coalesce(seconds, F.lit(0)) != 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")).otherwise("unknown date")


def _where(file: str = "file", line: str = "start_line") -> Column:
    return F.concat(F.coalesce(file, F.lit("None")), F.lit(":"), F.coalesce(F.col(line).cast("string"), F.lit("None")))


def neighbour_line(title: str, names: Column, total: Column) -> Column:
    """A line on callers or callees: ``names`` is an array of formatted names, ``total`` how many there are."""
    more = F.when(total > F.size(names), F.concat(F.lit(" (+"), (total - F.size(names)).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(F.size(names) > 0, F.concat(F.lit(f"{title}: "), F.array_join(names, ", "), more)).otherwise(f"{title}: none found in the call graph")


def format_code() -> Column:
    """An element (tag, label, id, file, start_line, end_line, callers, n_callers, callees, n_callees, source)."""
    head = F.concat(F.lit("["), "tag", F.lit("] "), "label", F.lit(" `"), qualified(F.col("id")), F.lit("` in `"), _where(), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("None")), F.lit("`\n"))
    return F.concat(head, neighbour_line("Called by", F.col("callers"), F.col("n_callers")), F.lit("\n"), neighbour_line("Calls", F.col("callees"), F.col("n_callees")), F.lit("\n```python\n"), F.coalesce("source", F.lit("")), F.lit("\n```"))


def format_entity() -> Column:
    """An entity (tag, label, id, file, start_line, matched, in_code, with_source, source)."""
    place = F.when(F.coalesce("start_line", F.lit(0)) != 0, _where()).otherwise(F.coalesce("file", F.lit("None")))
    head = F.concat(F.lit("["), "tag", F.lit("] "), "label", F.lit(" `"), qualified(F.col("id")), F.lit("` in `"), place, F.lit("` (matched `"), "matched", F.lit("`)"))
    return F.when(F.col("in_code").isNotNull(), F.concat(head, F.lit(", same element as ["), "in_code", F.lit("]"))).when(F.col("with_source"), F.concat(head, F.lit("\n```python\n"), F.coalesce("source", F.lit("")), F.lit("\n```"))).otherwise(head)


def format_passage() -> Column:
    """A passage (tag, file, heading, text)."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("["), "tag", F.lit("] Documentation passage\nFile: "), text("file"), F.lit("\nSection: "), text("heading"), F.lit("\nText:\n"), text("text"))


def format_commit() -> Column:
    """A commit (tag, h, t, msg, linked: array of structs n, title, body)."""
    told = F.transform(F.array_sort("linked"), lambda r: F.concat(F.lit("\nLinked ticket or pull request #"), r["n"].cast("string"), F.lit(": "), F.coalesce(r["title"], F.lit("")), F.lit("\n"), F.coalesce(r["body"], F.lit(""))))
    return F.concat(F.lit("["), "tag", F.lit("] Past commit "), F.substring("h", 1, 8), F.lit(", committed "), day(F.col("t")), F.lit("\nCommit message:\n"), F.coalesce("msg", F.lit("")), F.array_join(told, ""))


def format_report() -> Column:
    """A report (tag, n, created, title, body)."""
    return F.concat(F.lit("["), "tag", F.lit("] Past bug report #"), F.col("n").cast("string"), F.lit(", created "), day(F.col("created")), F.lit(": "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))


def joined(lines: DataFrame, prompts: DataFrame, group: str = "n") -> DataFrame:
    """(group, text): lines (group, rank, line) of a section in order; "(none)" for prompts without one."""
    told = lines.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("text"))
    return prompts.select(group).distinct().join(told, group, "left").select(group, F.coalesce("text", F.lit("(none)")).alias("text"))


def format_sections(context: DataFrame, texts: DataFrame, group: str = "n", limit: int = 3000) -> DataFrame:
    """(group, text): shown items in order, each with its tag, id and the first ``limit`` characters of its text."""
    rows = context.where("in_context").join(texts, "id", "left")
    line = F.concat(F.lit("["), "tag", F.lit("] "), "id", F.lit("\n"), F.coalesce(F.substring("text", 1, limit), F.lit("")))
    return rows.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("text"))


def empty_reasons(prompts: DataFrame, named: DataFrame, entities: DataFrame, passages: DataFrame, commits: DataFrame, reports: DataFrame, built: dict[str, bool], group: str = "n") -> DataFrame:
    """(group, section, reason): why a prompt has no item in a section; null where it has.

    ``named`` has the prompts a name was found in; ``built`` says whether there are
    passages, a history with touched elements (``history``, ``touch``) and reports with
    links (``reports``, ``links``).
    """
    def has(df: DataFrame, name: str) -> DataFrame:
        return df.select(group).distinct().withColumn(name, F.lit(True))

    rows = prompts.select(group).distinct()
    for name, df in (("named", named), ("E", entities), ("D", passages), ("H", commits), ("I", reports)):
        rows = rows.join(has(df, name), group, "left")
    why = {
        "E": F.when(F.col("named"), REASONS["no_match"]).otherwise(REASONS["no_names"]),
        "D": F.lit(REASONS["no_passage_score" if built.get("passages") else "no_passages"]),
        "H": F.lit(REASONS["no_commit" if built.get("touch") else "no_touch" if built.get("history") else "no_history"]),
        "I": F.lit(REASONS["no_report_terms" if built.get("links") else "no_links" if built.get("reports") else "no_reports"]),
    }
    each = F.array(*[F.struct(F.lit(s).alias("section"), F.when(F.col(s).isNull(), w).alias("reason")) for s, w in why.items()])
    return rows.select(group, F.explode(each).alias("x")).select(group, "x.section", "x.reason")


def citations(answers: DataFrame, context: DataFrame, group: str = "n") -> DataFrame:
    """(group, tag, valid): tags cited in an answer (group, answer) and whether they were shown."""
    cited = answers.select(group, F.explode(cited_items(F.col("answer"))).alias("tag"))
    shown = context.where("in_context").select(group, "tag", F.lit(True).alias("valid"))
    return cited.join(shown, [group, "tag"], "left").select(group, "tag", F.coalesce("valid", F.lit(False)).alias("valid"))


def cited_symbols(answers: DataFrame, spans: DataFrame, group: str = "n") -> DataFrame:
    """(group, symbol, path, line, valid): symbols cited as `name` in `path:line`, valid if the line is in a shown span (group, file, start, end)."""
    found = answers.select(group, F.explode(F.regexp_extract_all("answer", F.lit(CITED_SYMBOL), 0)).alias("x"))
    parts = found.select(group, *[F.regexp_extract("x", CITED_SYMBOL, i + 1).alias(c) for i, c in enumerate(("symbol", "path", "line"))]).withColumn("line", F.col("line").cast("int"))
    hit = parts.join(spans.withColumnRenamed("file", "path"), [group, "path"]).where(F.col("line").between(F.col("start"), F.col("end"))).select(group, "symbol", "path", "line").distinct().withColumn("valid", F.lit(True))
    return parts.join(hit, [group, "symbol", "path", "line"], "left").select(group, "symbol", "path", "line", F.coalesce("valid", F.lit(False)).alias("valid"))


def run_summary(context: DataFrame, cited: DataFrame, group: str = "n") -> DataFrame:
    """(group, section, shown, cited): how much of each section was shown and used."""
    used = cited.where("valid").select(group, "tag").distinct().withColumn("used", F.lit(1))
    rows = context.where("in_context").join(used, [group, "tag"], "left")
    return rows.groupBy(group, "section").agg(F.count("*").alias("shown"), F.sum(F.coalesce("used", F.lit(0))).cast("bigint").alias("cited"))
