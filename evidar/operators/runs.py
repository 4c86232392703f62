"""A run: prompts, what was found for them, what a model answered, and the record of it all.

The model, and the counter of its tokens, are functions the caller brings; without
one a run ends with what was found.  A record always has the same blocks, also when
finding or answering fails.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.functions.text import CITED, TAG

from . import context

BLOCKS = ("run", "index", "config", "retrieval", "llm", "citations", "timing", "warnings")


def config_sha(config: dict) -> str:
    """The first twelve digits of the hash of a configuration, independent of the order of its keys."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:12]


def seed_of(instance: str) -> int:
    """A number that an instance's name stands for, the same in every run."""
    return int(hashlib.sha1(instance.encode()).hexdigest()[:8], 16)


def seeds_of(instances: DataFrame, key: str) -> DataFrame:
    """Adds ``seed``, as ``seed_of`` gives it."""
    return instances.withColumn("seed", F.conv(F.substring(F.sha1(F.col(key)), 1, 8), 16, 10).cast("bigint"))


def is_stale(built: str | None, head: str | None) -> bool | None:
    """Whether an index was built for another commit than the head; None if either isn't known."""
    return None if not built or not head else built != head


def run(prompt: str, retrieve: Callable[[str], tuple[DataFrame, DataFrame]], config: dict, index: dict | None = None, answer: Callable[[str], dict] | None = None, count: Callable[[dict[str, str]], dict[str, int]] | None = None, head: str | None = None) -> dict:
    """The record of one prompt.

    ``retrieve`` gives the items (n, section, tag, id, rank, in_context) and texts (id,
    text) of a prompt, at most a few dozen rows.  ``answer`` gets the text of the
    sections and gives a dict with ``answer``, ``finish_reason``, ``prompt_token_count``
    and ``error``; ``count`` gives the tokens of each section.  What fails is a warning.
    """
    warnings, timing, items, text = [], {}, None, ""
    started = time.time()
    record: dict = {"run": {"id": uuid.uuid4().hex, "prompt": prompt, "started": started}, "index": {**(index or {}), "stale": is_stale((index or {}).get("head_sha"), head)}, "config": {**config, "config_sha": config_sha(config)}}
    sections: dict[str, str] = {}
    try:
        found, texts = retrieve(prompt)
        items = [r.asDict() for r in found.orderBy("section", "rank").collect()]
        for s in dict.fromkeys(x["section"] for x in items):
            told = context.format_sections(found.where(F.col("section") == s), texts).first()
            sections[s] = told.text if told else ""
        text = "\n\n".join(sections.values())
    except Exception as error:  # a record is made of whatever happened
        warnings.append(f"retrieval failed: {type(error).__name__}: {error}")
    timing["retrieval_s"] = round(time.time() - started, 3)
    llm: dict = {"answer": "", "finish_reason": "NOT_RUN", "error": None}
    if items is not None and answer is not None:
        try:
            llm = {**llm, **answer(text)}
        except Exception as error:
            llm = {**llm, "finish_reason": "ERROR", "error": f"{type(error).__name__}: {error}"}
        if llm.get("error"):
            warnings.append(f"LLM call failed: {llm['error']}")
    if items is not None and count is not None:
        tokens = count(sections)
        total = llm.get("prompt_token_count")
        llm |= {"section_tokens": tokens, "section_tokens_sum": sum(tokens.values()), "section_tokens_gap": round((total - sum(tokens.values())) / total, 4) if total else None}
    shown = {x["tag"] for x in items or [] if x["in_context"]}
    cited = _cited(llm.get("answer") or "")
    for x in items or []:
        x["cited"] = x["tag"] in cited
    timing["total_s"] = round(time.time() - started, 3)
    return record | {"retrieval": items, "llm": llm, "citations": {"cited_items": cited, "invalid_items": [t for t in cited if t not in shown]}, "timing": timing, "warnings": warnings} | {"_prompt": text}


def _cited(answer: str) -> list[str]:
    return list(dict.fromkeys(t for g in re.findall(CITED, answer) for t in re.findall(TAG, g)))


def summary(record: dict) -> dict:
    """The line of a record in the list of runs."""
    items: dict[str, int] = {}
    for x in record["retrieval"] or []:
        items[x["section"]] = items.get(x["section"], 0) + bool(x["in_context"])
    return {
        "id": record["run"]["id"], "prompt": record["run"]["prompt"][:200], "config_sha": record["config"]["config_sha"], "items": items, "tokens_in": record["llm"].get("prompt_token_count"),
        "finish_reason": record["llm"]["finish_reason"], "cited": len(record["citations"]["cited_items"]), "invalid": len(record["citations"]["invalid_items"]), "warnings": len(record["warnings"]),
    }


def ablations(lists: dict[str, DataFrame], group: str = "n", key: str = "id") -> DataFrame:
    """(system, group, key, rank, score): fusions of the first list with each other one, with all, and with all but one.

    Ties go to the first list's rank, then by key.
    """
    from .rank import rrf

    names = list(lists)
    base, rest = names[0], names[1:]
    systems = {base: [base], **{f"+{r}": [base, r] for r in rest}, "+ALL": names, **({f"ALL-{r}": [x for x in names if x != r] for r in rest} if len(rest) > 1 else {})}
    out = None
    for system, own in systems.items():
        one = rrf([lists[x] for x in own], group, key).withColumn("system", F.lit(system)).select("system", group, key, "rank", "score")
        out = one if out is None else out.unionByName(one)
    return out


def judge_requests(items: DataFrame, group: str = "n", seed: int = 0) -> DataFrame:
    """(group, alias, id, place): evidence (group, id) in an order of its own for each prompt and seed, the same in every run, under names A1, A2 and so on."""
    from pyspark.sql import Window

    order = Window.partitionBy(group).orderBy(F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"), F.col("id").cast("string"))), "id")
    placed = items.select(group, "id").distinct().withColumn("place", F.row_number().over(order))
    return placed.select(group, F.concat(F.lit("A"), F.col("place").cast("string")).alias("alias"), "id", "place")
