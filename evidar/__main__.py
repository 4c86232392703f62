"""python -m evidar build REPOSITORY INDEX | clone URL INDEX | update INDEX REPOSITORY | ask INDEX PROMPT | check INDEX"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from evidar import engine
from evidar.sources import repositories


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evidar", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in (("build", ("repository", "index")), ("update", ("index", "repository")), ("clone", ("url", "repository", "index")), ("ask", ("index", "prompt")), ("check", ("index",))):
        one = commands.add_parser(name)
        for place in places:
            one.add_argument(place)
        if name in ("build", "clone", "update"):
            one.add_argument("--schema", choices=sorted(engine.SCHEMAS), default="simple")
            one.add_argument("--years", type=int, default=5)
            one.add_argument("--suffix", action="append", default=None)
            one.add_argument("--slug")
        if name == "clone":
            one.add_argument("--branch")
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("evidar").getOrCreate()
    if given.command == "clone":
        repositories.clone(given.url, given.repository, given.branch)
    if given.command in ("build", "clone", "update"):
        out = engine.build(spark, given.repository, given.index, engine.SCHEMAS[given.schema], tuple(given.suffix or [".py"]), given.years, slug=given.slug)
    elif given.command == "ask":
        record = engine.Engine.load(spark, given.index).ask(given.prompt)
        out = [{k: x[k] for k in ("tag", "id")} for x in record["retrieval"] or [] if x["in_context"]]
    else:
        out = engine.Engine(spark, given.index).check()
    print(json.dumps(out, ensure_ascii=False))
    return int(given.command == "check" and bool(out))


if __name__ == "__main__":
    raise SystemExit(main())
