"""python -m veilframe build RECIPE --edges P --pairs P --zipf P [--docs P] [--answers P] --out DIR: a pack and its report from tables.

What is printed are counts; terms stand only in the files.
"""

from __future__ import annotations

import argparse
import datetime
from pathlib import Path

from pyspark.sql import SparkSession

from veilframe.plans import curate
from veilframe.sources.config import ConfigError, load_recipe, source_table


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veilframe")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="build a pack")
    b.add_argument("recipe")
    for name, needed in (("edges", True), ("pairs", True), ("zipf", True), ("docs", False), ("answers", False), ("out", True)):
        b.add_argument(f"--{name}", required=needed)
    c = sub.add_parser("categories", help="find categories by name")
    c.add_argument("query")
    c.add_argument("--table", required=True)
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "categories":
        for r in curate.search_categories(spark.read.parquet(args.table), args.query).collect():
            print(r["title"])
        return 0
    try:
        recipe = load_recipe(args.recipe)
    except ConfigError as e:
        p.exit(2, f"{e}\n")
    read = lambda path: spark.read.parquet(path) if path else None
    items = curate.fetch(spark, recipe, read(args.edges), read(args.pairs)).cache()
    candidates, dropped = curate.build(spark, recipe, items, read(args.zipf), read(args.docs), read(args.answers))
    candidates = candidates.cache()
    counts = curate.source_counts(items, candidates)
    out = Path(args.out)
    out.mkdir(parents=True, exist_ok=True)
    version = datetime.date.today().strftime("%Y.%m.%d")
    for name, text in ((f"{recipe.name}.json", curate.pack_json(recipe, candidates, counts, version)), (f"{recipe.name}.md", curate.report(recipe, candidates, dropped, source_table(spark, recipe), counts))):
        part = out / (name + ".part")
        part.write_text(text, encoding="utf-8")
        part.replace(out / name)
    n = curate.bucket_counts(candidates, recipe.thresholds).first().asDict()
    print(", ".join(f"{v} {k}" for k, v in n.items()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
