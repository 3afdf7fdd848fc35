"""``python -m lodestone build ROOT WAREHOUSE`` / ``query ROOT WAREHOUSE SQL`` / ``clean ROOT WAREHOUSE``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lodestone.engine import Engine
from lodestone.sources.files import parse_languages


def main() -> None:
    args = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    args.add_argument("command", choices=["build", "query", "clean"])
    args.add_argument("root")
    args.add_argument("warehouse")
    args.add_argument("sql", nargs="?")
    args.add_argument("--lang", default="")
    args.add_argument("--rebuild", action="store_true")
    given = args.parse_args()
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    engine = Engine(spark, given.warehouse, given.root)
    if given.command == "clean":
        engine.catalog.clean()
        return
    engine.open(given.rebuild, parse_languages(given.lang) or None)
    if given.command == "query":
        print(engine.query(given.sql or "SELECT 1"))


if __name__ == "__main__":
    main()
