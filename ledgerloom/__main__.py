"""Command line: ``python -m ledgerloom init|refresh|ui|health [PATH]``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from ledgerloom.operators import health, inventory
from ledgerloom.plans import catalog
from ledgerloom.schemas import Tags


def main(words: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="ledgerloom")
    parser.add_argument("command", choices=("init", "refresh", "ui", "health"))
    parser.add_argument("path", nargs="?", default=".")
    parser.add_argument("--json", action="store_true", help="print the status as JSON")
    parser.add_argument("--max-file-lines", type=int, default=health.FILE_LINES)
    parser.add_argument("--max-func-lines", type=int, default=health.FUNCTION_LINES)
    parser.add_argument("--max-complexity", type=int, default=health.COMPLEXITY)
    parser.add_argument("--target-dir", default="", help="health: check this directory of the tree alone")
    parser.add_argument("--check-tests", action="store_true", help="health: check the tests directory too")
    given = parser.parse_args(words)
    spark = SparkSession.builder.appName("ledgerloom").getOrCreate()
    if given.command == "health":
        files = inventory.tree_inventory(spark, given.path, content=True)
        limits = health.Limits(given.max_file_lines, given.max_func_lines, given.max_complexity)
        rows = health.health(health.targeted(files, given.target_dir, given.check_tests), limits=limits).orderBy("path", "line").collect()
        for row in rows:
            print(f"{row['path']}:{row['line'] or 1} {row['name'] or ''} {row['metric']} {row['value']} (limit {row['limit']})")
        return int(bool(rows))
    tags = Tags()
    found = catalog.scan(spark, given.path, tags=tags)
    if given.command != "ui":
        told = catalog.status(spark, found, given.command, tags)
        print(json.dumps(told, indent=2) if given.json else catalog.status_text(told, given.command))
        return 0
    print("\n".join(catalog.write_pages(spark, found, catalog.listed_features(spark, found, tags), tags)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
