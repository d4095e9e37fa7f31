"""``python -m turnloom QUERY FOLDER [--out PATH | --report]``: run a registered query over a folder of tables.

``--out`` writes parquet and refuses an existing target; ``--report`` prints a
Markdown table of a small result; without either the rows are only counted.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from turnloom.plans import registry
from turnloom.sources import files, reports


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="turnloom")
    parser.add_argument("query", choices=sorted(registry.QUERIES), metavar="QUERY")
    parser.add_argument("folder")
    what = parser.add_mutually_exclusive_group()
    what.add_argument("--out")
    what.add_argument("--report", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"turnloom {given.query}").getOrCreate()
    rows = registry.QUERIES[given.query](spark, given.folder)
    if given.out:
        files.publish(spark, given.out, lambda folder: files.write_parquet(rows, folder))
    elif given.report:
        print(reports.markdown_table(rows))
    else:
        print(rows.count())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
