"""Command line: ingest a folder or archive and write its tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.ingest import Options, ingest
from .sources.tables import write_all


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tarifflow", description="Ingest price lists")
    parser.add_argument("source", help="folder, file or zip archive")
    parser.add_argument("--output", default="output", help="folder of the results")
    parser.add_argument("--no-scans", action="store_true", help="don't read scanned documents")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    given = arguments(argv)
    spark = SparkSession.builder.appName("tarifflow").getOrCreate()
    tables = ingest(spark, given.source, Options(parse_scan_pdf=not given.no_scans))
    write_all(tables, given.output)
    for name, value in tables["parse_report"].first().asDict().items():
        print(f"{name}: {value}")


if __name__ == "__main__":
    main()
