"""Command line: ``python -m veilmark anonymize IN OUT`` and ``... process TYPE PAGES OUT``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from veilmark.operators.rules import Rules, parse_rules
from veilmark.plans import api
from veilmark.plans.paths import path_issues
from veilmark.sources.sinks import write_files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veilmark")
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("anonymize", help="anonymise the files of a folder")
    a.add_argument("source")
    a.add_argument("output")
    a.add_argument("--rules", help="settings file")
    p = commands.add_parser("process", help="extract documents from a table of recognised pages")
    p.add_argument("document_type", choices=sorted(api.TYPES))
    p.add_argument("pages", help="Parquet table with the type's input columns")
    p.add_argument("output", help="registry to write")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("veilmark").getOrCreate()
    try:
        if args.command == "process":
            result = api.process(spark.read.parquet(args.pages), args.document_type)
            api.write_registry(result, args.document_type, args.output)
            return 0
        if issues := path_issues(args.source, args.output):
            print(", ".join(issues), file=sys.stderr)
            return 1
        rules = parse_rules(Path(args.rules).read_text("utf-8-sig")) if args.rules else Rules()
        results, summary = api.anonymize(spark, Path(args.source).resolve().as_uri(), rules, [args.output])
        bad = write_files(results.where("error is null").select("rel_path", "content"), args.output).where("error is not null").count()
        total = summary.first()
        print(f"succeeded {total.succeeded}, failed {total.failed + bad}, entities {total.entities}")
        return int(total.failed + bad > 0)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
