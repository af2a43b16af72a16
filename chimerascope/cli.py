"""Command line: build a lake, export or install one, annotate a table of events."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from chimerascope import schemas
from chimerascope.plans.annotate import annotate
from chimerascope.plans.build import build_lake
from chimerascope.sources.lake import Lake, install


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chimerascope", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="build a lake from dump files")
    build.add_argument("source")
    build.add_argument("out")
    build.add_argument("--release", required=True)
    for name in ("entries", "classes", "curated"):
        build.add_argument(f"--{name}")
    build.add_argument("--replace", action="store_true")
    export = commands.add_parser("export", help="copy what annotation needs")
    export.add_argument("lake")
    export.add_argument("out")
    export.add_argument("--revision", type=int, default=1)
    put = commands.add_parser("install", help="install an export")
    put.add_argument("exported")
    put.add_argument("target")
    put.add_argument("--replace", action="store_true")
    run = commands.add_parser("annotate", help="annotate a JSON-lines table of events")
    run.add_argument("lake")
    run.add_argument("events")
    run.add_argument("out")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("chimerascope").getOrCreate()
    try:
        if args.command == "build":
            build_lake(spark, args.source, args.out, release=args.release, entries=args.entries, classes=args.classes, curated=args.curated, replace=args.replace)
        elif args.command == "export":
            Lake(spark, args.lake).export(args.out, revision=args.revision)
        elif args.command == "install":
            install(spark, args.exported, args.target, replace=args.replace)
        else:
            events = spark.read.schema(schemas.ddl(schemas.EVENT)).json(args.events)
            annotate(events, Lake(spark, args.lake).models()).write.parquet(args.out)
    except (ValueError, FileNotFoundError, FileExistsError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
