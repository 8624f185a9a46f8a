"""Command line: ``python -m roomlake info | run QUERY FOLDER | accuracy | verify MANIFEST FOLDER``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence


def main(argv: Sequence[str] | None = None) -> int:
    """0 if all went well; 1 for a failed check, 2 for a name that isn't known."""
    parser = argparse.ArgumentParser(prog="roomlake", description="queries, accuracy cases and checks of stored files")
    parser.add_argument("--master", default=None, help="where Spark runs; by default as it is configured")
    what = parser.add_subparsers(dest="what", required=True)
    what.add_parser("info", help="names of all queries")
    run = what.add_parser("run", help="one query over a folder of tables")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--out", help="where the result goes as Parquet; without it the first rows are shown")
    what.add_parser("accuracy", help="the kernels against closed forms")
    verify = what.add_parser("verify", help="files against a manifest (Parquet: name, bytes, sha256)")
    verify.add_argument("manifest")
    verify.add_argument("folder")
    args = parser.parse_args(argv)

    from roomlake import plans

    if args.what == "info":
        print("\n".join(f"{name}{'' if name in plans.ORACLES else ' (no SQL)'}" for name in sorted(plans.QUERIES)))
        return 0
    if args.what == "run" and args.query not in plans.QUERIES:
        print(f"no query {args.query}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("roomlake").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    if args.what == "run":
        found = plans.QUERIES[args.query](spark, args.folder)
        found.write.mode("overwrite").parquet(args.out) if args.out else found.show(20, False)
        return 0
    if args.what == "accuracy":
        from roomlake import accuracy

        found = accuracy.run(spark)
        found.show(100, False)
        return int(not found.where("status <> 'pass'").isEmpty())
    from roomlake.sources import tables

    found = tables.verify_files(spark, spark.read.parquet(args.manifest), args.folder)
    found.show(100, False)
    return int(not found.where("not ok").isEmpty())


if __name__ == "__main__":
    sys.exit(main())
