"""python -m quarry analyze|validate|info ROOT [--out PATH]"""

from __future__ import annotations

import argparse
import sys

from quarry import api


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser("quarry")
    parser.add_argument("command", choices=("analyze", "validate", "info"))
    parser.add_argument("root")
    parser.add_argument("--out", default="analysis-results")
    parser.add_argument("--top", type=int, default=20)
    args = parser.parse_args(arguments)
    options = api.Options(root=args.root, top=args.top)
    if bad := options.problems():
        print(*bad, sep="\n", file=sys.stderr)
        return 1
    if args.command == "validate":
        print("valid")
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quarry").getOrCreate()
    if args.command == "info":
        api.analyze(spark, options)["project"].show(truncate=False)
        return 0
    from quarry.sinks.report import write_json

    write_json(api.report(spark, options), args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
