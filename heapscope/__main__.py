"""Command line: ingest a heap dump, estimate its needs, or run queries on it.

    python -m heapscope ingest heap.hprof [--keep-unreachable] [--no-values] [--overwrite]
    python -m heapscope estimate heap.hprof
    python -m heapscope query heap.hprof 'SELECT ...' ...

Exit codes: 0 done, 1 failed, 2 wrong arguments.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="heapscope")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "estimate", "query"):
        sub = commands.add_parser(name)
        sub.add_argument("path")
        if name == "ingest":
            sub.add_argument("--keep-unreachable", action="store_true")
            sub.add_argument("--no-values", action="store_true", help="leave out fields, strings and array lengths, which OQL on values needs")
            sub.add_argument("--overwrite", action="store_true")
        if name == "query":
            sub.add_argument("queries", nargs="+")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = SparkSession.builder.getOrCreate()
    try:
        return run(spark, args)
    except Exception as e:  # noqa: BLE001  the command line's last resort
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    from .operators.aggregates import estimate
    from .plans import oql, snapshot, views
    from .plans.graph import Graph
    from .plans.ingest import ingest
    from .sources import hprof as H

    d = snapshot.Descriptor.read(args.path)
    if args.command == "ingest":
        dump = ingest(spark, d.dump)
        graph = Graph(dump.raw, args.keep_unreachable)
        made = snapshot.save(graph if args.no_values else views.with_values(dump, graph), d.snapshot, snapshot.dump_info(dump), args.overwrite)
        if d.path.suffix != d.SUFFIX:
            snapshot.Descriptor(d.path.with_suffix(d.SUFFIX), d.snapshot, d.dump, d.memory_budget).write()
        print(json.dumps(made.facts))
    elif args.command == "estimate":
        H.register(spark)
        bodies = spark.read.format("hprof").option("payload", "false").load(H.checked_path(d.dump))
        counts = bodies.agg(
            F.count_if(F.col("tag").isin(H.INSTANCE, H.OBJECT_ARRAY, H.PRIMITIVE_ARRAY)).alias("o"), F.count_if(F.col("tag") == H.CLASS_DUMP).alias("c"),
            F.sum(F.when(F.col("tag") == H.OBJECT_ARRAY, F.col("n")).when(F.col("tag") == H.INSTANCE, F.col("n") / 8)).cast("bigint").alias("e"),
        ).first()
        print(json.dumps({"objects": counts["o"], "classes": counts["c"]} | estimate(counts["o"], counts["e"] or 0, counts["c"])))
    else:
        opened = snapshot.open_or_ingest(spark, args.path)
        for text in args.queries:
            print(f"QUERY {text}")
            try:
                rows = oql.run(opened, text)
                print("COLUMNS " + "\t".join(rows.columns))
                rows = rows.persist()  # counted, then streamed
                print(f"ROWS {rows.count()}")
                for row in rows.toLocalIterator():
                    print("\t".join("" if v is None else str(v) for v in row))
                rows.unpersist()
            except Exception as e:  # noqa: BLE001  an error is a result of that query
                print(f"ERROR {e}")
            print("END")
    return 0


if __name__ == "__main__":
    sys.exit(main())
