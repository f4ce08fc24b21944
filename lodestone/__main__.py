"""Command line: ingest, search, query, stats, rebuild and clear over a folder."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from lodestone import config, reports
from lodestone.pipeline import MODES, Engine


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    parser.add_argument("--folder", required=True, help="where store and index lie")
    parser.add_argument("--config")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("ingest").add_argument("paths", nargs="+")
    for name in ("search", "query"):
        sub = commands.add_parser(name)
        sub.add_argument("text")
        sub.add_argument("--mode", choices=MODES, default="hybrid")
        sub.add_argument("--save", help="write a report to this file")
    for name in ("stats", "rebuild"):
        commands.add_parser(name)
    commands.add_parser("clear").add_argument("--confirm", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    engine = Engine(spark, args.folder, config.load(args.config))
    if args.command in ("search", "query"):
        asked = spark.createDataFrame([(0, args.text)], "query_id long, text string")
        hits = [r.asDict() for r in engine.search(asked, args.mode).orderBy("rank").collect()]
        answer = engine.query(asked, args.mode).first()["answer"] if args.command == "query" else None
        if args.save:
            reports.save(args.save, args.text, answer, hits)
        print(reports.render("txt", args.text, answer, hits))
    else:
        done = {"ingest": lambda: engine.ingest_files(args.paths), "stats": engine.stats, "rebuild": lambda: {"indexed": engine.rebuild()}, "clear": lambda: {"cleared": engine.clear(args.confirm)}}
        print(json.dumps(done[args.command]()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
