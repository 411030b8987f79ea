"""python -m tracewell: ingest, detect, sql, shell, stats, search, rules, report."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import engine, export
from tracewell.plans import rules as R
from tracewell.plans.search import QueryError
from tracewell.sources import detect
from tracewell.sources.lines import read_lines


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tracewell").config("spark.sql.session.timeZone", "UTC").config("spark.sql.codegen.hugeMethodLimit", "8000").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def printed(rows: DataFrame, limit: int) -> None:
    sys.stdout.write(export.csv_text(rows, limit))


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewell")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="parse files into a case")
    a.add_argument("path")
    a.add_argument("--case", required=True)
    a.add_argument("--append", action="store_true", help="the case is there; its events keep their ids")
    a.add_argument("--type", choices=sorted(engine.PARSERS))
    a.add_argument("--year", type=int, help="year of logs that have none")
    a.add_argument("--user", help="whose shell history it is")
    a.add_argument("--tz", type=int, default=0, metavar="MINUTES", help="zone of logs that name none")
    a.add_argument("--start")
    a.add_argument("--end")
    kinds = [a, sub.add_parser("detect", help="types of files, nothing is written")]
    kinds[1].add_argument("path")
    for a in kinds:
        a.add_argument("--prefer", choices=("name", "content"), default="name", help="what tells a file's type first")
        a.add_argument("--no-catch-all", action="store_true", help="skip files of no known type, which else are raw lines; alone such a file is an error")
    for name, arguments in (("sql", ("query",)), ("shell", ()), ("stats", ()), ("search", ("query",)), ("rules", ("folder",)), ("report", ("out",))):
        a = sub.add_parser(name)
        for x in arguments:
            a.add_argument(x)
        a.add_argument("--case", required=True)
        a.add_argument("--limit", type=int, default=100)
        if name == "report":
            a.add_argument("--rules")
    return p


def shell(case: engine.Case, limit: int) -> None:
    while True:
        try:
            text = input("sql> ").strip()
        except (EOFError, KeyboardInterrupt):
            return
        if text.lower() in ("", "exit", "quit"):
            return
        try:
            printed(case.sql(text, limit=limit), limit)
        except (PySparkException, PermissionError) as e:
            sys.stderr.write(f"{e}\n")


def main(argv: list[str] | None = None) -> int:
    o = options().parse_args(argv)
    spark = session()
    if o.command == "ingest":
        try:
            found, manifest = engine.ingest(spark, o.path, o.type, engine.Options(o.year, o.tz, o.user), o.prefer == "content", not o.no_catch_all, o.start, o.end)
        except ValueError as e:
            sys.stderr.write(f"{e}\n")
            return 2
        if o.append:
            engine.Case.append(spark, o.case, found)
        else:
            engine.Case(engine.numbered(found)).save(o.case, "errorifexists")
        printed(manifest.orderBy("src_file"), export.MOST_ROWS)
        return 0
    if o.command == "detect":
        printed(detect.detected(read_lines(spark, o.path), o.prefer == "content", not o.no_catch_all).orderBy("src_file"), export.MOST_ROWS)
        return 0
    case = engine.Case.open(spark, o.case)
    try:
        if o.command == "sql":
            printed(case.sql(o.query, limit=o.limit), o.limit)
        elif o.command == "shell":
            shell(case, o.limit)
        elif o.command == "stats":
            printed(case.stats().orderBy("source"), o.limit)
        elif o.command == "search":
            printed(case.search(o.query, limit=o.limit), o.limit)
        elif o.command == "rules":
            printed(case.findings(R.load_dir(o.folder)[0], 5).orderBy(F.desc("n"), "rule"), o.limit)
        else:
            text = case.report(R.load_dir(o.rules)[0] if o.rules else None)
            with open(o.out, "w", encoding="utf-8") as f:
                f.write(text)
    except (PySparkException, PermissionError, QueryError) as e:
        sys.stderr.write(f"{e}\n")
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
