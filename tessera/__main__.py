"""Command line: run a specification, export, report or compare results, list procedures and functions."""

from __future__ import annotations

import argparse
import json
import sys

from tessera.graph import order_graph
from tessera.harness import runner, spec
from tessera.operators import procedures, statistics
from tessera.session import session
from tessera.sources import readers, writers


def main(argv: list[str]) -> int:
    top = argparse.ArgumentParser(prog="tessera")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("run")
    one.add_argument("spec")
    one.add_argument("tables")
    one.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
    two = sub.add_parser("export")
    two.add_argument("results")
    two.add_argument("out")
    two.add_argument("--kind", default="csv", choices=("csv", "parquet", "json"))
    three = sub.add_parser("report")
    three.add_argument("results")
    for one_of in (two, three):
        one_of.add_argument("--engine")
        one_of.add_argument("--benchmark")
    four = sub.add_parser("compare")
    four.add_argument("before")
    four.add_argument("after")
    sub.add_parser("list")
    a = top.parse_args(argv)
    spark = session()
    if a.command == "run":
        values = {k: spec.literal(v) for k, v in (p.split("=", 1) for p in a.param)}
        print(json.dumps(runner.run(order_graph(spark, a.tables), spec.load(a.spec), values), default=str))
    elif a.command == "export":
        writers.export(readers.results(spark, a.results, a.engine, a.benchmark), a.out, a.kind)
    elif a.command == "report":
        print(writers.report(readers.results(spark, a.results, a.engine, a.benchmark)))
    elif a.command == "compare":
        for row in statistics.compare_results(readers.results(spark, a.before), readers.results(spark, a.after)).collect():
            print(row["line"])
    else:
        procedures.procedures(spark).unionByName(procedures.functions(spark), allowMissingColumns=True).show(200, False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
