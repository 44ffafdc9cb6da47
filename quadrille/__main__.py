"""Command line: ``python -m quadrille query|sample|serve --database PATH ...``."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from quadrille.endpoint import Endpoint, serve
from quadrille.engine import Engine
from quadrille.operators import sampling
from quadrille.operators.paging import Budget
from quadrille.sources.dataset import Registry
from quadrille.sources.relational import RelationalDataset


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quadrille")
    p.add_argument("command", choices=["query", "sample", "serve"])
    p.add_argument("--database", "-d", required=True, help="statements (.nt, .nq), a folder of quads, or with --tables of tables")
    p.add_argument("--tables", action="store_true", help="the database is a folder of Parquet tables")
    p.add_argument("--query", "-q", help="query text")
    p.add_argument("--file", "-f", help="file with the query")
    p.add_argument("--limit", "-l", type=int, help="solutions a page")
    p.add_argument("--scans", type=int, help="scan steps a page")
    p.add_argument("--timeout", "-t", type=int, help="milliseconds a page")
    p.add_argument("--loop", action="store_true", help="go on with continuations until all is there")
    p.add_argument("--force-order", action="store_true", help="join in the order written")
    p.add_argument("--report", "-r", action="store_true", help="time and counts at the end")
    p.add_argument("--executions", "-n", type=int, default=1, help="repetitions of the query")
    p.add_argument("--attempts", "-a", type=int, default=10_000, help="walks")
    p.add_argument("--sub-walks", type=int, default=5, help="walks for each value of a distinct count")
    p.add_argument("--method", choices=["weighted", "chao_lee"], default="weighted")
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--no-seed", action="store_true")
    p.add_argument("--port", type=int, default=3330)
    return p.parse_args(argv)


def main(argv: list[str]) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("quadrille").getOrCreate()
    dataset = RelationalDataset(spark, a.database) if a.tables else Registry(spark).get(a.database)
    engine = Engine(dataset, force_order=a.force_order)
    budget = Budget(a.limit, a.scans, None if a.timeout is None else a.timeout / 1000)
    if a.command == "serve":
        server = serve({"pages": Endpoint(engine, "pages", budget), "walks": Endpoint(engine, "walks", attempts=a.attempts),
                        "whole": Endpoint(engine, "whole")}, a.port)
        print(f"http://127.0.0.1:{server.server_address[1]}/pages", flush=True)
        server.serve_forever()
    if not (a.query or a.file):
        print("a query is needed: --query or --file", file=sys.stderr)
        return 2
    first = a.query or Path(a.file).read_text()
    for run in range(a.executions):
        text, began, rows, pages = first, time.monotonic(), 0, 0
        if a.command == "sample":
            seed = int(time.time_ns() % (1 << 31)) if a.no_seed else a.seed + run
            try:
                df = sampling.estimate(engine, text, a.attempts, seed, a.method, a.sub_walks)
            except sampling.UnsupportedQuery:
                df = sampling.walk(engine, text, a.attempts, seed)
            for r in df.toLocalIterator():
                print(r.asDict())
                rows += 1
        while a.command == "query" and text is not None:
            page = engine.page(text, budget)
            for r in page.rows:
                print(r)
            rows, pages, text = rows + len(page.rows), pages + 1, page.next
            if text is not None and not a.loop:
                print(f"-- continuation:\n{text}")
                break
        if a.report:
            print(f"-- {rows} rows, {pages} pages, {time.monotonic() - began:.3f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
