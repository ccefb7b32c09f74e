"""Command line: build, query, scan, grid. `python -m tessera.cli -h`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.rects import Rect
from .operators.grid import collect_ids, grid_lines, write_grid
from .operators.index import INDEXES, IndexedTable, Names, build_index, make_index
from .operators.scan import linear_scan, pair_lines, scan_lines, write_lines
from .sources.nodes import PARSERS, PointParser, make_parser, read_nodes


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description="space-partitioning indexes over node records in text")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("build", "query"):
        p = verbs.add_parser(verb)
        p.add_argument("index", choices=sorted(INDEXES))
        p.add_argument("parser", choices=sorted(PARSERS))
        p.add_argument("input")
        p.add_argument("--root", required=True, help="folder of the indexes")
        if verb == "build":
            p.add_argument("percent", nargs="?", type=float, help="sample: a fraction, or a percentage if above 1")
            p.add_argument("--parts", type=int)
            p.add_argument("--outside", choices=("raise", "overflow"), default="raise")
        else:
            p.add_argument("keys", nargs="+", help="x1 y1 x2 y2, or the first and last string")
            p.add_argument("--output", required=True)
    scan = verbs.add_parser("scan")
    grid = verbs.add_parser("grid")
    for p in (scan, grid):
        p.add_argument("input")
        p.add_argument("--output", required=True)
        for name in ("minlon", "minlat", "maxlon", "maxlat"):
            p.add_argument(f"--{name}", type=float, required=True)
    scan.add_argument("--sort", action="store_true")
    grid.add_argument("--cells", type=int, required=True, help="cells of the grid at most")
    return top


def run(spark: SparkSession, argv: list[str]) -> None:
    a = arguments().parse_args(argv)
    if a.verb in ("scan", "grid"):
        points, area = read_nodes(spark, a.input, PointParser()), Rect.corners(a.minlon, a.minlat, a.maxlon, a.maxlat)
        if a.verb == "scan":
            write_lines(scan_lines(linear_scan(points, area, a.sort)), a.output)
        else:
            write_grid(grid_lines(collect_ids(points, area, a.cells)), a.output)
        return
    opclass, names = make_index(a.index), Names(a.root, a.parser, a.index, a.input)
    if a.verb == "build":
        records = read_nodes(spark, a.input, make_parser(a.parser))
        size = spark.read.format("binaryFile").load(a.input).agg(F.sum("length")).first()[0] if a.parts is None else None
        build_index(records, opclass, names, a.percent, a.parts, size, outside=a.outside)
        return
    if len(a.keys) != 2 * len(opclass.keys):
        raise SystemExit(f"a query on {a.index} takes {2 * len(opclass.keys)} keys")
    keys = [float(k) for k in a.keys] if len(opclass.keys) == 2 else a.keys
    lo, hi = (tuple(keys[:2]), tuple(keys[2:])) if len(opclass.keys) == 2 else keys
    write_lines(pair_lines(IndexedTable(spark, names, opclass).range(lo, hi)), a.output)


def main() -> None:
    import sys

    run(SparkSession.builder.appName("tessera").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
