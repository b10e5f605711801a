"""Command line: ``python -m spreadlab.plans.commands prepare|select|parts ...``.

prepare  raw edge list to weighted ones: ``FILE [-u] [-id] [--skip N] [-p P ... -pf OUT ...] [-U A B ... -Uf OUT ...] [-N M D ... -Nf OUT ...]``
select   the K most influential vertices of a weighted graph: ``GRAPH [-M registers|components|oracle] [-K] [-R] [-e] [-t] [-c] [-s] [-o OUT]``
parts    the same with registers, simulations dealt over parts: ``GRAPH [-K] [-R] [-g PARTS] [-o OUT]``

The oracle takes its seeds from standard input, and gives their spread.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from spreadlab.operators import sampling, select
from spreadlab.plans import experiments
from spreadlab.sources import edges, results

METHODS = ("registers", "components", "oracle")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spreadlab")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("prepare")
    p.add_argument("file")
    p.add_argument("-u", dest="is_undirected", action="store_true")
    p.add_argument("-id", dest="fix_ids", action="store_true")
    p.add_argument("--skip", type=int, default=0)
    for kind in "pUN":
        p.add_argument(f"-{kind}", type=float, nargs="*", default=[])
        p.add_argument(f"-{kind}f", nargs="*", default=[])
    p = sub.add_parser("select")
    p.add_argument("graph")
    p.add_argument("-M", dest="method", type=str.lower, choices=METHODS, default="registers")
    p.add_argument("-K", type=int, default=50)
    p.add_argument("-R", type=int, default=256)
    p.add_argument("-e", dest="eps", type=float, default=0.3)
    p.add_argument("-t", dest="tr", type=float, default=0.01)
    p.add_argument("-c", dest="active_rate", type=float, default=0.02)
    p.add_argument("-s", dest="in_order", type=int, choices=(0, 1), default=1)
    p.add_argument("-o", dest="out")
    p = sub.add_parser("parts")
    p.add_argument("graph")
    p.add_argument("-K", type=int, default=50)
    p.add_argument("-R", type=int, default=64)
    p.add_argument("-g", dest="parts", type=int, default=1)
    p.add_argument("-o", dest="out")
    return top


def pairs(numbers: list[float], kind: str) -> list[tuple]:
    """Two numbers for each weighting."""
    if len(numbers) % 2:
        raise ValueError(f"-{kind} takes pairs of numbers")
    return [(kind, a, b) for a, b in zip(numbers[::2], numbers[1::2], strict=True)]


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(arcs, vertices) of a weighted edge list, in one file or as prepared; vertices without edges count."""
    rows, header = edges.read_weighted(spark, path)
    n = header.first()
    if n is None:
        n = edges.read_prepared(spark, path)[1].first()
    return sampling.graph(rows), spark.range(n.n).toDF("id")


def prepare(spark: SparkSession, a: argparse.Namespace) -> dict[str, tuple]:
    outputs = experiments.outputs_of([("p", x) for x in a.p], a.pf, "-p") | experiments.outputs_of(pairs(a.U, "U"), a.Uf, "-U") | experiments.outputs_of(pairs(a.N, "N"), a.Nf, "-N")
    experiments.prepare_files(edges.raw_lines(spark, a.file), outputs, a.is_undirected, a.fix_ids, a.skip)
    return outputs


def choose(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    arcs, ids = graph(spark, a.graph)
    if a.command == "parts":
        return select.sketch_greedy(arcs, ids, sampling.seeds(spark, a.R), a.K, rebuild="always", early_stop=1.001, parts=a.parts, max_rounds=10, cascade_rounds=20)
    seeds = sampling.seeds(spark, a.R, in_order=bool(a.in_order))
    if a.method == "oracle":
        return select.oracle(arcs, seeds, results.parse_seeds(sys.stdin.read()))
    if a.method == "components":
        return select.component_greedy(arcs, ids, seeds, a.K)
    return select.sketch_greedy(arcs, ids, seeds, a.K, a.eps, a.tr, a.active_rate, max_rounds=20, cascade_rounds=50)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs a command; gives the lines that it wrote."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("spreadlab").getOrCreate()
    if a.command == "prepare":
        return sorted(prepare(spark, a))
    result = choose(spark, a)
    if "spread" in result.columns:
        lines = [f"{result.first().spread:.2f}"]
    else:
        result = result.cache()
        columns = 3 if a.command == "parts" else 4
        lines = results.result_lines(result, columns, a.command == "select" and a.method == "registers")
        if a.out:
            results.write_result_file(result, a.out, columns, a.command == "select" and a.method == "registers")
    if not a.out:
        print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
