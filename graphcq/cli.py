"""Command line: evaluate queries over a graph, or generate one.

    python -m graphcq.cli eval GRAPH [--queries-file FILE | QUERY...]
    python -m graphcq.cli generate OUT [--vertices V] [--edges E] [--labels L] [--seed S] [--embed NAME...]
"""

from __future__ import annotations

import argparse
import random
import sys

from pyspark.sql import SparkSession

from graphcq.engine import Engine
from graphcq.functions.answers import answer_count, first_answers, format_answer, print_order
from graphcq.plans.components import Strategy
from graphcq.sources import edgefile, generator


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="graphcq", description="Conjunctive queries over edge-labelled graphs.")
    commands = parser.add_subparsers(dest="command")
    ev = commands.add_parser("eval", help="evaluate queries")
    ev.add_argument("graph", help="a .edge file, or a folder written by write_graph")
    ev.add_argument("--queries-file", help="one query a line; blank lines and # lines are skipped")
    ev.add_argument("--strategy", choices=[s.value for s in Strategy], help="evaluate by components instead of atoms")
    ev.add_argument("--show-components", action="store_true")
    ev.add_argument("text", nargs="*", help="a query; words are joined by spaces")
    gen = commands.add_parser("generate", help="write a synthetic .edge file")
    gen.add_argument("out", help="folder to write to")
    for name, value in (("--vertices", 200_000), ("--edges", 1_000_000), ("--labels", 10), ("--embed-count", 1)):
        gen.add_argument(name, type=int, default=value)
    gen.add_argument("--seed", type=int, help="random if not given")
    gen.add_argument("--embed", nargs="*", default=["example1"])
    gen.add_argument("--no-embed", action="store_true")
    return parser


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    graph = edgefile.read_edge_file(spark, args.graph) if args.graph.endswith(".edge") else edgefile.read_graph(spark, args.graph)
    engine = Engine(graph)

    def answers(text: str):
        return engine.query_by(text, Strategy(args.strategy)) if args.strategy else engine.query(text)

    if args.queries_file:
        queries = edgefile.read_queries(spark, args.queries_file)
        if not queries:
            print(f"No queries found in {args.queries_file}")
        for i, text in queries:
            print(f"query={i} answers={answer_count(answers(text)).first()[0]}")
        return
    text = " ".join(args.text)
    if not text:
        raise SystemExit("a query or --queries-file is needed")
    parts = engine.cover(text)
    if args.show_components:
        for c in parts:
            print(c)
    found = answers(text)
    print(f"answers={answer_count(found).first()[0]}")
    for row in first_answers(found, 5, print_order(parts)).collect():
        print(format_answer(row))


def _generate(spark: SparkSession, args: argparse.Namespace) -> None:
    seed = random.randrange(1 << 31) if args.seed is None else args.seed
    names = () if args.no_embed else tuple(args.embed)
    edges = generator.generate(spark, args.vertices, args.edges, args.labels, seed, names, args.embed_count)
    to = f"{args.out}/{generator.file_name(args.vertices, args.edges, args.labels, seed)}"
    edgefile.write_edge_file(edgefile.Graph(edges), to, args.vertices, args.labels)
    print(to)


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if not args.command:
        parser.print_usage()
        return 0
    spark = SparkSession.builder.appName("graphcq").getOrCreate()
    (_evaluate if args.command == "eval" else _generate)(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
