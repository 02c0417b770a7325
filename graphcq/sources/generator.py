"""Synthetic graphs: small patterns embedded at even distances, then a regular filling."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphcq.model import Graph

# Edges (src, trg, label) of the eight patterns.
PATTERNS: dict[str, list[tuple[int, int, int]]] = {
    "example1": [(0, 1, 1), (1, 2, 2), (2, 3, 3), (3, 0, 4), (0, 2, 5)],
    "example2": [(0, 1, 1), (1, 2, 2)],
    "example3": [(0, 1, 1), (1, 2, 2), (2, 3, 3), (3, 0, 4), (0, 2, 5), (0, 0, 6)],
    "example4": [(0, 1, 1), (1, 2, 2), (2, 3, 3), (3, 0, 4), (0, 2, 5), (0, 0, 6), (1, 3, 7)],
    "example5": [(0, 1, 3), (1, 2, 4), (1, 3, 5), (2, 3, 6)],
    "example6": [(0, 1, 1), (1, 0, 1), (1, 2, 2), (2, 3, 3), (3, 4, 4), (3, 5, 5)],
    "example7": [(0, 1, 1), (0, 1, 2), (1, 2, 3), (1, 2, 4), (2, 0, 5), (2, 0, 6), (2, 2, 7)],
    "example8": [(0, 1, 1), (0, 1, 2), (1, 2, 3), (2, 3, 4), (3, 4, 5), (4, 0, 6), (4, 0, 7), (2, 0, 8)],
}


def needs(name: str) -> tuple[int, int]:
    """Least vertices and labels of a pattern; ids and labels count from 0."""
    edges = PATTERNS[name]
    return 1 + max(max(s, t) for s, t, _ in edges), 1 + max(label for _, _, label in edges)


def placed(names: list[str], copies: int, vertices: int, labels: int) -> list[tuple[int, int, int]]:
    """Edges of `copies` of each pattern, the n-th copy of all at n strides."""
    if copies < 0:
        raise ValueError("copies must not be negative")
    if unknown := [n for n in names if n not in PATTERNS]:
        raise ValueError(f"unknown patterns: {', '.join(unknown)}")
    for name in names if copies else []:
        v, n = needs(name)
        if vertices < v or labels < n:
            raise ValueError(f"{name} needs {v} vertices and {n} labels at least")
    stride = max(1, vertices // max(1, len(names) * copies))
    order = [name for name in names for _ in range(copies)]
    return [((s + i * stride) % vertices, (t + i * stride) % vertices, label) for i, name in enumerate(order) for s, t, label in PATTERNS[name]]


def generate(spark: SparkSession, vertices: int = 200_000, edges: int = 1_000_000, labels: int = 10, seed: int = 1,
             names: tuple[str, ...] = ("example1",), copies: int = 1, exact_labels: bool = False) -> DataFrame:
    """(src, label, trg) of `edges` edges, repeated ones included.

    Edge i of the filling goes from i mod V to 17 i + 23 mod V (the next vertex, if that is the same one). Labels come
    from a hash of i and the seed, made in place; `exact_labels` draws them one by one on the driver instead, in the
    order of Python's generator, for small graphs that must equal a file of the same seed.
    """
    fixed = placed(list(names), copies if names else 0, vertices, labels)
    rest = edges - len(fixed)
    if rest < 0:
        raise ValueError(f"{len(fixed)} edges are needed for the patterns")
    i = F.col("id")
    trg = (i * 17 + 23) % vertices
    trg = F.when(trg == i % vertices, (trg + 1) % vertices).otherwise(trg)
    base = spark.range(rest)
    if exact_labels:
        rng = random.Random(seed)
        drawn = spark.createDataFrame([(n, rng.randrange(labels)) for n in range(rest)], "id long, label int")
        base = base.join(drawn, "id")
    else:
        base = base.withColumn("label", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(labels)).cast("int"))
    filling = base.select((i % vertices).alias("src"), "label", trg.alias("trg"))
    pattern = spark.createDataFrame([(s, label, t) for s, t, label in fixed], "src long, label int, trg long")
    return pattern.union(filling)


def generated_graph(spark: SparkSession, **options) -> Graph:
    v = options.get("vertices", 200_000)
    return Graph(generate(spark, **options).distinct(), True, spark.range(v).select(F.col("id").alias("v")))


def file_name(vertices: int, edges: int, labels: int, seed: int) -> str:
    return f"graph_v{vertices}_e{edges}_l{labels}_s{seed}.edge"
