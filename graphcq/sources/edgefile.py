"""Text edge files: a header `V E L`, then a line `src trg label` per edge; and Parquet graphs partitioned by label."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphcq.model import EDGE_SCHEMA, STATS_SCHEMA, Graph, LabelStats

_EDGE = r"^\s*(\d+)\s+(\d+)\s+(\d+)\s*$"


def edges_of_lines(lines: DataFrame) -> DataFrame:
    """(src, label, trg) of the lines (column `value`) that are edges."""
    part = [F.regexp_extract("value", _EDGE, i) for i in (1, 2, 3)]
    return lines.where(F.col("value").rlike(_EDGE)).select(part[0].cast("bigint").alias("src"), part[2].cast("int").alias("label"), part[1].cast("bigint").alias("trg"))


def read_edge_file(spark: SparkSession, path: str) -> Graph:
    """Read an edge file, or a folder of its parts. Vertices are 0 .. V-1 by its header; edges become a set.

    The header is the first line of the first part. It is taken off by its place, so an edge that reads like it stays.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
    place = F.struct("file", "at", "line")  # line ids grow within a block of a file
    header = lines.agg(F.min_by("value", place).alias("value"), F.min(place).alias("place")).first()
    if header["value"] is None:
        raise ValueError(f"no header in {path}")
    v, _, _ = (int(x) for x in header["value"].split())
    edges = edges_of_lines(lines.where(F.col("line") != header["place"]["line"]))
    return Graph(edges.distinct(), True, spark.range(v).select(F.col("id").alias("v")))


def write_edge_file(graph: Graph, path: str, vertices: int, labels: int) -> None:
    """Write the format of `read_edge_file`, as a folder of text parts whose first holds the header."""
    edges = graph.edges
    header = edges.sparkSession.createDataFrame([(0, None, None, f"{vertices} {edges.count()} {labels}")], "part int, src bigint, trg bigint, value string")
    lines = edges.select(F.lit(1).alias("part"), "src", "trg", F.concat_ws(" ", "src", "trg", "label").alias("value"))
    place = ("part", "src", "trg")
    header.union(lines).repartitionByRange(*place).sortWithinPartitions(*place).select("value").write.mode("overwrite").text(path)


def write_graph(graph: Graph, path: str) -> None:
    """Store a graph as a set, one Parquet folder per label, so that an atom reads its label alone; large labels by many tasks.

    A row of statistics per label goes beside it, so that queries need not ask for them again. Edges added later leave
    it as it is, which may cost speed and changes no answer.
    """
    graph.as_set().edges.hint("rebalance", "label").write.mode("overwrite").partitionBy("label").parquet(f"{path}/edges")
    graph.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    spark = graph.edges.sparkSession
    stored = spark.read.schema(EDGE_SCHEMA).parquet(f"{path}/edges")
    stats = Graph(stored, True).statistics(r[0] for r in stored.select("label").distinct().collect())
    spark.createDataFrame([(k, *v) for k, v in stats.items()], STATS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")


def read_graph(spark: SparkSession, path: str) -> Graph:
    """A graph that `write_graph` stored, with its statistics if they are there."""
    edges = spark.read.schema(EDGE_SCHEMA).parquet(f"{path}/edges")
    try:
        known = {r[0]: LabelStats(*r[1:]) for r in spark.read.schema(STATS_SCHEMA).parquet(f"{path}/statistics").collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = {}
    return Graph(edges.select("src", "label", "trg"), True, spark.read.parquet(f"{path}/vertices"), known)


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """A partition of a query's atoms from JSON: an array of {source, target, label, component}."""
    return spark.read.schema("source string, target string, label string, component int").json(path, multiLine=True)


def read_free_variables(spark: SparkSession, path: str) -> DataFrame:
    """(name) from a JSON array of strings; there are as many as a query has free variables."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame([(v,) for v in json.loads(text)], "name string")


def read_queries(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, text) of the queries of a file: one a line, trimmed; blank lines and those that begin with # do not count."""
    lines = [r[0].strip() for r in spark.read.text(path).collect()]
    kept = [x for x in lines if x and not x.startswith("#")]
    return list(enumerate(kept, 1))
