"""Edges that arrive as files: kept in a Parquet graph that the batch engine reads.

Queries here have set semantics and no time, so there is nothing to window: a stream only adds edges. Each micro-batch
adds what the graph does not have yet.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphcq.model import EDGE_SCHEMA
from graphcq.sources.edgefile import edges_of_lines


def edge_stream(spark: SparkSession, path: str) -> DataFrame:
    """(src, label, trg) of text files without headers, `src trg label` a line, that appear in a folder."""
    return edges_of_lines(spark.readStream.text(path))


def keep_edges(stream: DataFrame, graph_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append new edges to graph_path/edges, partitioned by label; `once` takes what is there and ends."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = f"{graph_path}/edges"
        new = batch.distinct()
        labels = [r[0] for r in new.select("label").distinct().collect()]  # of the alphabet: only their folders are read
        try:
            old = spark.read.schema(EDGE_SCHEMA).parquet(path).where(F.col("label").isin(labels))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            new = new.join(old, ["src", "label", "trg"], "left_anti")
        new.write.mode("append").partitionBy("label").parquet(path)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
