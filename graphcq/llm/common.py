"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import sys
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint in the shared folder.

    The folder is the session's spark.checkpoint.dir; one is made only where that is unset and all runs in this process, as
    in tests: elsewhere executors could not read it, and that is an error. Lost executors cost nothing afterwards: the rows
    are read again from the shared folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint(eager=True)


def forget(*frames: DataFrame) -> None:
    """Delete the files of checkpoints that nothing will read any more."""
    for df in frames:
        plan = df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() == "LogicalRDD" and (file := plan.rdd().getCheckpointFile()).isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, after which a Python worker, which Spark uses again, gives the memory that it has freed back to the system."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def parts_for(n: int, per_part: int, least: int = 1) -> int:
    """Partitions so that each holds about `per_part` of `n` units."""
    return max(least, -(-n // per_part))


def is_small(df: DataFrame, max_rows: int) -> bool:
    """True if `df` has at most `max_rows` rows: the check before any broadcast."""
    return df.limit(max_rows + 1).count() <= max_rows


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph, by alternating large-star and small-star steps.

    `edges` has two long columns (u, v). Returns (v, component) for every vertex with an edge to another vertex, where
    component is the smallest vertex reachable. Null ends and loops are ignored; repeated edges count once; no edges
    give no rows. Each step is two grouped minima and two joins on vertices; it ends when every vertex has one smaller
    neighbour or only larger ones, which the first minima of a step tell. A hub's edges are pre-aggregated for its
    minimum; the minima are checkpointed before the join, so that both its sides are plain shuffles, which adaptive
    execution splits where a hub is large. Nothing is collected but one flag per step.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = durable(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        smaller = F.count_if(F.col("v") < F.col("u"))
        open_ = (smaller > 1) | ((smaller > 0) & (F.max("v") > F.col("u")))
        low = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), open_.alias("open")))
        if not low.agg(F.max("open")).first()[0]:
            forget(low)
            break
        large = durable(e.select(F.col("u").alias("x"), F.col("v").alias("u")).join(low.select("u", "m"), "u").select(F.col("x").alias("u"), F.col("m").alias("v")))
        forget(e, low)
        low = durable(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        forget(large, low)
    roots = e.select(F.col("v")).distinct().select("v", F.col("v").alias("component"))
    return e.select(F.col("u").alias("v"), F.col("v").alias("component")).union(roots)


def pick(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Only the named columns, so that extra ones of any name cannot clash."""
    return df.select(*[df[c] for c in columns])
