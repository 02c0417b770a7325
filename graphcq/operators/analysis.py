"""Analysis of partitions of a query's atoms, kept as rows (source, target, label, component)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_nodes(partition: DataFrame, free: DataFrame) -> DataFrame:
    """(node): nodes of more than one component, and free variables (one column `name`) that are nodes of any."""
    ends = partition.select(F.col("source").alias("node"), "component").union(partition.select(F.col("target").alias("node"), "component"))
    shared = ends.groupBy("node").agg(F.count_distinct("component").alias("n"))
    return shared.join(free.select(F.col("name").alias("node"), F.lit(True).alias("free")).distinct(), "node", "left").where("n > 1 or free").select("node")


def json_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of `left` whose JSON, with keys in order, is not among that of `right`."""
    def digest(df: DataFrame) -> DataFrame:
        return df.withColumn("_md5", F.md5(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})))

    return digest(left).join(digest(right).select("_md5"), "_md5", "left_anti").drop("_md5")
