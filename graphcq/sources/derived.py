"""Graphs made of the relational test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphcq.model import Graph

# Offsets that keep the keys of the tables apart.
NATION, SUPPLIER, CUSTOMER, PART, ORDER = 100, 500_000, 1_000_000, 2_000_000, 10_000_000


def heterogeneous(spark: SparkSession, sf_dir: str) -> Graph:
    """Seven labels: customer-nation 0, nation-region 1, supplier-nation 2, order-customer 3, order-part 4,
    order-supplier 5, supplier-part 6. A label read from a query leaves only its own branch in the plan."""
    def edge(table: str, label: int, src: str, a: int, trg: str, b: int) -> DataFrame:
        t = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return t.select((F.col(src).cast("bigint") + a).alias("src"), F.lit(label).alias("label"), (F.col(trg).cast("bigint") + b).alias("trg"))

    edges = [
        edge("customer", 0, "c_custkey", CUSTOMER, "c_nationkey", NATION),
        edge("nation", 1, "n_nationkey", NATION, "n_regionkey", 0),
        edge("supplier", 2, "s_suppkey", SUPPLIER, "s_nationkey", NATION),
        edge("orders", 3, "o_orderkey", ORDER, "o_custkey", CUSTOMER),
        edge("lineitem", 4, "l_orderkey", ORDER, "l_partkey", PART),
        edge("lineitem", 5, "l_orderkey", ORDER, "l_suppkey", SUPPLIER),
        edge("lineitem", 6, "l_suppkey", SUPPLIER, "l_partkey", PART),
    ]
    return Graph.of(reduce(DataFrame.union, edges))


def order_customer(spark: SparkSession, sf_dir: str, by_priority: bool = False) -> Graph:
    """order -> customer without offsets, so paths and cycles come up; one label, or the order's priority as label."""
    label = F.substring("o_orderpriority", 1, 1).cast("int") - 1 if by_priority else F.lit(0)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return Graph.of(orders.select(F.col("o_orderkey").alias("src"), label.alias("label"), F.col("o_custkey").alias("trg")))
