"""Stored pairs of path queries, looked up by canonical text: the counterpart of a path index."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphcq.model import Graph
from graphcq.plans.normalize import canonical
from graphcq.plans.planner import compile_cpq
from graphcq.syntax.cpq import CPQ, Concat, Edge


def label_sequences(labels: list[int], k: int) -> list[CPQ]:
    """All sequences of 1 to k labels, forward or backward."""
    steps = [Edge(label, back) for label in labels for back in (False, True)]
    out: list[CPQ] = list(steps)
    chains: list[CPQ] = list(steps)
    for _ in range(k - 1):
        chains = [Concat(a, b) for a, b in itertools.product(chains, steps)]
        out += chains
    return out


class PairStore:
    """Pairs (canonical, src, trg); a lookup of a path query that is not stored gives None."""

    def has(self, cpq: CPQ) -> bool:
        return canonical(cpq) in self.keys

    def __init__(self, pairs: DataFrame, keys: set[str], k: int) -> None:
        self.pairs, self.keys, self.k = pairs, keys, k

    @classmethod
    def build(cls, graph: Graph, queries: list[CPQ], k: int) -> PairStore:
        """Of given path queries, each compiled once; identical forms count once."""
        forms = {canonical(q): q for q in queries}
        parts = [compile_cpq(q, graph).select(F.lit(c).alias("canonical"), "src", "trg") for c, q in sorted(forms.items())]
        if not parts:
            raise ValueError("a store needs a path query")
        pairs = parts[0]
        for p in parts[1:]:
            pairs = pairs.union(p)
        return cls(pairs, set(forms), k)

    def save(self, path: str) -> None:
        """One Parquet folder per canonical text, and the true k beside them."""
        self.pairs.hint("rebalance", "canonical").write.mode("overwrite").partitionBy("canonical").parquet(f"{path}/pairs")
        meta = json.dumps({"k": self.k, "keys": sorted(self.keys)})
        self.pairs.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PairStore:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        pairs = spark.read.schema("src bigint, trg bigint, canonical string").parquet(f"{path}/pairs")
        return cls(pairs.select("canonical", "src", "trg"), set(meta["keys"]), meta["k"])

    def lookup(self, cpq: CPQ) -> DataFrame | None:
        key = canonical(cpq)
        return self.pairs.where(F.col("canonical") == key).select("src", "trg") if key in self.keys else None
