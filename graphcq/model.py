"""Graphs as DataFrames of (src, label, trg)."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE_SCHEMA = "src bigint, label int, trg bigint"
STATS_SCHEMA = "label int, edges bigint, sources bigint, targets bigint, source_fan double, target_fan double"


#: One row of 2000 cells: a sum of squared degrees within some 3 %.
_CELLS = {"eps": 0.001, "confidence": 0.5, "seed": 42}


class LabelStats(NamedTuple):
    """Edges of a label, about how many sources and targets they have, and about how many edges an edge's source, or
    target, has on average: there hubs count once per edge."""

    edges: int
    sources: int
    targets: int
    source_fan: float
    target_fan: float


def _cells(sketch: bytes) -> tuple[int, ...]:
    """The cells of a count-min sketch of one row."""
    _, _, depth, width = struct.unpack_from(">iqii", sketch)
    return struct.unpack_from(f">{width}q", sketch, 20 + 8 * depth)


def _products(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    """Sum over values of one degree times the other: the products of cells less what chance puts together."""
    width = len(a)
    return (sum(x * y for x, y in zip(a, b, strict=True)) - sum(a) * sum(b) / width) / (1 - 1 / width)


def _fan(sketch: bytes) -> float:
    """Squared degrees over degrees."""
    cells = _cells(sketch)
    return max(1.0, _products(cells, cells) / sum(cells))


@dataclass(frozen=True)
class Graph:
    """Edges, and how many times each may occur.

    `distinct` says that no edge is repeated; otherwise answers are deduplicated where they are made, which is cheaper
    than deduplicating all edges first. `vertices` (one column `v`) defaults to the endpoints of the edges.
    """

    edges: DataFrame
    distinct: bool = False
    vertex_table: DataFrame | None = field(default=None, compare=False)
    known: dict[int, LabelStats] = field(default_factory=dict, compare=False, repr=False)
    degrees: dict[tuple[int, str], tuple[int, ...]] = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def of(cls, edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        """From any columns named src, label and trg; rows with a null in them are no edges."""
        clean = edges.select(F.col("src").cast("bigint"), F.col("label").cast("int"), F.col("trg").cast("bigint"))
        return cls(clean.dropna(), False, vertices)

    @property
    def vertices(self) -> DataFrame:
        if self.vertex_table is not None:
            return self.vertex_table
        ends = self.edges.select(F.col("src").alias("v")).union(self.edges.select(F.col("trg").alias("v")))
        return ends.distinct()

    def labelled(self, label: int | str) -> DataFrame:
        """(src, trg) of one label; a label that is no number matches no edge."""
        known = isinstance(label, int)
        return self.edges.where(F.col("label") == F.lit(label) if known else F.lit(False)).select("src", "trg")

    def statistics(self, labels: Iterable[int]) -> dict[int, LabelStats]:
        """Sizes of some labels, in one pass over those not known yet; a row per label comes to the driver."""
        missing = sorted({x for x in labels if isinstance(x, int)} - set(self.known))
        if missing:
            own = self.edges.where(F.col("label").isin(missing)).groupBy("label")
            values = [F.approx_count_distinct(c, 0.05) for c in ("src", "trg")]
            degrees = [F.count_min_sketch(F.xxhash64(c), **{k: F.lit(v) for k, v in _CELLS.items()}) for c in ("src", "trg")]
            found = own.agg(F.count("*"), *values, *degrees).collect()
            self.known.update({x: LabelStats(0, 0, 0, 0.0, 0.0) for x in missing})
            self.known.update({r[0]: LabelStats(*r[1:4], _fan(r[4]), _fan(r[5])) for r in found})
        return self.known

    def join_size(self, a: tuple[int, str], b: tuple[int, str]) -> tuple[float, int]:
        """About how many rows a join of two labels makes on an end of each, src or trg, and how many edges go into it; one
        pass over the ends not known yet, a sketch of each comes to the driver."""
        missing = sorted({a, b} - set(self.degrees))
        if missing:
            ends = [self.labelled(label).select(F.lit(i).alias("of"), F.xxhash64(end).alias("v")) for i, (label, end) in enumerate(missing)]
            found = reduce(DataFrame.union, ends).groupBy("of").agg(F.count_min_sketch("v", **{k: F.lit(x) for k, x in _CELLS.items()})).collect()
            self.degrees.update(dict.fromkeys(missing, ()))
            self.degrees.update({missing[r[0]]: _cells(r[1]) for r in found})
        one, other = self.degrees[a], self.degrees[b]
        return _products(one, other) if one and other else 0.0, sum(one) + sum(other)

    def as_set(self) -> Graph:
        """The same graph with each edge once."""
        return self if self.distinct else Graph(self.edges.distinct(), True, self.vertex_table, self.known)
