"""Relations and the operators on them: natural join, semi-join, projection with early deduplication."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one value of a join's variable that meet as one block, on either side.
BLOCK = 1024


@dataclass(frozen=True)
class Estimate:
    """About how many rows a relation has, and how many values each variable."""

    rows: float
    values: Mapping[str, float] = field(default_factory=dict)

    def join(self, other: Estimate) -> Estimate:
        """Under independence: a row finds as many partners as the wider side has rows per value of what they share."""
        rows = self.rows * other.rows
        values = {**self.values, **other.values}
        for v in set(self.values) & set(other.values):
            rows /= max(1.0, self.values[v], other.values[v])
            values[v] = min(self.values[v], other.values[v])
        return Estimate(rows, values)

    def project(self, variables) -> Estimate:
        values = {v: n for v, n in self.values.items() if v in variables}
        bound = 1.0
        for n in values.values():
            bound *= max(1.0, n)
        return Estimate(min(self.rows, bound), values)


@dataclass(frozen=True)
class Relation:
    """Rows over `variables`, in the columns of those names; `distinct` if no row is repeated.

    `label` tells a relation that is the edges of a label from the first variable to the last, for its statistics.
    """

    variables: tuple[str, ...]
    rows: DataFrame
    distinct: bool
    label: int | str | None = None

    @classmethod
    def of_pairs(cls, pairs: DataFrame, s: str, t: str, distinct: bool, label: int | str | None = None) -> Relation:
        """From pairs in the first two columns; one variable for both ends keeps the diagonal."""
        a, b = pairs.columns[:2]
        if s == t:
            return cls((s,), pairs.where(F.col(a) == F.col(b)).select(F.col(a).alias(s)), distinct)
        return cls((s, t), pairs.select(F.col(a).alias(s), F.col(b).alias(t)), distinct, label)

    def project(self, variables: list[str] | tuple[str, ...], dedupe: bool = False) -> Relation:
        """Keep some variables. Rows may then repeat; `dedupe` removes that."""
        keep = tuple(v for v in self.variables if v in variables)
        same = len(keep) == len(self.variables)
        out = self if same else Relation(keep, self.rows.select(*keep), False)
        return out.deduped() if dedupe else out

    def deduped(self) -> Relation:
        return self if self.distinct else replace(self, rows=self.rows.distinct(), distinct=True)

    def join(self, other: Relation) -> Relation:
        """Natural join; without common variables the cross product that the query asks for."""
        shared = [v for v in self.variables if v in other.variables]
        if shared and set(other.variables) == set(shared):
            return self.semi_join(other)
        rows = self.rows.join(other.rows, shared, "inner") if shared else self.rows.crossJoin(other.rows)
        variables = self.variables + tuple(v for v in other.variables if v not in shared)
        return Relation(variables, rows.select(*variables), self.distinct and other.distinct)

    def semi_join(self, other: Relation) -> Relation:
        """Rows that have a partner; `other` need not be deduplicated."""
        shared = [v for v in self.variables if v in other.variables]
        return replace(self, rows=self.rows.join(other.rows.select(*shared), shared, "left_semi"))

    def extend(self, v: str, others: list[Relation]) -> Relation:
        """Join relations of two variables that all add `v`: each row takes its values of `v` from the relation with the
        fewest for it, and the others only filter.

        A row makes as many rows as its least degree among them, never the product that a hub in one of them would make
        of a pairwise join. Degrees are one count per vertex, combined before the shuffle; the choice is a column, so
        rows of all choices go through one join, on (relation, vertex).
        """
        ends = [next(u for u in o.variables if u != v) for o in others]
        rows = self.rows
        for i, (o, u) in enumerate(zip(others, ends, strict=True)):
            rows = rows.join(o.rows.groupBy(u).agg(F.count("*").alias(f"_n{i}")), u)
        degrees = F.array(*(F.col(f"_n{i}") for i in range(len(others))))
        tagged = reduce(DataFrame.unionByName, [
            o.rows.select(F.lit(i).alias("_of"), F.col(u).alias("_end"), F.col(v)) for i, (o, u) in enumerate(zip(others, ends, strict=True))])
        least = F.array_position(degrees, F.array_min(degrees)).cast("int")
        rows = rows.select(*self.variables, least.alias("_least"))
        for turn in range(len(others)):  # the least relation first, then the others in turn
            of = (F.col("_least") + (turn - 1)) % len(others)
            end = F.element_at(F.array(*(F.col(u) for u in ends)), of + 1)
            rows = rows.withColumns({"_of": of, "_end": end})
            rows = rows.join(tagged, ["_of", "_end", v], "left_semi") if turn else rows.join(tagged, ["_of", "_end"])
        distinct = self.distinct and all(o.distinct for o in others)
        return Relation((*self.variables, v), rows.select(*self.variables, v), distinct)

    def meet(self, other: Relation, v: str) -> Relation:
        """Pairs of the ends of two relations that have a value of `v` in common, each pair once.

        An end with one value of `v` meets the ends of that value and no others, so its pairs cannot repeat: they are
        joined as they are. Only pairs of two ends that both have several values are made more than once and
        deduplicated. An end is on one side of that split, so the three joins have no pair in common.
        """
        (a,), (b,) = ([u for u in r.variables if u != v] for r in (self, other))
        hubs = [_hubs(self.rows, v, "_n"), _hubs(other.rows, v, "_m")]
        one, several = _by_values(self.rows, a, v)
        single, many = _by_values(other.rows, b, v)
        rows = [
            _in_blocks(one, other.deduped().rows, a, b, v, hubs),
            _in_blocks(several, single, a, b, v, hubs),
            _in_blocks(several, many, a, b, v, hubs).distinct(),
        ]
        return Relation((a, b), reduce(DataFrame.union, rows), True)


def _by_values(rows: DataFrame, u: str, v: str) -> tuple[DataFrame, DataFrame]:
    """Distinct rows (u, v): those of a `u` with one value of `v`, and the others."""
    ends = rows.groupBy(u).agg(F.min(v).alias("_low"), F.max(v).alias("_high"))
    one = ends.where("_low = _high").select(u, F.col("_low").alias(v))
    return one, rows.join(ends.where("_low < _high").select(u), u, "left_semi").select(u, v).distinct()


def _hubs(rows: DataFrame, v: str, n: str) -> DataFrame:
    """The values of `v` in more rows than a block has, with their number; at most one for each BLOCK rows."""
    return rows.groupBy(v).agg(F.count("*").alias(n)).where(F.col(n) > BLOCK)


def _in_blocks(left: DataFrame, right: DataFrame, a: str, b: str, v: str, hubs: list[DataFrame]) -> DataFrame:
    """(a, b) of the join on `v`, where a hub's rows are dealt to blocks and each block of one side meets each of the other.

    So tasks share a hub's pairs. A row is copied once for each block that it meets: at most one copy for each BLOCK pairs
    besides the rows themselves.
    """
    def dealt(rows: DataFrame, u: str, own: str, met: str, block: str, partner: str) -> DataFrame:
        for h in hubs:
            rows = rows.join(F.broadcast(h), v, "left")
        blocks = [F.ceil(F.coalesce(F.col(n), F.lit(1)) / BLOCK).cast("int") for n in (own, met)]
        return rows.select(u, v, F.pmod(F.xxhash64(u), blocks[0]).cast("int").alias(block), F.explode(F.sequence(F.lit(0), blocks[1] - 1)).alias(partner))

    return dealt(left, a, "_n", "_m", "_i", "_j").join(dealt(right, b, "_m", "_n", "_j", "_i"), [v, "_i", "_j"]).select(a, b)
