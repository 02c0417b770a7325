"""From queries to DataFrames.

One relation per atom or component; then, in this order:

1. reduction: a relation whose other variables occur nowhere else and are not free only filters: it becomes a semi-join
   on its last variable. Repeated, this takes all existential branches off acyclic queries, leaves first;
2. joins, connected parts one by one, in the greedy order of least estimated intermediate rows: edges, sources and
   targets per label tell how many partners a row finds, and a relation that adds no variable only filters; as soon as a
   variable is dead, it is projected away and the rows deduplicated. Where a step closes a cycle, so that two relations
   or more would add the same variable, and the edges there hang on hubs, the step joins them all at once, each row by
   the relation that has least for it (`Relation.extend`): worst-case optimal per step. Elsewhere pairs are cheaper;
3. two labels that meet in a variable that is not free, and make far more rows than they have edges, are joined so that
   only pairs which may repeat are deduplicated (`Relation.meet`), not all that the join makes;
4. unconnected parts are deduplicated on their free variables before their product is taken, and parts without free
   variables are cut to one row.

Catalyst and adaptive execution choose the join algorithms, broadcast sides and partition counts from there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcq.model import Graph, LabelStats
from graphcq.operators.relation import Estimate, Relation
from graphcq.plans.components import Component
from graphcq.plans.normalize import normalize
from graphcq.syntax.cpq import CPQ, Edge, Id, to_cq
from graphcq.syntax.cq import CQ

#: A cycle is closed by all its relations at once if an edge's end has more edges than this, on average over edges.
HUB_FAN = 64.0

#: Two labels meet by `Relation.meet` if a join would make more rows than this, and more than this many per edge.
MEET_ROWS, MEET_FAN = 1e7, 8.0


def _reduced(relations: list[Relation], head: tuple[str, ...]) -> list[Relation]:
    """Turn relations that only filter into semi-joins, until none is left to turn."""
    pending = list(relations)
    while True:
        uses = Counter(v for r in pending for v in r.variables)
        for i, r in enumerate(pending):
            live = [v for v in r.variables if v in head or uses[v] > 1]
            others = [j for j, o in enumerate(pending) if j != i and set(live) <= set(o.variables)]
            if live and others and (len(live) < len(r.variables) or len(r.variables) == 1):
                into = max(others, key=lambda j: (len(pending[j].variables), -j))
                pending[into] = pending[into].semi_join(r.project(live))
                del pending[i]
                break
        else:
            return pending


def _parts(relations: list[Relation]) -> list[list[Relation]]:
    """Groups of relations that share variables, directly or not."""
    groups: list[tuple[set[str], list[Relation]]] = []
    for r in relations:
        touching = [g for g in groups if g[0] & set(r.variables)]
        merged = (set(r.variables).union(*(g[0] for g in touching)), [x for g in touching for x in g[1]] + [r])
        groups = [g for g in groups if g not in touching] + [merged]
    return [g[1] for g in groups]


def _estimate(r: Relation, stats: Mapping[int, LabelStats]) -> Estimate:
    """By a label's statistics, or a guess that makes all other relations alike."""
    if r.label in stats and len(r.variables) == 2:
        n = stats[r.label]
        return Estimate(n.edges, {r.variables[0]: n.sources, r.variables[1]: n.targets})
    return Estimate(1e6, dict.fromkeys(r.variables, 1e5))


def _order(relations: list[Relation], head: tuple[str, ...], stats: Mapping[int, LabelStats]) -> list[int]:
    """The join order of least summed intermediate rows among greedy ones, one for each first relation."""
    guess = [_estimate(r, stats) for r in relations]
    best: tuple[float, list[int]] | None = None
    for start in range(len(relations)):
        order, cost, out = [start], 0.0, guess[start]
        while len(order) < len(relations):
            left = [i for i in range(len(relations)) if i not in order]
            near = [i for i in left if set(relations[i].variables) & set(out.values)]
            joined = {i: out.join(guess[i]) for i in near}
            step = min(near, key=lambda i: (joined[i].rows, i))
            order.append(step)
            out = joined[step]
            cost += out.rows
            out = out.project(set(head).union(*(relations[i].variables for i in left if i != step)) & set(out.values))
        if best is None or cost < best[0]:
            best = cost, order
    return best[1]


def _closing(out: Relation, relation: Relation, pending: list[Relation], stats: Mapping[int, LabelStats]) -> list[Relation]:
    """The relations that would add the same variable to `out`, and nothing else; none if `relation` is the only one."""
    new = set(relation.variables) - set(out.variables)
    same = [r for r in (relation, *pending) if len(r.variables) == 2 and set(r.variables) - set(out.variables) == new]
    return same if len(new) == 1 and len(same) > 1 and all(r.label in stats for r in same) else []


def _fan_of(relation: Relation, out: Relation, stats: Mapping[int, LabelStats]) -> float:
    """How many partners a row of `out` finds in a relation's edges, if hubs there are hubs here."""
    n = stats[relation.label]
    return n.source_fan if relation.variables[0] in out.variables else n.target_fan


def _meeting(relations: list[Relation], head: tuple[str, ...], graph: Graph) -> str | None:
    """The variable that the edges of two labels meet in, if it is not free and a join on it would make many rows."""
    if len(relations) != 2 or not all(isinstance(r.label, int) and len(r.variables) == 2 for r in relations):
        return None
    shared = set(relations[0].variables) & set(relations[1].variables)
    if len(shared) != 1 or shared & set(head):
        return None
    (v,) = shared
    rows, edges = graph.join_size(*((r.label, "src" if r.variables[0] == v else "trg") for r in relations))
    return v if rows > max(MEET_ROWS, MEET_FAN * edges) else None


def _joined(relations: list[Relation], head: tuple[str, ...], stats: Mapping[int, LabelStats]) -> Relation:
    """Join one connected group, down to its free variables."""
    pending = [relations[i] for i in _order(relations, head, stats)]
    out = pending.pop(0)
    while True:
        needed = set(head).union(*(r.variables for r in pending))
        if not set(out.variables) <= needed and (set(out.variables) & needed):
            out = out.project(tuple(needed), dedupe=bool(pending))
        if not pending:
            return out
        closing = _closing(out, pending[0], pending[1:], stats)
        least = min(closing, key=lambda r: _fan_of(r, out, stats), default=pending[0])
        if closing and _fan_of(least, out, stats) > HUB_FAN:
            (v,) = set(least.variables) - set(out.variables)
            out = out.extend(v, closing)
            pending = [r for r in pending if not any(r is c for c in closing)]
        else:
            out = out.join(least)
            pending = [r for r in pending if r is not least]


def answer(relations: list[Relation], head: tuple[str, ...], graph: Graph) -> DataFrame:
    """Distinct rows over the free variables, in head order; for none, one row with `satisfied`.

    Statistics are asked for only where there is an order to choose: three relations that hang together, or more. Of two
    labels that meet in a variable that is not free, the size of their join is.
    """
    groups = _parts(_reduced(relations, head))
    stats = graph.statistics(r.label for g in groups if len(g) > 2 for r in g)
    parts = [g[0].meet(g[1], v) if (v := _meeting(g, head, graph)) else _joined(g, head, stats) for g in groups]
    filters = [p for p in parts if not set(p.variables) & set(head)]
    rest = [p.project(head) for p in parts if set(p.variables) & set(head)]
    some = [p.rows.select(F.lit(1).alias(f"_sat{i}")).limit(1) for i, p in enumerate(filters)]
    if not head:
        every = reduce(DataFrame.crossJoin, some)
        return every.agg((F.count("*") > 0).alias("satisfied"))
    if len(rest) > 1:
        rest = [p.deduped() for p in rest]
    out = reduce(Relation.join, rest).deduped().rows
    for one in some:  # at most one row each
        out = out.crossJoin(F.broadcast(one))
    return out.select(*head)


def compile_cq(cq: CQ, graph: Graph) -> DataFrame:
    """The answers of a query: one column per free variable, distinct; `satisfied` for a query without free variables."""
    relations = [Relation.of_pairs(graph.labelled(a.label), a.src, a.trg, graph.distinct, a.label) for a in cq.atoms]
    for v in cq.isolated:
        relations.append(Relation((v,), graph.vertices.select(F.col("v").alias(v)), True))
    return answer(relations, cq.head, graph)


def compile_cpq(cpq: CPQ, graph: Graph) -> DataFrame:
    """The pairs (src, trg) of a path query, distinct: those of its normal form, as a conjunctive query."""
    cq, s, t = to_cq(normalize(cpq))
    rows = compile_cq(cq, graph)
    return rows.select(F.col(s).alias("src"), F.col(t).alias("trg"))


def compile_components(components: list[Component], head: tuple[str, ...], graph: Graph, lookup=None) -> DataFrame:
    """The answers of a cover: each component's pairs, joined. `lookup` may give stored pairs of a path query."""
    relations = []
    for c in components:
        if isinstance(c.cpq, Id):
            relations.append(Relation((c.s,), graph.vertices.select(F.col("v").alias(c.s)), True))
            continue
        pairs = lookup(c.cpq) if lookup else None
        if pairs is None and isinstance(c.cpq, Edge):  # the edges themselves, from source to target
            s, t = (c.t, c.s) if c.cpq.inverse else (c.s, c.t)
            relations.append(Relation.of_pairs(graph.labelled(c.cpq.label), s, t, graph.distinct, c.cpq.label))
            continue
        relations.append(Relation.of_pairs(compile_cpq(c.cpq, graph) if pairs is None else pairs, c.s, c.t, True))
    return answer(relations, head, graph)
