"""Normal forms of path queries: associativity of both operations, id as the unit of ◦, and ∩ as a sorted set."""

from __future__ import annotations

from functools import reduce

from graphcq.syntax.cpq import CPQ, ID, Concat, Edge, Id, Intersect


def _parts(cpq: CPQ, kind: type) -> list[CPQ]:
    """Normalized operands of a chain of one operation, flat even where normalizing an operand made a chain."""
    if not isinstance(cpq, kind):
        return [cpq]
    out: list[CPQ] = []
    for side in (cpq.left, cpq.right):
        out += _parts(normalize(side), kind)
    return out


def normalize(cpq: CPQ) -> CPQ:
    """The normal form. id is dropped from concatenations but kept in intersections, where it filters."""
    if isinstance(cpq, Id | Edge):
        return cpq
    if isinstance(cpq, Concat):
        parts = [p for p in _parts(cpq, Concat) if p != ID]
        return reduce(Concat, parts) if parts else ID
    if isinstance(cpq, Intersect):
        distinct = {canonical_text(p): p for p in _parts(cpq, Intersect)}
        return reduce(Intersect, [distinct[k] for k in sorted(distinct)])
    raise ValueError(f"not a path query: {cpq!r}")


def canonical_text(normal: CPQ) -> str:
    """Text of a normal form; chains are written flat."""
    for kind, sign in ((Concat, "◦"), (Intersect, "∩")):
        if isinstance(normal, kind):
            chain: list[CPQ] = []
            while isinstance(normal, kind):
                chain.append(normal.right)
                normal = normal.left
            return f"({sign.join(canonical_text(p) for p in [normal, *reversed(chain)])})"
    return str(normal)


def canonical(cpq: CPQ) -> str:
    """Equal for path queries that the rewrites make equal."""
    return canonical_text(normalize(cpq))
