"""Query languages: conjunctive queries and conjunctive path queries, as text and as trees."""

from graphcq.syntax.cpq import ID, Concat, Edge, Id, Intersect, parse_cpq
from graphcq.syntax.cq import CQ, Atom, parse_cq

__all__ = ["CQ", "ID", "Atom", "Concat", "Edge", "Id", "Intersect", "parse_cpq", "parse_cq"]
