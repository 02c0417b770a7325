"""The engine's front: evaluate texts and trees over a graph."""

from __future__ import annotations

import itertools
from collections.abc import Mapping

from pyspark.sql import DataFrame

from graphcq.model import Graph
from graphcq.plans.components import Component, Strategy, choose_cover, exact_covers
from graphcq.plans.planner import compile_components, compile_cpq, compile_cq
from graphcq.sources.pairstore import PairStore
from graphcq.syntax import CQ, parse_cpq, parse_cq
from graphcq.syntax.cpq import CPQ, Edge

#: Covers that are looked through for one of stored components.
COVERS = 1_000


class Engine:
    """Queries over one graph, with an optional store of pairs and alphabet of label names."""

    def __init__(self, graph: Graph, k: int = 2, store: PairStore | None = None, labels: Mapping[str, int] | None = None) -> None:
        self.graph, self.k, self.store, self.labels = graph, store.k if store else k, store, labels

    def parse(self, text: str) -> CQ:
        return parse_cq(text, self.labels)

    def query(self, cq: str | CQ) -> DataFrame:
        """Answers of a conjunctive query: by stored pairs where there is a store of them, else by its atoms."""
        tree = self.parse(cq) if isinstance(cq, str) else cq
        if tree.atoms and (stored := self.stored_cover(tree)):
            return compile_components(stored, tree.head, self.graph, self.store.lookup)
        return compile_cq(tree, self.graph)

    def paths(self, cpq: str | CPQ) -> DataFrame:
        """Pairs of a path query: stored ones, or else computed ones."""
        tree = parse_cpq(cpq, self.labels) if isinstance(cpq, str) else cpq
        stored = self.store.lookup(tree) if self.store else None
        return compile_cpq(tree, self.graph) if stored is None else stored

    def cover(self, cq: str | CQ, strategy: Strategy = Strategy.FIRST, seed: int = 0) -> list[Component]:
        return choose_cover(self.parse(cq) if isinstance(cq, str) else cq, self.k, strategy, seed)

    def stored_cover(self, cq: CQ) -> list[Component] | None:
        """The cover of fewest components that the store or the edges give, among the first COVERS; None without a store."""
        if not self.store:
            return None
        covers = itertools.islice(exact_covers(cq, self.k), COVERS)
        return min((c for c in covers if all(not x.mask or isinstance(x.cpq, Edge) or self.store.has(x.cpq) for x in c)), key=len)

    def query_by(self, cq: str | CQ, strategy: Strategy = Strategy.FIRST, seed: int = 0) -> DataFrame:
        """Answers of a conjunctive query, by a cover of components; the same answers for any cover."""
        tree = self.parse(cq) if isinstance(cq, str) else cq
        lookup = self.store.lookup if self.store else None
        return compile_components(self.cover(tree, strategy, seed), tree.head, self.graph, lookup)
