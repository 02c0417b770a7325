"""Exact top-k by inner product: ball-tree branch and bound per shard.

Candidates are dealt to shards of a bounded size, each of which builds its ball trees once and keeps them, packed, in the
shared folder. A query visits nodes in the order of the most that any vector in them can score, the lesser of q.c + |q| r
and |q| times the longest vector, and skips a node whose bound is below the score of its current k-th best. That k-th
score is shared: a first pass searches one shard for each query, its home; the k-th best there is a floor that the second
pass starts from in all others. Queries stream through a shard, so a task holds one shard's trees and a batch of them.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphcq.llm.common import durable, giving_back, parts_for

LEAF = 48
#: Vectors a shard holds at most, about; vectors for which there is a shard, up to LEAST_SHARDS.
SHARD_ROWS, LEAST_ROWS, LEAST_SHARDS = 100_000, 3_000, 12
#: Sums of products below this cannot overflow.
EXACT = 2.0**62


class BallTree:
    """Over the rows of an integer matrix: split at the median of the direction between two vectors far apart."""

    def __init__(self, x: np.ndarray) -> None:
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, int, int]] = []  # from, to, left, right
        centers, radii, longest = [], [], []
        todo = [(0, len(x), -1, False)]
        while todo:
            lo, hi, parent, right = todo.pop()
            own = x[self.order[lo:hi]].astype(np.float64)
            center = own.mean(axis=0)
            centers.append(center)
            away = ((own - center) ** 2).sum(axis=1)
            radii.append(float(np.sqrt(away.max())))
            longest.append(float(np.sqrt((own**2).sum(axis=1).max())))
            at = len(self.nodes)
            self.nodes.append((lo, hi, -1, -1))
            if parent >= 0:
                a, b, left, old = self.nodes[parent]
                self.nodes[parent] = (a, b, left, at) if right else (a, b, at, old)
            if hi - lo > LEAF and radii[-1] > 0:
                one = own[int(away.argmax())]
                other = own[int(((own - one) ** 2).sum(axis=1).argmax())]
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(own @ (other - one), mid)]
                todo += [(lo, lo + mid, at, False), (lo + mid, hi, at, True)]
        self.x, self.centers, self.radii, self.longest = x[self.order], np.array(centers), np.array(radii), np.array(longest)
        self.most = float(np.abs(self.x.astype(np.float64)).max(initial=0.0)) * x.shape[1]

    @classmethod
    def of(cls, parts: dict) -> BallTree:
        """The tree that vars() gave."""
        tree = cls.__new__(cls)
        vars(tree).update(parts)
        return tree

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """At least the score of any vector of each node; a hair above, against rounding."""
        b, n = self.centers @ q, float(np.linalg.norm(q))
        b = np.minimum(b + n * self.radii, n * self.longest)
        return b + 1e-9 * (np.abs(b) + n * self.longest) + 1e-6

    def scores(self, lo: int, hi: int, q: np.ndarray) -> np.ndarray:
        """Inner products; where a long may not hold a sum, of whole numbers without end, cut to the ends of a long."""
        if self.most * float(np.abs(q.astype(np.float64)).max(initial=0.0)) < EXACT:
            return self.x[lo:hi].astype(np.int64) @ q
        return np.array([min(max(sum(int(a) * int(b) for a, b in zip(v, q, strict=True)), -(2**63)), 2**63 - 1) for v in self.x[lo:hi]], np.int64)


def top_k(tree: BallTree, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, floor: int | None, best: list | None = None, seen: list | None = None) -> list[tuple[int, int, int]]:
    """The k best (score, -id, row), of those in `best` too, but for row `own` and scores below `floor`. `seen` gets the leaves visited."""
    bounds = tree.bounds(q.astype(np.float64))
    best = [] if best is None else best
    todo = [(-bounds[0], 0)]
    while todo:
        bound, node = heapq.heappop(todo)
        least = best[0][0] if len(best) == k else floor
        if least is not None and -bound < least:
            break
        lo, hi, left, right = tree.nodes[node]
        if left >= 0:
            for child in (left, right):
                heapq.heappush(todo, (-bounds[child], child))
            continue
        if seen is not None:
            seen.append(node)
        scores = tree.scores(lo, hi, q)
        for j in np.flatnonzero(scores >= least) if least is not None else range(hi - lo):
            at = tree.order[lo + j]
            item = (int(scores[j]), -int(ids[at]), int(rows[at]))
            if item[2] == own:
                continue
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
    return best


def _fitting(q: np.ndarray, width: int) -> np.ndarray:
    """q with zeros behind, or cut: its product with vectors of that width is over the components that both have."""
    return q[:width] if len(q) >= width else np.concatenate([q, np.zeros(width - len(q), q.dtype)])


def _trees(candidates: DataFrame, shards: int) -> DataFrame:
    """(shard, data) of candidates (shard, row, vec_id, v): the packed trees of each shard, one for each width of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            packed = []
            for rows in held.values():
                x = np.array([v for _, _, v in rows], np.int64).reshape(len(rows), -1)
                small = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= x.min(initial=0) and x.max(initial=0) <= np.iinfo(t).max)
                packed.append((np.array([r for r, _, _ in rows]), np.array([i for _, i, _ in rows]), vars(BallTree(x.astype(small)))))
            if packed:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pickle.dumps(packed, protocol=5)], pa.binary())], names=["shard", "data"])

        for batch in batches:
            for shard, row, vec_id, v in zip(*(batch.column(c) for c in range(4)), strict=True):
                if shard.as_py() != now:
                    yield from out()
                    now, held = shard.as_py(), {}
                v = np.array(v.values.to_numpy(zero_copy_only=False), np.int64)
                held.setdefault(len(v), []).append((row.as_py(), vec_id.as_py(), v))
        yield from out()

    dealt = candidates.select("shard", "row", "vec_id", "v").repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(giving_back(run), "shard int, data binary")


def _answers(trees: DataFrame, asked: DataFrame, shards: int, k: int) -> DataFrame:
    """(row, query_id, vec_id, score): the k best of its shard for each of `asked` (shard, row, query_id, q, floor or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trees_ = None, []
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for shard, data, row, query, q, floor in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5).to_pylist(), strict=True):
                if data.is_valid:
                    now, trees_ = shard, [(r, i, BallTree.of(parts)) for r, i, parts in pickle.loads(data.as_py())]
                elif shard == now:
                    v = np.array(q.values.to_numpy(zero_copy_only=False), np.int64)
                    best: list[tuple[int, int, int]] = []
                    for rows, ids, tree in trees_:
                        best = top_k(tree, rows, ids, _fitting(v, tree.x.shape[1]), row, k, floor, best)
                    out += [(row, query, -i, s) for s, i, _ in best]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "query_id", "vec_id", "score"])

    none = [F.lit(None).cast("long").alias(c) for c in ("row", "query_id")] + [F.lit(None).cast("array<long>").alias("q"), F.lit(None).cast("long").alias("floor")]
    rows = trees.select("shard", "data", *none).union(asked.select("shard", F.lit(None).cast("binary"), "row", "query_id", "q", "floor"))
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", F.col("data").isNull())  # a shard's trees come before its queries
    return rows.mapInArrow(giving_back(run), "row long, query_id long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_mod: int = 100, k: int = 10,
                scale: int = 1024) -> DataFrame:
    """For each query (rows whose id is divisible by `query_mod`) its k rows of highest inner product, its own row aside.

    Components become floor(scale * x), x as double. Returns (query_id long, rank int from 1, vec_id long, score long),
    ties to the smaller id, all candidates if fewer than k. Null ids and vectors that are null or hold null or non-finite
    components take no part. Every other row is a candidate: a repeated row is one each time, for the others of its id
    too, and each time a query with answers of its own. Vectors of different widths meet in the components that both have;
    an empty one scores 0 with all. Components and scores beyond a long are cut to its ends; sums that fit are exact. No
    queries or no candidates give no rows.
    """
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    base = vectors.select(vectors[id_col].cast("long").alias("vec_id"), F.transform(vectors[vector_col], lambda c: c.cast("double")).alias("v"))
    base = base.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound)
    base = durable(base.withColumn("v", F.transform("v", lambda c: F.floor(c * scale).cast("long")))).withColumn("row", F.monotonically_increasing_id())  # stable: the rows are fixed by now
    rows = base.count()
    shards = max(parts_for(rows, SHARD_ROWS), min(LEAST_SHARDS, parts_for(rows, LEAST_ROWS)), 1)
    home = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    trees = durable(_trees(base.withColumn("shard", home), shards))
    queries = base.where(F.col("vec_id") % query_mod == 0).select("row", F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    first = durable(_answers(trees, queries.withColumn("shard", home).withColumn("floor", F.lit(None).cast("long")), shards, k))
    floors = first.groupBy("row").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    others = queries.join(floors, "row", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
    found = first.union(_answers(trees, others, shards, k))
    by_score = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
o AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 10
"""
