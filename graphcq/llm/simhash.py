"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint maps to the bit counts of its sixteen 4-bit segments. The Manhattan distance of two such vectors is
at most the Hamming distance of the fingerprints, so fingerprints within d bits have vectors within d, and one half of
the vector, of eight segments, within d // 2. The join is a grid range-join with unit cells on either half: a
fingerprint lies in its own cell and asks all cells of that smaller ball (one of each pair of opposite steps is
enough), and what meets is verified on the bits.

Popcounts crowd around two a segment, so a few cells hold many fingerprints. Those are counted first, and a crowded cell is
parted: a fingerprint lies in one part of it and asks the later ones, and what asks the cell asks all its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphcq.llm.common import connected_components, durable, giving_back, parts_for, pick

#: Rows of the grid join that a task gets, about; pairs that it verifies at once.
GRID_ROWS, PAIRS = 500_000, 500_000
#: Fingerprints of a part of a cell, about, and the crowded cells that there may be for each of them: at most 1 / CROWDED
#: of twice the fingerprints have more. Parts are told by the bits of a cell's number from PART on.
CROWDED, PART = 5_000, 40


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Bits set in over half the XXH64 hashes of the word shingles; ASCII white space and case only; no words give 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(whole, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = len(words) - width + 1
    found = np.fromiter((hashed(whole[a:b], seed) for a, b in zip((ends - sizes)[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(found[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp long): the fingerprint of every row, as a signed number; doc_id keeps its type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = pick(docs, ["doc_id", "text"])
    return rows.mapInArrow(giving_back(run), T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())]))


def segment_counts(x: np.ndarray) -> np.ndarray:
    """Bit counts of the sixteen 4-bit segments, each in its own four bits of a word."""
    pairs = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return (pairs & np.uint64(0x3333333333333333)) + ((pairs >> np.uint64(2)) & np.uint64(0x3333333333333333))


def steps(radius: int) -> np.ndarray:
    """Half of the non-zero vectors of eight integers with Manhattan norm at most `radius`, as sums of 16**i."""
    vectors = {(0,) * 8}
    for _ in range(radius):
        vectors |= {v[:i] + (v[i] + s,) + v[i + 1 :] for v in vectors for i in range(8) for s in (-1, 1)}
    return np.array([sum(c * 16**i for i, c in enumerate(v)) for v in sorted(vectors) if v > (0,) * 8], np.int64)


def own_cells(fps: np.ndarray) -> list[np.ndarray]:
    """The fingerprints' own cells, by either half of the vector."""
    counts = segment_counts(fps.view(np.uint64))
    # 4 more per segment leaves room for the steps; the half is told by the next digit.
    return [((counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64) + 0x44444444 + (half << 32) for half in (0, 1)]


def grid(fps: np.ndarray, moves: np.ndarray, parted: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64),) * 2) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fp) of either half: the own cell, marked by an even number, and those that `moves` lead to, by an odd one.

    `parted` has crowded cells, ascending, and the parts of each.
    """
    mixed = (fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)

    def parts(cells: np.ndarray) -> np.ndarray:
        if not len(parted[0]):
            return np.ones(len(cells), np.int64)
        at = np.minimum(np.searchsorted(parted[0], cells), len(parted[0]) - 1)
        return np.where(parted[0][at] == cells, parted[1][at], 1)

    def each(cells: np.ndarray, fps: np.ndarray, n: np.ndarray, after: np.ndarray) -> None:
        """Ask the parts of n that come after one."""
        left = n - after
        part = np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left) + np.repeat(after, left)
        out.append((np.repeat(cells * 2 + 1, left) | part << PART, np.repeat(fps, left)))

    out: list[tuple[np.ndarray, np.ndarray]] = []
    for own in own_cells(fps):
        n = parts(own)
        part = (mixed % n.astype(np.uint64)).astype(np.int64)
        out.append((own * 2 | part << PART, fps))
        each(own, fps, n, part + 1)
        asked = (own[:, None] + moves[None, :]).ravel()
        each(asked, np.repeat(fps, len(moves)), parts(asked), np.zeros(len(asked), np.int64))
    return np.concatenate([c for c, _ in out]), np.concatenate([f for _, f in out])


def meet(cells: np.ndarray, fps: np.ndarray, distance: int) -> np.ndarray:
    """Edges (v, root) that connect what links within these rows: fewer edges than fingerprints, however many pairs."""
    order = np.lexsort((cells & 1, cells >> 1))
    cells, fps = cells[order], fps[order]
    base = cells >> 1
    values, code = np.unique(fps, return_inverse=True)
    parent = np.arange(len(values))
    is_own = (cells & 1) == 0
    own_at = np.flatnonzero(is_own)
    own_base = base[own_at]
    lo, hi = np.searchsorted(own_base, base, "left"), np.searchsorted(own_base, base, "right")
    lo = np.where(is_own, np.cumsum(is_own), lo)  # a row of the cell meets those after it, one that asks meets all
    n = hi - lo
    todo, upto = np.flatnonzero(n > 0), 0
    sums = np.cumsum(n[todo])
    while upto < len(todo):
        stop = max(upto + 1, int(np.searchsorted(sums, (sums[upto - 1] if upto else 0) + PAIRS, "right")))
        rows = todo[upto:stop]
        left = np.repeat(rows, n[rows])
        within = np.arange(len(left)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
        right = own_at[lo[left] + within]
        near = np.bitwise_count((fps[left] ^ fps[right]).view(np.uint64)) <= distance
        parent = _union(parent, code[left[near]], code[right[near]])
        upto = stop
    linked = np.flatnonzero(parent != np.arange(len(values)))
    return np.stack([values[linked], values[parent[linked]]], axis=1)


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the sets of a[i] and b[i]; every item points at the smallest of its set."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(parent, b, a)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint string, component_id) for every row of docs (doc_id, text); doc_id may be of any type with an order.

    Fingerprints at most `distance` bits apart link; component_id is the smallest doc_id that links reach. A null text
    has no words, and fingerprint zero, which links like any other. Repeated rows each give a row; a null id takes part
    and has the component of its links (null if they have no id). No documents give no rows; other columns are ignored.
    Equal fingerprints are one vertex, and a task of the grid join gives fewer links than it has fingerprints.
    """
    found = durable(fingerprints(docs, width))
    least = durable(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    moves = steps(distance // 2)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own_cells(batch.column(0).to_numpy())))], names=["cell"])

    held = sorted(least.select("fp").mapInArrow(cells, "cell long").groupBy("cell").count().where(F.col("count") > CROWDED).collect())
    parted = docs.sparkSession.sparkContext.broadcast((np.array([r[0] for r in held], np.int64), np.array([-(-r[1] // CROWDED) for r in held], np.int64)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in grid(fps[at : at + 2000], moves, parted.value)], names=["cell", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            edges = meet(*(np.concatenate([b.column(k).to_numpy() for b in got]) for k in (0, 1)), distance)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["u", "v"])

    parts = parts_for(least.count() * 2 * (len(moves) + 1), GRID_ROWS)
    asked = least.select("fp").mapInArrow(giving_back(ask), "cell long, fp long").repartition(parts, F.shiftright("cell", 1))
    groups = durable(connected_components(asked.mapInArrow(giving_back(link), "u long, v long"))).withColumnRenamed("v", "fp")
    roots = least.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = durable(roots.groupBy("component").agg(F.min("first").alias("component_id")))  # so that a large component's join can be split
    by_fp = roots.select("fp", "component").join(ids, "component").select("fp", "component_id")
    return found.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
