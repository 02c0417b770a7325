"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring, and a key belongs to the first point clockwise of its hash. Shards hold at
most their share of the rows: keys that find their shard full go on clockwise to the next shard with room. The ring has
a fixed number of arcs, so the flow from arc to arc is settled on counts per arc alone (shards x vnodes numbers at most
on the driver), as runs of ranks within an arc; each row then looks up the run that its rank falls into.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphcq.llm.common import pick

#: Finer cells that an arc's ranks are counted in, so that no task has to order a whole arc.
CELLS = 8


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) in ring order; a shard's points depend on its number alone."""
    points = {xxhash.xxh64_intdigest(f"{s}:{v}", 7) >> 1: s for s in reversed(range(shards)) for v in range(vnodes)}
    return sorted(points.items())


def flow(counts: dict[int, int], points: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, from rank, to rank, shard, first slot) for `counts` rows per arc and `room` rows per shard.

    All arcs fill their own shards first, in ring order, lowest ranks first; then overflow moves clockwise, in ring order.
    """
    room, used, runs, over = list(room), [0] * len(room), [], []

    def put(arc: int, rank: int, n: int, shard: int) -> int:
        take = min(n, room[shard])
        if take:
            runs.append((arc, rank, rank + take, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
        return take

    for arc, (_, shard) in enumerate(points):
        n = counts.get(arc, 0)
        if (took := put(arc, 0, n, shard)) < n:
            over.append((arc, took, n - took))
    for arc, rank, n in over:
        at = arc
        while n:
            at = (at + 1) % len(points)
            took = put(arc, rank, n, points[at][1])
            rank, n = rank + took, n - took
    return runs


def shard(docs: DataFrame, shards: int = 40, vnodes: int = 64, key: str = "doc_id", slack: float = 0.0) -> DataFrame:
    """Place every row of docs (doc_id, text) into a shard.

    Returns (doc_id, size long, text_crc32 long, shard int, slot long): size is the UTF-8 bytes of the text (null: none)
    plus 16, text_crc32 that of the text (null: of no bytes), slot gapless from 0 in a shard. With `slack` 0 shards
    differ by one row at most; with slack e a shard holds at most (1 + e) times its share, and fewer rows move when
    shards are added. Equal keys are told apart by the text's checksum and size, and equal rows by any order; null keys
    hash like any value; no documents give no rows; other columns are ignored.
    """
    points = ring_points(shards, vnodes)
    starts = np.array([p for p, _ in points], np.int64)  # the arc's point is the first at or after the hash; past the last the ring closes
    position = F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col(key)), 1)
    rows = pick(docs, dict.fromkeys(["doc_id", "text", key])).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"), position.alias("position"))

    @F.pandas_udf("int")
    def arc_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, at.to_numpy()) % len(starts)).astype("int32")

    rows = rows.withColumn("arc", arc_of("position")).withColumn("cell", F.pmod(F.xxhash64("position", "text_crc32", "size"), F.lit(CELLS)).cast("int"))
    cells = {(r["arc"], r["cell"]): r["count"] for r in rows.groupBy("arc", "cell").count().collect()}  # arcs x CELLS at most
    counts: dict[int, int] = {}
    before: list[tuple[int, int, int]] = []
    for (a, c), n in sorted(cells.items()):
        before.append((a, c, counts.get(a, 0)))
        counts[a] = counts.get(a, 0) + n
    total = sum(counts.values())
    base, more = divmod(total, shards)
    room = [base + (s < more) for s in range(shards)] if not slack else [int((1 + slack) * total / shards) + 1] * shards
    by_arc: dict[int, list[tuple]] = {}
    for a, lo, hi, s, slot in flow(counts, points, room):
        by_arc.setdefault(a, []).append((lo, hi, s, slot))
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(a, c, n, by_arc[a]) for a, c, n in before],
        "arc int, cell int, earlier long, runs array<struct<lo:long,hi:long,shard:int,slot:long>>")
    order = Window.partitionBy("arc", "cell").orderBy("position", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order)).join(F.broadcast(plan), ["arc", "cell"])  # the plan has arcs x CELLS rows at most
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("earlier"))
    ranked = ranked.withColumn("run", F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))[0])
    return ranked.select("doc_id", "size", "text_crc32", F.col("run.shard").alias("shard"), (F.col("run.slot") + F.col("rank") - F.col("run.lo")).alias("slot"))
