"""Benchmark decontamination by size-partitioned MinHash containment search; DataFrame operations only.

A short item inside a long document has a high containment but a low resemblance, so signatures of equal length on both
sides would miss it. Items are partitioned by the number n of their shingles into classes (u/2, u]; the MinHash sketch
of an item is its floor((1 - t) u) + 1 smallest shingle hashes, so a document that holds a share t or more of the item's
shingles must hold one of the sketch: no item is missed. A document with fewer shingles than that share is no candidate.
Candidates are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphcq.llm.common import durable, is_small

#: Rows of sketch hashes or item shingles that may be broadcast at most (some 20 and 100 bytes each).
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once per row: it is the variable of a transform over an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shingles(w: Column, width: int) -> Column:
    """Runs of `width` words, joined by a space; a shorter sequence is one shingle, no words none."""
    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
        return F.when(F.size(w) >= width, every).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return _bound(w, runs)


def _hashes(w: Column, width: int) -> Column:
    """Hashes of the same shingles, out of hashes of their words."""
    def runs(h: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        short = F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))
        return F.when(F.size(h) >= width, every).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return _bound(F.transform(w, lambda x: F.xxhash64(x)), runs)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """(doc_id, item_id, item_shingles int, matched int, containment double): items found in documents.

    docs (doc_id, text) and items (item_id, text). Texts are lower-cased and split at anything but letters and digits; an
    item is found in a document that has at least `threshold` of its distinct shingles of `width` words. A sequence of
    fewer words is one shingle as a whole, so such an item is found only in a document of the same words. Null, empty
    and wordless texts and null ids take no part. Rows that repeat an id count as one document or item each, and the
    best of them is returned; no items or no documents give no rows; other columns are ignored.
    """
    its = items.where(items["item_id"].isNotNull()).select(items["item_id"].alias("item_id"), words(items["text"]).alias("w")).where(F.size("w") > 0).distinct()
    its = its.select("item_id", F.xxhash64("w").alias("version"), F.array_distinct(_shingles(F.col("w"), width)).alias("s"), F.array_sort(F.array_distinct(_hashes(F.col("w"), width))).alias("h"))
    its = durable(its.withColumn("n", F.size("h")))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n")))
    keep = F.floor((1 - threshold) * upper + 1e-9).cast("int") + 1
    sketch = its.select("item_id", "version", "n", F.explode(F.slice("h", 1, keep)).alias("hash"))
    small = is_small(sketch, BROADCAST_ROWS)
    rows = docs.where(docs["doc_id"].isNotNull()).select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    seen = rows.select("doc_id", F.xxhash64("text").alias("sum"), _hashes(words(F.col("text")), width).alias("h"))
    seen = seen.select("doc_id", "sum", F.size("h").alias("len"), F.explode("h").alias("hash"))
    probe = sketch.select("hash", F.ceil(F.col("n") * threshold - 1e-9).alias("need")).groupBy("hash").agg(F.min("need").alias("need"))
    hit = seen.join(F.broadcast(probe) if small else probe, "hash").where("len >= need")
    # Which items a document may hold is settled on the few rows of its hits.
    candidates = hit.select("doc_id", "sum", "hash").distinct().join(sketch.select("item_id", "version", "hash"), "hash").select("doc_id", "sum", "item_id", "version").distinct()
    candidates = durable(candidates)
    few = candidates.select("doc_id", "sum").distinct()
    few = F.broadcast(few) if is_small(few, BROADCAST_ROWS) else few
    own = rows.withColumn("sum", F.xxhash64("text")).join(few, ["doc_id", "sum"], "left_semi").distinct()
    own = own.select("doc_id", "sum", F.explode(F.array_distinct(_shingles(words(F.col("text")), width))).alias("shingle"))
    parts = its.select("item_id", "version", "n", F.explode("s").alias("shingle"))
    if is_small(parts, BROADCAST_ROWS):
        parts = F.broadcast(parts)
    matched = own.join(parts, "shingle").groupBy("doc_id", "sum", "item_id", "version", "n").agg(F.count("*").cast("int").alias("matched"))
    matched = matched.join(candidates, ["doc_id", "sum", "item_id", "version"], "left_semi").where(F.col("matched") >= F.col("n") * threshold - 1e-9)
    best = matched.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("matched") / F.col("n"), F.col("n"), F.col("matched"))).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.n").alias("item_shingles"), F.col("m.matched").alias("matched"), F.round(F.col("m.matched") / F.col("m.n"), 6).alias("containment"))


SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM d),
it AS (SELECT item_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS ss FROM i),
si AS (SELECT item_id, len(ss) AS n, unnest(ss) AS s FROM it)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS item_shingles, CAST(count(*) AS INTEGER) AS matched, round(count(*) / n, 6) AS containment
FROM ds JOIN si USING (s) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n - 1e-9
"""
