"""Line dedup by distinct-site spread.

A line that many sites share is boilerplate. Lines that occur often enough to reach the threshold at all get a
HyperLogLog sketch of their sites, merged by aggregation. A sketch that is clearly above or below the threshold decides;
lines in the band around it get an exact distinct count. Boilerplate lines stay where they come first and go elsewhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphcq.llm.common import durable, giving_back, is_small, pick

#: log2 of a sketch's registers; its relative standard error is about 1.04 / sqrt(2**12) = 1.6 %.
REGISTERS = 12
#: The band around the threshold within which lines are counted exactly, as a share of it: several standard errors.
BAND = 0.15
#: Rows of line keys that may be broadcast at most (some 60 bytes each).
BROADCAST_ROWS = 200_000


def _key(line: Column) -> Column:
    """Two hashes and the length, as Python makes them too."""
    return F.struct(F.xxhash64(line).alias("a"), F.crc32(F.encode(line, "UTF-8")).alias("b"), F.char_length(line).alias("n"))


def lines_of(docs: DataFrame, min_words: int, min_chars: int) -> DataFrame:
    """(doc_id, site, sum, pos, key) per line of at least `min_words` words or `min_chars` characters; sum, of the text,
    tells repeated ids apart."""
    lines = docs.select("doc_id", F.col("source").alias("site"), F.xxhash64("text").alias("sum"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = F.trim("line")
    spaces = F.char_length(bare) - F.char_length(F.replace(bare, F.lit(" "), F.lit("")))
    return lines.where((spaces >= min_words - 1) | (F.char_length(bare) >= min_chars)).select("doc_id", "site", "sum", "pos", _key(F.col("line")).alias("key"))


def _only(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Lines whose key is among `keys`, with the columns of `keys`; broadcast only where the keys are few."""
    return lines.join(F.broadcast(keys) if is_small(keys, BROADCAST_ROWS) else keys, "key")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(key, first): lines on at least `min_sites` distinct sites, and the first (doc_id, pos) that has each."""
    often = lines.groupBy("key").agg(F.count("*").alias("times")).where(F.col("times") >= min_sites).select("key")
    often = durable(often)
    seen = _only(lines, often)
    spread = seen.groupBy("key").agg(F.hll_sketch_agg(F.coalesce("site", F.lit("")), F.lit(REGISTERS)).alias("sketch"), F.min(F.struct("doc_id", "sum", "pos")).alias("first"))
    spread = durable(spread.select("key", "first", F.hll_sketch_estimate("sketch").alias("sites")))
    near = spread.where(F.col("sites").between(min_sites * (1 - BAND), min_sites * (1 + BAND)))
    exact = _only(lines, near.select("key")).groupBy("key", F.coalesce("site", F.lit("")).alias("site")).count().groupBy("key").agg(F.count("*").alias("exact"))
    decided = spread.join(exact, "key", "left").where(F.coalesce("exact", "sites") >= min_sites)
    return durable(decided.select("key", "first"))


def _cleaned_by_set(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs with `text`, n_lines and n_removed, from a broadcast of the boilerplate lines' keys: no text moves."""
    first = {r["a"]: (r["b"], r["n"], tuple(r["first"])) for r in bad.select("key.a", "key.b", "key.n", "first").collect()}  # BROADCAST_ROWS at most, as was checked
    shared = docs.sparkSession.sparkContext.broadcast(first)
    names = docs.columns
    id_at, text_at = names.index("doc_id"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            for doc_id, text, total in zip(batch.column(id_at).to_pylist(), batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                kept = []
                for pos, line in enumerate(lines):
                    raw = line.encode()
                    at = known.get(_signed(xxhash.xxh64_intdigest(raw, 42)))
                    if at is None or at[:2] != (zlib.crc32(raw), len(line)) or at[2] == (doc_id, total, pos):
                        kept.append(line)
                texts.append("\n".join(kept) if text is not None and len(kept) < len(lines) else text)
                n_lines.append(len(lines))
                n_removed.append(len(lines) - len(kept))
            columns = list(batch.columns[:-1])
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int32()), pa.array(n_removed, pa.int32())], names=[*names, "n_lines", "n_removed"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.IntegerType()), T.StructField("n_removed", T.IntegerType())])
    return docs.select("*", F.xxhash64("text").alias("_text_sum")).mapInArrow(giving_back(run), schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cleaned_by_join(docs: DataFrame, lines: DataFrame, bad: DataFrame) -> DataFrame:
    """The same by joins, for any number of boilerplate lines."""
    here = F.struct("doc_id", "sum", "pos")
    gone = lines.join(bad, "key").where(~here.eqNullSafe(F.col("first"))).groupBy("doc_id", "sum").agg(F.collect_set("pos").alias("_gone"))
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("sum").alias("_gone_sum"), "_gone")
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_sum"]), "left")
    left = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("_gone", i))
    cleaned = joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))))
    cleaned = cleaned.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    return cleaned.withColumn("n_removed", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone"))).drop("_gone_id", "_gone_sum", "_gone")


def dedup_lines(docs: DataFrame, min_sites: int = 10, min_words: int = 5, min_chars: int = 16, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs (doc_id, text, source) with cleaned `text`, n_lines int and n_removed int; other columns are kept, but
    for any of the two new names.

    A line, exactly as written between line feeds, is boilerplate if it has at least `min_words` words (spaces within it,
    and one) or `min_chars` characters (without spaces around it; so short notices and scripts without spaces count), and
    stands on at least `min_sites` distinct sources (a null source is one of its own). Shorter lines, such as a word that
    many sites have by chance, are never boilerplate. It stays where the
    smallest (doc_id, checksum of the text, position) has it (null ids first), and goes elsewhere, again in the same
    document too. A null text stays null with 0 lines; an empty text has one empty line; a document of nothing but
    boilerplate becomes empty but stays. Of repeated rows (same id and text) each is cleaned in the same way. No
    documents give no rows. Over `broadcast_rows` boilerplate lines, joins do what a broadcast of their keys does below.
    """
    docs = docs.drop("n_lines", "n_removed")
    lines = lines_of(pick(docs, ["doc_id", "text", "source"]), min_words, min_chars)
    bad = boilerplate(lines, min_sites)
    if is_small(bad, broadcast_rows):
        return _cleaned_by_set(docs, bad)
    return _cleaned_by_join(docs, lines, bad)


SQL = """
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
f AS (
  SELECT line, min(struct_pack(d := doc_id, p := pos)) AS first FROM l
  WHERE length(trim(line, ' ')) - length(replace(trim(line, ' '), ' ', '')) >= 4 OR length(trim(line, ' ')) >= 16 GROUP BY line HAVING count(DISTINCT site) >= 10),
m AS (SELECT l.*, f.line IS NOT NULL AND struct_pack(d := doc_id, p := pos) <> f.first AS gone FROM l LEFT JOIN f USING (line)),
c AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed, md5(c.text) AS text_md5
FROM documents d LEFT JOIN c USING (doc_id)
"""
