"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 62


def remainder(id_col: str, mod: int):
    """crc32 of the id as text, modulo `mod`; null ids are of no class and give -1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod, F.lit(-1))


def by_hash(rows: DataFrame, key: str, label: str, per_label: int, most_labels: int) -> DataFrame:
    """About `per_label` distinct keys of each label (all, if there are no more), the same ones at every run.

    `key` is a hash of a row. A label's share of the keys is settled by its count alone, so nothing is ranked or
    gathered: rows are kept where their key, hashed again, is below that share of the span. Over `most_labels` labels is
    an error, so what is broadcast has that many rows at most. Rows of one key are kept or not together.
    """
    counts = rows.groupBy(label).count().limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"over {most_labels} labels")
    shares = [(r[0], int(min(1.0, per_label / r[1]) * SPAN)) for r in counts]
    place = F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(SPAN))
    if most_labels == 1:
        return rows.where(place < (shares[0][1] if shares else 0))
    share = rows.sparkSession.createDataFrame(shares, rows.select(F.col(label), F.lit(0).cast("long").alias("_share")).schema)
    return rows.join(F.broadcast(share), label).where(place < F.col("_share")).drop("_share")
