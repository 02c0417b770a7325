"""The corpus pipeline: STAGES in order, each over all that the one before kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of their documents.
Every row is a document: decisions are carried by doc_id and a hash of the text, so rows without an id, and different texts
of one id, are judged like others. Rows that repeat both are one document, of which near-duplicates keep one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphcq.llm import decontaminate, langid, linededup, packing, simhash
from graphcq.llm.common import durable, is_small, table
from graphcq.llm.queries import tokenizer_path

#: A document whose largest language has a smaller share than this has no language; keys that may be broadcast at most.
MIN_SHARE, BROADCAST_KEYS = 0.4, 200_000


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): doc_id is a key without nulls, of ids before none; row has all columns."""
    key = F.struct(docs["doc_id"].isNull().alias("none"), F.coalesce(docs["doc_id"], F.lit(0)).alias("id"), F.xxhash64(docs["text"]).alias("text"))
    return docs.select(key.alias("doc_id"), docs["text"].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """keyed but those whose key is among `keys`."""
    keys = durable(keys.distinct())
    return keyed.join(F.broadcast(keys) if is_small(keys, BROADCAST_KEYS) else keys, "doc_id", "left_anti")


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without letters and those in which no language has a share of MIN_SHARE."""
    rest = langid.remainder("doc_id", 4)
    model = langid.fit(docs, "doc_id", "text", "lang", (rest != 2) & (rest >= 0))
    found = langid.identify(docs.select([docs[c].alias(f"doc_{c}") for c in docs.columns]), model, "doc_text", tuple(f"doc_{c}" for c in docs.columns))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SHARE))
    return kept.select([F.col(f"doc_{c}").alias(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take cross-site boilerplate lines out of the texts; n_chars follows."""
    cleaned = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group, one without an id only where no other has one."""
    keyed = _keyed(docs)
    groups = durable(simhash.near_duplicates(keyed))
    kept = _without(keyed, groups.where("doc_id <> component_id").select("doc_id"))
    repeated = durable(groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        # However many copies a row has, one of them is picked before the shuffle.
        again = kept.join(F.broadcast(repeated) if is_small(repeated, BROADCAST_KEYS) else repeated, "doc_id", "left_semi")
        kept = _without(kept, repeated).select("row").unionByName(again.groupBy("doc_id").agg(F.first("row").alias("row")).select("row"))
    return kept.select("row.*")


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    keyed = _keyed(docs)
    return _without(keyed, decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark")).select("doc_id")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences; few words are remembered, as the workers have run all stages before."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), remembered=250_000)


STAGES = [
    ("language ID", identify_languages),
    ("line dedup", dedup_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_documents),
    ("packing", pack_sequences),
]
#: The classifier, the fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage kept is checkpointed, as the next one reads it several times."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
