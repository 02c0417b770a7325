"""One query per operator, with production parameters, over whole tables; and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphcq.llm import decontaminate, linededup, scoring, search
from graphcq.llm.common import table


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file, as the installed package gives it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact_top_k(table(spark, sf_dir, "embeddings"))


def op4_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphcq.llm.sharding import shard

    placed = shard(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphcq.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphcq.llm.langid import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op8_simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphcq.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphcq.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphcq.llm.scoring import backoff_scores

    scores = backoff_scores(table(spark, sf_dir, "documents"))
    return scores.withColumn("log_score", F.round("log_score", 4))


def bigram_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 by bigrams and words only."""
    from graphcq.llm.scoring import backoff_scores

    scores = backoff_scores(table(spark, sf_dir, "documents"), order=2)
    return scores.withColumn("log_score", F.round("log_score", 4))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphcq.llm.linededup import dedup_lines

    cleaned = dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphcq.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphcq.llm.pii import digest, find

    return digest(find(table(spark, sf_dir, "documents")))


_QUERIES = (
    op1_backoff_scores, op2_line_dedup, op3_exact_topk, op4_ring_sharding, op5_best_fit_packing, op6_language_id,
    op7_decontamination, op8_simhash_segments, op9_pii_disclosure, op10_toxicity_grammar)
QUERIES = {f.__name__: f for f in _QUERIES}
#: Beside the one query of each operator.
FURTHER = {f.__name__: f for f in (bigram_backoff_scores,)}
SQL: dict[str, str] = {
    "op1_backoff_scores": scoring.SQL, "bigram_backoff_scores": scoring.SQL_OF_BIGRAMS, "op2_line_dedup": linededup.SQL, "op3_exact_topk": search.SQL,
    "op7_decontamination": decontaminate.SQL}
