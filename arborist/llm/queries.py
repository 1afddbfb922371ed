"""The driver's queries over whole tables, each through its operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, class_lm, collocations, jaccard_join, language_id, license_scan, media, near_dedup, packing, pii, quality_classifier, quality_rules, time_partitions
from .spark_io import held_out, table


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(5, 0)).select("doc_id", F.col("quality").alias("label"))
    out = quality_classifier.classify(docs, quality_classifier.fit(docs, labels))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_columns(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length")


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations in sequences of 2,048 tokens, 16 turns and 1,024 tokens that bear loss at most."""
    demands = packing.conversation_demands(table(spark, sf_dir, "conversations"))
    return packing.pack_examples(demands, 2048, 16, 1024)


def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = class_lm.score(docs, *class_lm.fit(docs.where(~held_out(10, 0))))
    return out.select("doc_id", held_out(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op7_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def op8_bpe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


def op10_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    references = language_id.fit(docs.where(~held_out(3, 1)))
    out = language_id.predict(docs, references)
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", F.col("score"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op12_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_partitions.click_partitions(table(spark, sf_dir, "clicks"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_rule_ensemble, op2_media_columns, op3_vector_packing, op4_bag_minhash, op5_brown_classes, op6_sanitisation, op7_perplexity_rules, op8_bpe_fold, op9_license_notices, op10_cross_parsing, op11_jaccard_join, op12_time_partitions, op13_collocations, pack_conversations)}
ORACLE_SQL: dict[str, str] = {}
