"""Queries of the training-data operators, each over its whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docshield.llm import chat, chunkdedup, decontam, hardneg, langid, neardup, packing, pii, quality, repair, secrets, suffixdedup, suffixtree
from docshield.llm.common import crc_mod, with_row


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def op1_packing(spark, sf_dir):
    return packing.packed(_read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return suffixdedup.deduplicated(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_language(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    found = langid.identified(docs, docs.where(crc_mod("doc_id", 4) != 2))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_near_duplicates(spark, sf_dir):
    return neardup.classes(_read(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    found = decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_suffix_tree(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False)))
    return suffixtree.scored(docs)


def op7_quality(spark, sf_dir):
    found = quality.quality(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op8_chunk_dedup(spark, sf_dir):
    return chunkdedup.deduplicated(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_chunks", "n_removed_chunks", "n_removed", F.size("spans").cast("long").alias("n_spans"))


def op9_secrets(spark, sf_dir):
    docs = with_row(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return secrets.secrets(docs).select("doc_id", "nth", "start", "length", F.sha2("value", 256).alias("value_sha256"), "kind", "p_secret", "secret")


def op10_chat(spark, sf_dir):
    return chat.rotated(_read(spark, sf_dir, "conversations"))


def op11_hard_negatives(spark, sf_dir):
    return hardneg.hard_negatives(_read(spark, sf_dir, "embeddings"))


def op12_repair(spark, sf_dir):
    return repair.repaired(_read(spark, sf_dir, "conversations"))


def op13_pii(spark, sf_dir):
    return pii.personal_data(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_suffix_dedup, op3_language, op4_near_duplicates, op5_decontamination,
                                   op6_suffix_tree, op7_quality, op8_chunk_dedup, op9_secrets, op10_chat, op11_hard_negatives, op12_repair, op13_pii)}
ORACLE = {"op10_chat": lambda: chat.ROTATED_SQL, "op11_hard_negatives": lambda: hardneg.HARD_NEGATIVES_SQL}
