"""Queries over the test tables, one or more for each operator, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import (
    chat_tree, decontaminate, filter_audit, language_id, minhash, mixing, pii, quality_model, quality_rules, repeats, structure_repair, token_files, warc,
)
from strata.llm.common import scratch_path, stored
from strata.llm.oracle import ORACLE_SQL  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    measured = quality_rules.measure(docs).select(F.col("row.doc_id").alias("doc_id"), "m", "h")
    judged = quality_rules.judge(stored(measured, "quality"))
    return judged.select("doc_id", "m.*", "base_failed", "kept")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.Near(shingle=3, percent=85))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.accounted(_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    manifest = token_files.write_tokens(docs, token_files.token_folder(spark), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(manifest)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.read_archives(manifest, html=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_model.judge(_table(spark, sf_dir, "documents"), trusted)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = language_id.train(docs.where(~held_out))
    found = language_id.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op11_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more that says the template's own marks."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], turns.schema)
    return chat_tree.format_chats(turns.unionByName(more))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repair(structure_repair.damaged(_table(spark, sf_dir, "conversations")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_pii": op2_pii,
    "op3_token_files": op3_token_files,
    "op4_mixing": op4_mixing,
    "op5_decontamination": op5_decontamination,
    "op6_warc": op6_warc,
    "op7_quality_model": op7_quality_model,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op11_chat_tree": op11_chat_tree,
    "op12_structure_repair": op12_structure_repair,
    "op13_filter_audit": op13_filter_audit,
}
