"""Corpus pipeline: documents in, token files out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Its result is written and
read again as the next one's documents.

All stages take nulls in any column, texts of any length, repeated rows and empty tables, and carry further columns whatever their
names; an empty table gives an empty result. What they do with a row that says nothing is told at each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strata.llm import decontaminate, minhash, mixing, quality_rules, token_files
from strata.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go. A null or empty text has too few words and goes; of repeated rows each is
    judged by itself; a language without a word list, or none, is no reason to go."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five-word shingles at a similarity of 0.8: one document of each group stays, that with the
    least key. Texts without words are in no group and stay; rows with null or repeated keys are documents of their own."""
    return minhash.keep_one(docs, minhash.Near(shingle=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents of which test items make a twentieth of the words or more go.
    A text without words stays; items without words match nothing; each repeated row is judged by itself."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: documents come as often as they are drawn. A null source is a source, the last one; texts
    without words have size 0, and a source of such alone is never drawn; rows that repeat a key are drawn together or not at all."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files: the ids of all documents by ascending doc_id, bit-packed; per document, what the files hold. A
    null text has the end id alone; null keys come first, rows of one key in the order of their texts."""
    manifest = token_files.write_tokens(docs, token_files.token_folder(spark), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(manifest)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokens and hashes are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
