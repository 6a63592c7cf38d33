"""Corpus pipeline: quality rules, near-dedup, decontamination, PII masking, BPE encoding.

Each stage takes the whole output of the one before and applies its decisions: rejected, duplicate and contaminated documents go,
personal data are masked (n_chars follows), and the last stage adds the token ids. run() writes every stage as Parquet in the shared folder and
reads it again, so lineage is cut and a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontam, minhash, pii, rules
from tessella.llm.common import written

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep."""
    return rules.clean(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return minhash.deduplicated(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token_ids."""
    return bpe.encoded(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality_rules), ("minhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("pii", mask_pii), ("bpe encoding", encode)]

#: Several stages can't be written in SQL (near-dedup groups, disguised personal data, token ids); tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; columns of documents and token_ids."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
