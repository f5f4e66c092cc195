"""The corpus pipeline: documents through quality rules, exact and near dedup, mixing and tokens. Part of subpackage llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from treescan.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules
from treescan.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a learned rule reject go."""
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    return judged.where(f"`{judged.columns[-1]}`.kept").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return near_dedup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that gives each source its share of every prefix as long as it lasts."""
    return mixing.in_order(mixing.mix(docs, mixing.tempered))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, with their place in the mix (position, slot, phase), as files are read in any order,
    and n_tokens, ids_sha256, decoded_sha256 and ids."""
    docs = mixing.mix(docs, mixing.tempered)
    *columns, mix = docs.columns
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(*columns, *[f"{mix}.{c}" for c in ("position", "slot", "phase")], f"{coded.columns[-1]}.*")


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("byte_level_bpe", tokens)]

#: None: SQL can express neither the learned rules nor the signatures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
