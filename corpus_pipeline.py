"""Corpus pipeline: the stages a training corpus passes, each written as Parquet and read again.

1. quality_rules: rejected documents go, failing lines of the others too.
2. line_dedup: lines on over 6 % of a source's pages go.
3. near_dedup: of documents whose five-word runs are similar by 0.8 or more one stays, the one with the smallest doc_id.
4. decontaminate: documents that overlap a benchmark item go.
5. segment: two distinct sampled SentencePiece segmentations of every document that is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import decontam, linededup, neardup, quality, spiece
from leafmill.llm.common import shared_dir, table
from leafmill.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup(docs, "source")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spiece.segmentations(docs, vocabulary("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("segment", segment),
]

#: The last stage samples segmentations, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    docs, at = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
