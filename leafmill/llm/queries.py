"""One registered query for each training-data operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocklabel, ctw, decontam, hosturl, linededup, quality, simhash, spiece, surrogate, tokenbin
from .common import table

#: End-of-document id of the token files.
END_ID = 2


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that overlap."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op3_recurrent_block_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blocklabel.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"), "n_blocks", "n_main")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_ID)


def op5_site_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents.source is the host: every document with its text without boilerplate lines."""
    out = linededup.drop_lines(table(spark, sf_dir, "documents"), "source")
    return out.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_lines", "n_dropped")


def op6_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data, and the kinds found."""
    out = surrogate.pseudonymize(table(spark, sf_dir, "documents"))
    kinds = F.array_join(F.array_sort(F.array_distinct("_kinds")), ",")
    return out.select("doc_id", "text", F.size("_kinds").cast("long").alias("n_mentions"), kinds.alias("kinds"))


def op8_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosturl.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "words", "log_odds")


def op9_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents")).drop("clean_text")


def op10_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document."""
    return spiece.segmentations(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_spaced_seed_decontamination, op2_context_tree_weighting, op3_recurrent_block_labels, op4_token_files, op5_site_line_frequency, op6_simhash_gray_index,
        op7_surrogates, op8_host_words, op9_line_first_cleaning, op10_gumbel_segmentations,
    )
}
