"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the rows that the next one gets, which are
written as Parquet in between. Stages that run Python bound the session's Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, mixing, ngram_join, rules, suffixes
from gridloom.llm.common import small_batches, table, written
from gridloom.llm.queries import vocabulary

#: Near copies share four fifths of their five-word shingles.
NEAR = ngram_join.Similarity(num=80, den=100, width=5)
#: Passages of so many bytes that occur twice go: about 45 words.
PASSAGE_BYTES = 240


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest accept."""
    small_batches(spark)
    return rules.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return ngram_join.one_of_each(docs, NEAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur more than once."""
    small_batches(spark)
    return suffixes.documents_without_repeats(docs, PASSAGE_BYTES)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, ``ids`` (packed), ``n_tokens`` and digests; fails if the ids
    don't decode to the text."""
    small_batches(spark)
    decoded = bpe.bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), *vocabulary(), frugally=True)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return decoded.select(
        "doc_id",
        "lang",
        "source",
        F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("token ids don't decode to their text"))).alias("ids"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: The forest's random splits, the components and the tokenizer have no SQL form; tests compare
#: the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
